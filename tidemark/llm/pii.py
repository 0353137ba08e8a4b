"""Personal data by patterns and by a skip-chain conditional random field over the tokens of a document."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table, whole_batches

KINDS = ("email", "ip", "card", "phone")
LABELS, OTHER = len(KINDS) + 1, len(KINDS)
#: The field is fitted on made-up labelled texts and on about SAMPLE_DOCS documents, those with the least hashes, of each
#: at most TOKENS_PER_DOC tokens; all counts beside that cover all rows.
MADE_TEXTS, SAMPLE_DOCS, TOKENS_PER_DOC, SEED = 4_000, 2_000, 100, 11
#: Rounds of message passing, and the marginal that a span needs.
ROUNDS, DAMPING, CERTAIN = 12, 0.5, 0.9
DIMENSIONS, FEATURES = 1 << 14, 14
# The patterns of the base spans.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
#: Words in brackets that stand for the signs of an address.
MARKER = re.compile(r"[\[({<](?i:at|dot|ät|punkt|arroba|punto|arobase|point)[\])}>]")
HINT = r"[0-9@]|[\[({<](?i:at|dot|ät|punkt|arroba|punto|arobase|point)[\])}>]"


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of ``[A-Za-z0-9._%+-]+@`` and DOMAIN: around each ``@`` the longest run before it, after the last match."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, in order."""
    if "@" not in text and not DIGIT.search(text):
        return []
    out = [(a, 0, b) for a, b in emails(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() <= 37:
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(DIGIT.findall(m.group())) <= 15]
    return sorted(out)


TOKEN = re.compile(r"\S+")
OUTER = "\"'`,;:!?.…<>[]{}*#&%$"
PIECE = re.compile(r"[+(]{0,2}[0-9][0-9().\-/]*")
SHAPES = str.maketrans({**{str(d): "9" for d in range(10)}})


def shape(word: str) -> str:
    """Digits as 9, letters as a or A; runs of letters shortened to one."""
    plain = re.sub(r"[a-zß-￿]+", "a", word.translate(SHAPES))
    return re.sub("[A-Z]+", "A", plain)


def cell(name: str) -> int:
    return xxhash.xxh32_intdigest(name) % DIMENSIONS


def luhn_holds(digits: str) -> bool:
    return 13 <= len(digits) <= 19 and luhn(digits)


def tokens_of(text: str) -> tuple[list[tuple[int, int, str, int]], list[list[int]]]:
    """Nodes of the field, and the cells of their features.

    A node is (start, end, word, place) of a token with a digit or an ``@``, of a word in
    brackets for a sign of an address, or of a token beside one.
    """
    spans = [(m.start(), m.end()) for m in TOKEN.finditer(text)]
    raw = lambda k: text[spans[k][0] : spans[k][1]] if 0 <= k < len(spans) else ""
    signs = {k for k in range(len(spans)) if MARKER.fullmatch(raw(k))} if MARKER.search(text) else set()
    near = signs | {k + d for k in signs for d in (-1, 1) if 0 <= k + d < len(spans)}
    nodes, cells = [], []
    shapes: dict[int, str] = {}
    pieces: dict[int, tuple[int, int, str]] = {}

    def bare(k: int) -> str:
        return raw(k) if k in signs else raw(k).strip(OUTER)

    def shape_of(k: int) -> str:
        if k not in shapes:
            shapes[k] = shape(bare(k))
        return shapes[k]

    def run_of(k: int) -> tuple[int, int, str]:
        """First and last place, and the digits, of the neighbouring tokens made of digits around token ``k``."""
        if k not in pieces:
            first = last = k
            if PIECE.fullmatch(bare(k)):
                while last + 1 < len(spans) and PIECE.fullmatch(bare(last + 1)):
                    last += 1
            run = (first, last, "".join(DIGIT.findall("".join(map(bare, range(first, last + 1))))))
            for j in range(first, last + 1):
                pieces[j] = run
        return pieces[k]

    for k, (start, _) in enumerate(spans):
        own_raw = raw(k)
        if k not in near and "@" not in own_raw and not DIGIT.search(own_raw) and not MARKER.search(own_raw):
            continue
        own = bare(k)
        if not own:
            continue
        left = own_raw.find(own)
        digits = "".join(DIGIT.findall(own))
        first, last, all_digits = run_of(k)
        before = lambda n: bare(first - n).lower()  # noqa: B023, E731
        mine, sign = shape_of(k), lambda j: "m" if j in signs else "-"
        names = (
            f"s{mine}", f"d{min(len(digits), 20)}", f"@{own.count('@')}.{min(own.count('.'), 4)}:{min(own.count(':'), 3)}", f"p{shape_of(k - 1)}|{mine}",
            f"n{mine}|{shape_of(k + 1)}", f"w{bare(k - 1).lower()}", f"l{min(len(own), 30)}", f"c{own[0] if own[0] in '+(' else ''}{luhn_holds(digits)}",
            f"R{min(len(all_digits), 24)}|{min(last - first, 7)}|{min(k - first, 7)}", f"r{before(1)}", f"q{before(2)}", f"L{luhn_holds(all_digits)}|{last - first < 1}|{bare(first)[:1] == '+'}",
            f"m{sign(k - 1)}{sign(k)}{sign(k + 1)}{bool(MARKER.search(own_raw))}", f"x{bool(re.search('[g-zG-Z]', own))}{'=' in own_raw}{'/' in own}{own[:1] == '0'}",
        )
        nodes.append((start + left, start + left + len(own), own, k))
        cells.append([cell(x) for x in names])
    return nodes, cells


def same_kind_edges(nodes: list[tuple[int, int, str, int]]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Chain edges between neighbouring tokens; skip edges from a token to the next one that repeats or resembles it."""
    chain = [(i, i + 1) for i in range(len(nodes) - 1) if nodes[i + 1][3] == nodes[i][3] + 1]
    skip, seen = [], {}
    for i, (_, _, bare, _) in enumerate(nodes):
        digits = "".join(DIGIT.findall(bare))
        alike = {f"t{bare.lower()}"} | ({f"d{digits}"} if len(digits) >= 6 else set()) | ({f"@{bare.lower().split('@')[0]}"} if "@" in bare else set())
        for key in sorted(alike):
            if key in seen:
                skip.append((seen[key], i))
            seen[key] = i
    return chain, sorted(set(skip))


def token_labels(nodes: list[tuple[int, int, str, int]], spans: list[tuple[int, int, int]]) -> list[int]:
    """The kind of the base span that holds the most of each token, or OTHER."""
    labels, first = [], 0
    for start, end, _, _ in nodes:
        while first < len(spans) and spans[first][2] <= start:
            first += 1
        best = (0, OTHER)
        k = first
        while k < len(spans) and spans[k][0] < end:
            best = max(best, (min(end, spans[k][2]) - max(start, spans[k][0]), spans[k][1]))
            k += 1
        labels.append(best[1])
    return labels


@dataclass
class Field:
    """Weights of the token features, of neighbouring labels and of the labels of tokens alike."""

    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def neighbours(n: int, edges: list[tuple[int, int]], labels: list[int]) -> list[list[int]]:
    """For each of ``n`` nodes the labels of its neighbours along ``edges``."""
    out: list[list[int]] = [[] for _ in range(n)]
    for a, b in edges:
        out[a].append(labels[b])
        out[b].append(labels[a])
    return out


def examples(text: str, spans: list[tuple[int, int, int]], certain: bool) -> list[tuple[int, list[int], list[int], list[int]]]:
    """(label, cells, labels of chain neighbours, labels of skip neighbours) of the nodes of a labelled text.

    Without ``certain`` the spans are those of the base patterns: tokens that look like
    personal data in another form are then left out, since the patterns can't tell.
    """
    nodes, cells = tokens_of(text)
    labels = token_labels(nodes, spans)
    chain, skip = same_kind_edges(nodes)
    rows = zip(nodes, labels, cells, neighbours(len(nodes), chain, labels), neighbours(len(nodes), skip, labels), strict=True)
    unsure = lambda word: any(plausible(kind, word) for kind in range(len(KINDS))) or PIECE.fullmatch(word) or MARKER.search(word)
    return [(label, own, c, s) for node, label, own, c, s in rows if certain or label != OTHER or not unsure(node[2])]


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, made: int = MADE_TEXTS, seed: int = SEED) -> Field:
    """The field of ``docs`` (text), trained jointly on made-up labelled texts and on a sample of ``docs`` labelled by the base patterns.

    The sample takes the documents whose hash is below a bound that follows from the number
    of all, so about as many of them reach the driver whatever the size of the table; copies of
    a text count once.  Null and empty texts give nothing; an empty table leaves the made-up texts.
    """
    text = F.col("text").cast("string")
    hinted = docs.select(text.alias("text")).where(F.col("text").rlike(HINT))
    n = hinted.count()
    bound = (1 << 40) if n <= sample_docs else (sample_docs << 40) // n
    draw = F.pmod(F.xxhash64(F.lit("pii:"), "text"), F.lit(1 << 40))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32())]
        for batch in whole_batches(batches, 16 << 20):
            rows = []
            for whole in batch.column("text").to_pylist():
                own = examples(whole, base_spans(whole), certain=False)
                order = sorted(range(len(own)), key=lambda i: xxhash.xxh3_64_intdigest(str(own[i][1]) + str(i)))  # noqa: B023
                rows += [own[i] for i in order[:TOKENS_PER_DOC]]
            columns = [pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=["label", "cells", "chain", "skip"])

    # Copies of a text are drawn together; one of them is enough, and Spark drops the others before it shuffles.
    sampled = hinted.where(draw < F.lit(bound)).dropDuplicates(["text"]).mapInArrow(describe, "label long, cells array<int>, chain array<int>, skip array<int>")
    rows = sorted((r.label, r.cells, r.chain, r.skip) for r in sampled.collect())
    for whole, spans in made_texts(made, seed):
        rows += examples(whole, spans, certain=True)
    return train(rows)


def train(rows: list[tuple[int, list[int], list[int], list[int]]], rounds: int = 120, rate: float = 0.3, decay: float = 1e-5, pair_decay: float = 1e-3) -> Field:
    """Weights of the field by pseudo-likelihood: every node's label given its features and the labels of its neighbours.

    Feature and pair weights are fitted together, by adaptive gradient steps over all rows;
    a pair weight is the same in both directions.
    """
    labels = np.array([r[0] for r in rows], np.int64)
    cells = np.array([r[1] for r in rows], np.int64).reshape(-1, FEATURES)
    met = np.zeros((2, len(rows), LABELS))
    for i, row in enumerate(rows):
        for kind in (0, 1):
            for label in row[2 + kind]:
                met[kind, i, label] += 1
    unary = np.zeros((DIMENSIONS, LABELS))
    unary[:, OTHER] = 0.1
    pairs = np.zeros((2, LABELS, LABELS))
    squares, pair_squares = np.full(unary.shape, 1e-8), np.full(pairs.shape, 1e-8)
    for _ in range(rounds if len(rows) else 0):
        scores = unary[cells].sum(axis=1) + met[0] @ pairs[0] + met[1] @ pairs[1]
        shares = np.exp(scores - scores.max(axis=1, keepdims=True))
        shares /= shares.sum(axis=1, keepdims=True)
        shares[np.arange(len(labels)), labels] -= 1
        gradient = decay * unary
        for k in range(FEATURES):
            for label in range(LABELS):
                gradient[:, label] += np.bincount(cells[:, k], shares[:, label], DIMENSIONS) / len(labels)
        one_way = np.stack([met[kind].T @ shares / len(labels) for kind in (0, 1)])
        pair_gradient = one_way + one_way.transpose(0, 2, 1) + pair_decay * pairs
        squares += gradient**2
        pair_squares += pair_gradient**2
        unary -= rate * gradient / np.sqrt(squares)
        pairs -= rate * pair_gradient / np.sqrt(pair_squares)
    return Field(unary, pairs[0], pairs[1])


def made_texts(n: int, seed: int) -> Iterator[tuple[str, list[tuple[int, int, int]]]]:
    """``n`` made-up texts by a seed, each with its spans (start, kind, end): personal data in base and other forms, and numbers that are none.

    What was named with its context once is often repeated without.
    """
    rng = random.Random(seed)
    number = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    draw = lambda letters, k: "".join(rng.choice(letters) for _ in range(k))
    syllables = ("an", "ti", "on", "er", "st", "re", "ou", "le", "en", "th", "in", "de", "che", "ver", "mo", "la", "ñado", "ü", "é")
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    prose = lambda a=1, b=7: " ".join(word() for _ in range(rng.randint(a, b)))

    def checked(k: int) -> str:
        body = number(k - 1)
        return next(body + d for d in "0123456789" if luhn(body + d))

    def email() -> str:
        user = rng.choice((word(), f"{word()}.{word()}", f"{word()}{number(2)}")).encode("ascii", "ignore").decode() or "joe"
        host, top = rng.choice(("example", "mail", "web", "post")) + rng.choice(("", number(1))), rng.choice(("com", "org", "net", "de", "fr", "es"))
        return rng.choice((f"{user}@{host}.{top}", f"{user}@{host}.{top}", f"{user}(at){host}.{top}", f"{user} [at] {host}.{top}", f"{user} [at] {host} [dot] {top}", f"{user} (at) {host} (punkt) {top}"))

    def ip() -> str:
        four = ".".join(str(rng.randint(0, 255)) for _ in range(4))
        six = ":".join(draw("0123456789abcdef", rng.randint(1, 4)) for _ in range(8))
        return rng.choice((four, four, six, f"2001:db8::{draw('0123456789abcdef', 4)}", f"fe80::{draw('0123456789abcdef', 3)}:{draw('0123456789abcdef', 4)}"))

    def card() -> str:
        plain = rng.choice("345") + number(14)
        plain = next(plain + d for d in "0123456789" if luhn(plain + d))
        return rng.choice((plain, plain, checked(13), " ".join(plain[k : k + 4] for k in range(0, 16, 4)), "-".join(plain[k : k + 4] for k in range(0, 16, 4)), ".".join(plain[k : k + 4] for k in range(0, 16, 4))))

    def phone() -> str:
        area, own = rng.choice(("030", "040", "0171", "0611", "01", "06")), number(rng.randint(6, 8))
        return rng.choice((
            f"+1 ({number(3)}) {number(3)}-{number(4)}", f"+49 {area[1:]} {own}", f"+33 {number(1)} {' '.join(number(2) for _ in range(4))}", f"+{number(11)}",
            f"{area} {own}", f"{area}-{own}", f"({area}) {own[:3]}-{own[3:]}", f"{area}/{own}", f"{number(3)}-{number(3)}-{number(4)}", f"({number(3)}) {number(3)}-{number(4)}",
            f"{area[:2]} {' '.join(number(2) for _ in range(4))}", f"00{rng.choice(('49', '33', '34'))} {number(2)} {own}",
        ))

    makers = (email, ip, card, phone)
    leads = (
        ("mail", "e-mail:", "email", "write to", "contact:", "Kontakt:", "correo", ""), ("ip", "host", "from", "server", "address:", "login from", ""),
        ("card", "card number", "visa", "Karte", "credit card:", "tarjeta", "carte", "pay with", ""), ("call", "tel", "Tel.:", "phone", "mobile", "fax", "Telefon", "teléfono", "téléphone", "reach me on", "ring"),
    )
    noise = (
        lambda: f"{rng.randint(1990, 2030)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}", lambda: f"{rng.randint(1, 28):02d}.{rng.randint(1, 12):02d}.{rng.randint(1990, 2030)}",
        lambda: f"{rng.randint(0, 23):02d}:{number(2)}:{number(2)}", lambda: f"{rng.choice(('order', 'invoice', 'no.', 'Nr.', 'ref', 'id', 'ticket', 'pedido'))} {number(rng.randint(4, 14))}", lambda: f"978-{number(1)}-{number(2)}-{number(6)}-{number(1)}",
        lambda: f"version {number(1)}.{number(1)}.{number(1)}", lambda: number(rng.randint(1, 6)), lambda: f"{number(1)}.{number(3)},{number(2)}", lambda: rng.choice(("AKIA", "")) + draw("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16),
        lambda: f'token = "{draw("0123456789abcdef", 40)}"', lambda: f"password={draw('0123456789abcdef', 18)}", lambda: f"section {number(1)}.{number(1)}", lambda: f"{rng.randint(1900, 2000)}-{rng.randint(2001, 2030)}",
        lambda: f"{number(2)} kg", lambda: f"{number(3)} {number(3)} {rng.choice(('EUR', 'people', 'km'))}", lambda: f"1{number(12)} ms", lambda: ":".join(draw("0123456789abcdef", 2) for _ in range(6)), lambda: f"{rng.choice(('page', 'line', 'Seite'))} {number(3)}",
        lambda: f"@{word()}{number(2)}", lambda: f"{number(2)}-{number(2)}-{number(2)}", lambda: f"CC BY {number(1)}.0.", lambda: "-".join(draw("0123456789abcdef", k) for k in (8, 4, 4, 4, 12)), lambda: f"{prose(1, 1)} (at) {prose(1, 2)}",
    )
    for _ in range(n):
        text, spans, known = prose(0, 5), [], []

        def put(kind: int, own: str) -> None:
            nonlocal text
            text += " " if text else ""
            spans.append((len(text), kind, len(text) + len(own)))  # noqa: B023
            text += own

        for _ in range(rng.randint(1, 6)):
            turn = rng.random()
            if turn < 0.4:
                text += f" {rng.choice(noise)()}"
            elif turn < 0.5 and known:
                put(*rng.choice(known))
            elif turn < 0.6:
                for kind in rng.choice(((0, 3, 2), (3, 2), (0, 3), (3, 1), (2, 1))):
                    put(kind, makers[kind]())
            else:
                kind = rng.randrange(len(KINDS))
                own = makers[kind]()
                text += f" {rng.choice(leads[kind])}".rstrip()
                put(kind, own)
                known.append((kind, own))
            text += rng.choice((" ", ", ", ". ", " and ", " y ", " und ")) + prose(1, 5)
        yield text, spans


def beliefs(unary: np.ndarray, edges: np.ndarray, kinds: np.ndarray, field: Field, rounds: int = ROUNDS) -> np.ndarray:
    """Marginals of the nodes after ``rounds`` of damped loopy message passing along all edges at once.

    ``edges`` are pairs of nodes of any number of documents side by side; no edge joins two.
    """
    n = len(unary)
    if len(edges):
        sender = np.concatenate([edges[:, 0], edges[:, 1]])
        receiver = np.concatenate([edges[:, 1], edges[:, 0]])
        weights = np.where(np.concatenate([kinds, kinds])[:, None, None] == 0, field.chain[None], field.skip[None])
        back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
        messages = np.zeros((len(sender), LABELS))
        for _ in range(rounds):
            total = unary + np.stack([np.bincount(receiver, messages[:, k], n) for k in range(LABELS)], axis=1)
            cavity = total[sender] - messages[back]
            joint = cavity[:, :, None] + weights
            top = joint.max(axis=1, keepdims=True)
            new = np.log(np.exp(joint - top).sum(axis=1)) + top[:, 0]
            messages = DAMPING * messages + (1 - DAMPING) * (new - new.max(axis=1, keepdims=True))
        unary = unary + np.stack([np.bincount(receiver, messages[:, k], n) for k in range(LABELS)], axis=1)
    shares = np.exp(unary - unary.max(axis=1, keepdims=True))
    return shares / shares.sum(axis=1, keepdims=True)


def plausible(kind: int, word: str) -> bool:
    """What a span of the field must have at least, besides the field's certainty."""
    digits = "".join(DIGIT.findall(word))
    if kind == 0:
        at, marks = word.find("@"), MARKER.findall(word)
        return bool(re.search("[A-Za-z]", word)) and (0 < at < word.rfind(".") or (bool(marks) and MARKER.match(word) is None and ("." in word or len(marks) > 1)))
    if kind == 1:
        four = re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", word)
        return all(int(x) <= 255 for x in word.split(".")) if four else re.fullmatch(r"(?i)[0-9a-f:]{6,39}", word) is not None and (word.count("::") == 1 or word.count(":") == 7) and max(map(len, word.split(":"))) <= 4
    if kind == 2:
        return luhn_holds(digits) and re.fullmatch(r"[0-9][0-9 .-]*", word) is not None
    return 8 <= len(digits) <= 15 and re.fullmatch(r"[+(]{0,2}[0-9][0-9 ().\-/]*", word) is not None


def field_spans(text: str, nodes: list[tuple[int, int, str, int]], marginals: np.ndarray, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans that the field adds: neighbouring tokens of one certain label, outside the base spans, that look like their kind.

    Only an address in words, a card and a phone number go on over several tokens.
    """
    out, k, label = [], 0, marginals.argmax(axis=1)
    sure = marginals.max(axis=1) >= CERTAIN

    def goes_on(a: int, b: int) -> bool:
        return nodes[b][3] == nodes[a][3] + 1 and bool(sure[b]) and label[a] == label[b] and (label[a] >= 2 or (label[a] == 0 and bool(MARKER.fullmatch(nodes[a][2]) or MARKER.fullmatch(nodes[b][2]))))

    while k < len(nodes):
        j = k + 1
        if sure[k] and label[k] != OTHER:
            while j < len(nodes) and goes_on(j - 1, j):
                j += 1
            start, end = nodes[k][0], nodes[j - 1][1]
            if plausible(int(label[k]), text[start:end]) and not any(s < end and start < e for s, _, e in base):
                out.append((start, int(label[k]), end))
        k = j
    return out


FOUND = "n_email long, n_ip long, n_card long, n_phone long, base string, spans string"


def find_personal_data(docs: DataFrame, field: Field, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` (text and others), the numbers of base spans of each kind, and ``base`` and ``spans``.

    Both hold kind:start:end in order of start, then of kind, joined by commas, in code points,
    the end exclusive; ``spans`` has the base spans and those that the field adds.

    A null or empty text has no spans; other nulls don't matter; repeated rows give a row
    each; an empty table gives no rows; columns of ``keep`` named like a new one are dropped.
    """
    new = [x.split()[0] for x in FOUND.split(", ")]
    keep = [c for c in keep if c not in (*new, "_text")]
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def written(spans: list[tuple[int, int, int]]) -> str:
        return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(spans))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in whole_batches(batches, 16 << 20):
            texts = batch.column("_text").to_pylist()
            bases, parts, starts, unary, edges, kinds = [], {}, {}, [], [], []
            n = 0
            for k, text in enumerate(texts):
                bases.append(base_spans(text) if text else [])
                if not text:
                    continue
                nodes, cells = tokens_of(text)
                if not nodes:
                    continue
                parts[k], starts[k] = nodes, n
                unary.append(own.unary[np.array(cells)].sum(axis=1))
                for kind, pairs in enumerate(same_kind_edges(nodes)):
                    edges += [(a + n, b + n) for a, b in pairs]
                    kinds += [kind] * len(pairs)
                n += len(nodes)
            spans = list(bases)
            if n:
                marginals = beliefs(np.concatenate(unary), np.array(edges, np.int64).reshape(-1, 2), np.array(kinds, np.int64), own)
                for k, nodes in parts.items():
                    spans[k] = bases[k] + field_spans(texts[k], nodes, marginals[starts[k] : starts[k] + len(nodes)], bases[k])
            counts = [pa.array([sum(x[1] == kind for x in b) for b in bases], pa.int64()) for kind in range(len(KINDS))]
            columns = [batch.column(c) for c in keep] + counts + [pa.array([written(b) for b in bases], pa.string()), pa.array([written(s) for s in spans], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *new])

    # Texts without a digit or an @ have no token of interest and stay outside Python.
    hinted = F.when(F.col("text").cast("string").rlike(HINT), F.col("text").cast("string"))
    rows = docs.select(*keep, hinted.alias("_text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text"] + [FOUND])
    return rows.mapInArrow(find, schema)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in the whole ``documents`` table."""
    docs = table(spark, sf_dir, "documents")
    found = find_personal_data(docs, fit(docs), keep=["doc_id"])
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans", (F.col("spans") != "").alias("personal"))
