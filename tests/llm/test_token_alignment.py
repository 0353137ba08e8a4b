import collections
import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tests.llm.cases import clashing, docs
from tidemark.llm import token_alignment
from tidemark.llm.token_alignment import BYTE_FILE, PIECE_FILE, TOKENIZERS


@pytest.fixture(scope="module")
def sides():
    byte = Tokenizer.from_file(f"{TOKENIZERS}/{BYTE_FILE}")
    byte.encode_special_tokens = True
    return byte, sentencepiece.SentencePieceProcessor(model_file=f"{TOKENIZERS}/{PIECE_FILE}")


def tokens(sides, text):
    """(id, bytes) of both sides by the tokenizers' own libraries."""
    byte, piece = sides
    back = token_alignment.written_bytes()
    encoded = byte.encode(" " + text, add_special_tokens=False)
    a = [(i, bytes(back[c] for c in w)) for i, w in zip(encoded.ids, encoded.tokens, strict=True)]
    b = []
    for i in piece.encode(text):
        w = piece.id_to_piece(i)
        b.append((i, bytes([int(w[3:5], 16)]) if piece.is_byte(i) else w.replace("▁", " ").encode()))
    return a, b


def brute(sides, rows):
    """The contract's columns by walking both token lists side by side."""
    held, counts, out = [], collections.Counter(), []
    for doc, text in rows:
        a, b = tokens(sides, text) if text else ([], [])
        want = (" " + text).encode() if text else b""
        if not text or b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
            held.append((doc, [], [], [], []))
            continue
        groups, links, own_a, own_b, end_a, end_b, i, j = [], [], [], [], 0, 0, 0, 0
        while i < len(a) or j < len(b):
            if end_a <= end_b:
                own_a.append(a[i][0])
                end_a, i = end_a + len(a[i][1]), i + 1
            else:
                own_b.append(b[j][0])
                end_b, j = end_b + len(b[j][1]), j + 1
            if end_a == end_b:
                groups.append(",".join(map(str, own_a)) + "|" + ",".join(map(str, own_b)))
                links.append((own_a[-1], own_b[-1]))
                own_a, own_b = [], []
        counts.update(links)
        held.append((doc, a, b, groups, links))
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(n, best.get(b, 0))
    for doc, a, b, groups, links in held:
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((doc, len(a), len(b), len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), digest))
    return out, counts, best


PIECES = ["a", "b", " ", "  ", "\n", "\t", " ", "é", "é", "한", "😀", "<|endoftext|>", "<s>", "</s>", "'s", "'LL", "12", "½", "\x00", "​", "\r\n", "ﬁ", "▁", "<0x41>", " the", "ation", "Straße", "...", "un", "believ", "able"]


def test_matches_brute_force(spark, sides):
    rng = random.Random(3)
    rows = [(k, "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 40)))) for k in range(400)]
    rows += [(400, None), (401, ""), (None, "an unbelievable story"), (None, None), (402, "word " * 3000), (403, "x" * 20_000), (404, "\n" * 5000), (405, "same text"), (405, "same text")]
    rows += [(500 + k, "The very common passage, again.") for k in range(300)]
    want, counts, best = brute(sides, rows)
    got, pairs = token_alignment.align_tokenizers(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))
    assert {(r.a, r.b): (r["count"], r.best) for r in pairs.collect()} == {(a, b): (n, n == best[b]) for (a, b), n in counts.items()}


def test_shuffled_counts_change_nothing(spark, monkeypatch):
    rows = [(k, "one two three four five six"[: 3 + k % 20]) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, token_alignment.align_tokenizers(df)[0].collect()))
    monkeypatch.setattr(token_alignment, "MOST_BROADCAST_PAIRS", 0)
    assert sorted(map(tuple, token_alignment.align_tokenizers(df)[0].collect())) == want


def test_components_of_any_graph():
    rng = np.random.default_rng(5)
    for n, m in ((1, 0), (10, 6), (200, 90), (300, 400)):
        x, y = rng.integers(0, n, m), rng.integers(0, n, m)
        want = list(range(n))
        for _ in range(n):
            for a, b in zip(x, y, strict=True):
                want[a] = want[b] = min(want[a], want[b])
        assert token_alignment.roots_of(n, x, y).tolist() == want
    chain = np.arange(5000)
    assert set(token_alignment.roots_of(5001, chain + 1, chain).tolist()) == {0}


def test_a_vocabulary_in_another_order_uses_its_own_library(sides, tmp_path):
    import json

    with open(f"{TOKENIZERS}/{BYTE_FILE}", encoding="utf-8") as file:
        held = json.load(file)
    held["model"]["merges"] = held["model"]["merges"][:200] + held["model"]["merges"][300:]
    path = tmp_path / "other.json"
    path.write_text(json.dumps(held))
    other, text = token_alignment.ByteTokens(str(path)), " The other words of the story"
    assert "ordinary" not in str(other.encode)
    assert b"".join(other.bytes[i] for i in other.encode(text)) == text.encode()


def test_awkward_rows(spark):
    got = token_alignment.align_tokenizers(clashing(docs(spark)))[0].collect()
    assert len(got) == 14 and sorted(r.n_a for r in got)[:3] == [0, 0, 0]
    assert all((r.groups_sha256 == "") == (r.n_a == 0) and r.n_links == r.n_groups for r in got)
    none, pairs = token_alignment.align_tokenizers(docs(spark, []))
    assert none.collect() == [] and pairs.collect() == []
