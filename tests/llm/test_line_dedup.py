import random
import re

import pyarrow as pa

from tests.llm.cases import clashing, docs
from tidemark.llm import line_dedup


def lines(text):
    return [x for x in re.split(r"(?<=\n)(?!\n)|(?<=[.!?] )(?![ \n])", text or "") if x]


def passage(rng, n=8):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) + " " + " ".join("".join(rng.choice("klmnop") for _ in range(4)) for _ in range(8)) + "." for _ in range(n))


def run(spark, rows):
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    return {r.doc_id: r for r in got}


def test_later_passages_go_and_first_ones_stay(spark):
    rng = random.Random(2)
    shared = passage(rng)
    rows = [(k, f"{passage(rng, 3)}\n{shared}\n{passage(rng, 3)}") for k in range(6)]
    rows += [(k, passage(rng, 9)) for k in range(6, 12)]
    got = run(spark, rows)
    assert [shared in got[k].text for k in range(6)] == [True, False, False, False, False, False]
    for k, text in rows:
        own = got[k]
        cut = {i for r in own.runs or [] for i in range(r["from"], r["to"])}
        assert own.text == "".join(x for i, x in enumerate(lines(text)) if i not in cut) and own.n_cut == len(cut)
        assert k < 1 or k > 5 or own.n_cut == 8
    assert all(got[k].n_cut == 0 for k in range(6, 12))


def test_every_long_run_is_found_by_brute_force(spark):
    rng = random.Random(9)
    pool = [passage(rng, 1) for _ in range(60)]
    rows = [(k, " ".join(rng.choice(pool) if rng.random() < 0.1 else passage(rng, 1) for _ in range(12))) for k in range(30)]
    for k in range(10, 30):  # runs of three to six lines of an earlier document, behind words of their own
        source = lines(rows[rng.randrange(k)][1])
        at, n = rng.randrange(len(source) - 6), rng.randint(3, 6)
        rows[k] = (k, rows[k][1] + " " + "".join(source[at : at + n]).strip())
    got = run(spark, rows)
    seen: dict[tuple, int] = {}
    for k, text in rows:
        bare = [x.strip().lower() for x in lines(text)]
        cut = {i for r in got[k].runs or [] for i in range(r["from"], r["to"])}
        for i in range(len(bare) - 2):
            if tuple(bare[i : i + 3]) in seen:
                assert {i, i + 1, i + 2} <= cut, (k, i)
        for i in cut:  # what is cut stands earlier with a neighbour of its run
            assert any(tuple(bare[j : j + 2]) in seen for j in (i - 1, i) if j >= 0 and j + 2 <= len(bare)) or (bare[i],) in seen
        for n in (1, 2, 3):
            for i in range(len(bare) - n + 1):
                seen.setdefault(tuple(bare[i : i + n]), k)


def test_repeats_within_a_document(spark):
    got = run(spark, [(1, "\n".join(["Anble anes."] * 300)), (2, "short line.\nshort line.\nother words here.")])
    assert got[1].n_cut == 299 and got[1].text == "Anble anes.\n" and got[2].n_cut == 0


def test_awkward_rows(spark):
    got = line_dedup.dedup_lines(clashing(docs(spark))).collect()
    assert len(got) == 14
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert by[2][0].text == "" and by[1][0].n_cut == by[1][1].n_cut == 0 and by[5][0].text is None
    kept = line_dedup.keep_first_passages(clashing(docs(spark)))
    assert kept.columns == clashing(docs(spark)).columns and 2 not in {r.doc_id for r in kept.collect()}
    assert line_dedup.dedup_lines(docs(spark, [])).collect() == []


def expected(rows, min_words):
    """The lines to cut of each document, by comparing every run of lines with all before it."""
    seen, out = set(), {}
    for k, text in rows:
        bare = [(i, x.strip(" \t\n\r\x0b\f").lower()) for i, x in enumerate(lines(text))]
        bare = [(i, x) for i, x in bare if x]
        cut = set()
        for a in range(len(bare)):
            for b in range(a + 1, len(bare) + 1):
                run = tuple(x for _, x in bare[a:b])
                if sum(len(x.split(" ")) for x in run) >= min_words:
                    if run in seen:
                        cut |= set(range(bare[a][0], bare[b - 1][0] + 1))
                    seen.add(run)
        out[k] = cut
    return out


def cut_of(row):
    return {i for r in row.runs or [] for i in range(r["from"], r["to"])}


def test_early_short_stretches_hide_no_longer_run(spark):
    rng = random.Random(5)
    run_of = [passage(rng, 1) for _ in range(7)]
    rows = [(k, f"{passage(rng, 1)} {run_of[k]} {run_of[k + 1]} {passage(rng, 1)}") for k in range(6)]  # 18 words of the run each
    rows += [(k, f"{passage(rng, k - 6)} {' '.join(run_of)} {passage(rng, 1)}") for k in (7, 8)]
    got = run(spark, rows)
    assert [got[k].n_cut for k, _ in rows] == [0, 0, 0, 0, 0, 0, 0, 7] and cut_of(got[8]) == set(range(2, 9))


def test_the_cut_is_that_of_brute_force(spark):
    rng = random.Random(31)
    pool = [" ".join(rng.choice("abcdef") * 2 for _ in range(rng.choice((1, 2, 3, 5, 9, 14, 26)))) + "." for _ in range(14)]
    rows = [(k, "".join(rng.choice(pool) + rng.choice((" ", " ", "\n", "\n\n", "\n \n")) for _ in range(rng.randint(1, 14)))) for k in range(60)]
    got = run(spark, rows)
    assert {k: cut_of(got[k]) for k, _ in rows} == expected(rows, 25)


def test_copies_with_other_white_space(spark):
    rng = random.Random(8)
    shared = [passage(rng, 1) for _ in range(5)]
    cells = ["\t".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(30)) for _ in range(2)]
    rows = [(1, "\n".join(shared) + "\nfirst"), (2, "second\n" + "\r\n".join(shared) + "\r\n"), (3, "third\n" + "".join(f"\t{x}\x0b\f\n" for x in shared))]
    rows += [(4, "\r\n\r\n".join(shared)), (5, f"fifth\n{cells[0]}\n"), (6, f"{cells[1]}\n{cells[0]}\n"), (7, "a mark \0 here. " + "\r\n".join(shared))]
    got = run(spark, rows)
    assert [got[k].text for k, _ in rows] == [rows[0][1], "second\n", "third\n", "", rows[4][1], f"{cells[1]}\n", "a mark \0 here. "]


def test_number_of_lines(spark):
    texts = ["", None, "one", "one. two", "one. two. ", "one.  two.\n\nthree! four?\n", "\n", " \n \n", ". . \n. ", "a\0b. c\nd", "\0"]
    got = run(spark, list(enumerate(texts)))
    assert [got[k].n_lines for k in range(len(texts))] == [len(lines(x)) for x in texts]
    by = {r.doc_id: r for r in line_dedup.dedup_lines(clashing(docs(spark))).collect()}
    assert by[5].n_lines == 0 and by[4].n_lines == 0


def test_passages_behind_words_without_a_full_stop(spark):
    rng = random.Random(12)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    single = f"{words(6)}, {words(20)}; {words(9)}: {words(20)}, {words(5)}"
    rows = [(1, f"{words(9)}. {single}. {words(9)}."), (2, f"{words(9)} {single} {words(9)}.")]
    two = [f"{words(12)}. {words(13)}." for _ in range(20)]  # 25 words in two lines
    rows += [(3 + k, f"{words(9)}. {x} {words(9)}.") for k, x in enumerate(two)] + [(30 + k, f"{words(9)}. {x} {words(9)}.") for k, x in enumerate(two)]
    got = run(spark, rows)
    assert [got[k].n_cut for k in (1, 2)] == [0, 3]
    assert [got[3 + k].n_cut for k in range(20)] == [0] * 20 and [got[30 + k].n_cut for k in range(20)] == [2] * 20


def brute(rows, min_words=25):
    """For each distinct (doc_id, text), in order, the numbers of the lines inside a run of ``min_words`` words that stands earlier."""
    seen, out = set(), {}
    for doc, text in sorted({r for r in rows if r[1]}):
        parts = [x for x in re.split(r"(?<=\n)(?!\n)|(?<=[.!?,;:] )(?![ \n])", text) if x]
        bare = [re.sub(r"[\t\r\x0b\x0c]", " ", x.lower()).strip(" \n") for x in parts]
        own = [(i, x, x.count(" ") + 1) for i, x in enumerate(bare) if x]
        cut = set()
        for i in range(len(own)):
            words = 0
            for j in range(i, len(own)):
                words += own[j][2]
                if words >= min_words:
                    key = tuple(x for _, x, _ in own[i : j + 1])
                    if key in seen:
                        cut |= set(range(own[i][0], own[j][0] + 1))
                    seen.add(key)
        out[doc, text] = (parts, cut)
    return out


def test_cuts_are_those_of_brute_force(spark):
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    line = lambda: " ".join(word() for _ in range(rng.choice((1, 1, 2, 5, 9, 30)))) + rng.choice((". ", ", ", "\n", "; ", "\n\n", "\t\n"))
    pool = [line() for _ in range(25)]
    rows = [(k, "".join(rng.choice(pool) if rng.random() < 0.8 else line() for _ in range(rng.randrange(30)))) for k in range(40)]
    for k in range(40, 60):
        a, b = rng.choice(rows)[1], rng.choice(rows)[1]
        rows.append((k, line() + a[: rng.randrange(len(a) + 1)] + line() + b[rng.randrange(len(b) + 1) :]))
    want = brute(rows)
    for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect():
        parts, cut = want.get((r.doc_id, rows[r.doc_id][1]), ([], set()))
        assert {i for x in r.runs or [] for i in range(x["from"], x["to"])} == cut and r.n_lines == len(parts), r.doc_id


def test_hot_fingerprints_and_shuffled_joins_change_nothing(spark, monkeypatch):
    rng = random.Random(22)
    common = passage(rng, 3)
    rows = [(k, f"{passage(rng, 1)}\n{common}\n{passage(rng, 1)}") for k in range(40)]
    want = {k: (r.text, r.n_cut) for k, r in run(spark, rows).items()}
    monkeypatch.setattr(line_dedup, "LEAST_HOT", 3)
    monkeypatch.setattr(line_dedup, "MOST_HOT", 1_000_000)
    monkeypatch.setattr(line_dedup, "MOST_BROADCAST_BYTES", 0)
    assert {k: (r.text, r.n_cut) for k, r in run(spark, rows).items()} == want
    assert sum(n == 3 for _, n in want.values()) == 39


def test_windows_of_texts_are_those_of_plain_loops():
    rng = random.Random(3)
    texts = ["".join(rng.choice(("a b c. ", "dd, ", "x\n", "\t\n", "e f  g; ", "h" * 9 + "\n\n")) for _ in range(rng.randrange(12))) for _ in range(50)] + ["a\0b. c d e f", "q. " * 7]
    got = {r["_id"]: r for r in line_dedup.windows_of(pa.array(range(52)), pa.array(range(52)), [x.encode() for x in texts], 4).to_pylist()}
    seen = {}
    for k, text in enumerate(texts):
        own = [(i, x) for i, x in enumerate(b.decode() for b in line_dedup.bare_lines(text.encode())) if x]
        ends = [next((e for e in range(i + 1, len(own) + 1) if sum(x.count(" ") + 1 for _, x in own[i:e]) >= 4), None) for i in range(len(own))]
        ns = [e - i for i, e in enumerate(ends) if e]
        assert (k in got) == bool(ns)
        if ns:
            assert got[k]["ns"] == ns and got[k]["nexts"] == [*ns[1:], None] and got[k]["places"] == [i for i, _ in own]
            for i, n in enumerate(ns):  # equal windows, and no others, have equal fingerprints, keys and places of them
                run_of = tuple(x for _, x in own[i : i + n])
                told = tuple(got[k][c][i] for c in ("fingerprints", "keys", "offs"))
                assert seen.setdefault(run_of, told) == told
                assert max(x.count(" ") for x in run_of) == run_of[told[2]].count(" ")
    assert len({f for f, *_ in seen.values()}) == len(seen)


def test_no_python_runs_on_executors(spark, monkeypatch):
    plans, write = [], line_dedup.materialise
    monkeypatch.setattr(line_dedup, "materialise", lambda df, name: plans.append(df) or write(df, name))
    rng = random.Random(4)
    shared = passage(rng)
    rows = spark.createDataFrame([(k, f"{passage(rng, 1)}\n{shared}", "a") for k in range(3)], "doc_id long, text string, lang string")
    plans.append(line_dedup.keep_first_passages(spark.createDataFrame(rows.toPandas())))
    told = [df._jdf.queryExecution().executedPlan().toString() for df in plans]
    assert len(told) > 3 and not [x for x in told if re.search("Arrow|Pandas|Python(?!RDD)|BatchEval", x)]


def short_lines(rng, n):
    words = lambda k: " ".join(rng.choice(("ab", "cd", "ef")) for _ in range(k))
    return "".join(words(rng.choice((1, 1, 1, 1, 2, 3, 24))) + rng.choice((". ", "\n", ", ", "\n \n")) for _ in range(n))


def test_windows_are_those_of_texts_in_hand(spark):
    rng = random.Random(17)
    texts = [short_lines(rng, rng.randrange(1, 45)) for _ in range(60)] + ["a.\n" * 40, "a.\n" * 24, "a b. " * 13, "x " * 30]
    for most in (1, 4, 25, 40):
        want = {r["_id"]: r for r in line_dedup.windows_of(pa.array(range(len(texts))), pa.array(range(len(texts))), [x.encode() for x in texts], most).to_pylist()}
        lines = line_dedup.hashed_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
        places = {r["_id"]: r.places or list(range(len(r.hashes))) for r in lines.collect()}
        got = {(r["_id"], r.pos): r for r in line_dedup.shortest_windows(lines, most).where("n is not null").collect()}
        assert {(k, i): n for k, r in want.items() for i, n in enumerate(r["ns"])} == {at: r.n for at, r in got.items()}
        selected, told = {}, {}
        for k, r in want.items():
            own = [x for x in line_dedup.bare_lines(texts[k].encode()) if x]
            assert places[k] == r["places"]
            for i, (n, following) in enumerate(zip(r["ns"], r["nexts"])):
                w = got[k, i]
                assert n + w.several - 1 == max(n, len(own) - i if following is None else following)
                assert 0 <= w.off < n and selected.setdefault(tuple(own[i : i + n]), (w.key, w.off)) == (w.key, w.off)
                for j in range(w.several):
                    run_of, f = tuple(own[i : i + n + j]), w.hashed[w["at"] - 1 + j]
                    assert told.setdefault(run_of, f) == f
        assert len(set(told.values())) == len(told)


def test_runs_of_short_lines_go_as_by_brute_force(spark):
    rng = random.Random(23)
    rows = [(k, short_lines(rng, rng.randrange(40))) for k in range(30)]
    for k in range(30, 60):  # parts of earlier texts, at the end or before other lines
        a = rng.choice(rows)[1]
        at = rng.randrange(len(a) + 1)
        rows.append((k, short_lines(rng, 3) + a[at : at + rng.randrange(400)] + (short_lines(rng, 12) if rng.random() < 0.5 else "")))
    want, several = brute(rows), 0
    for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect():
        parts, cut = want.get((r.doc_id, rows[r.doc_id][1]), ([], set()))
        assert cut_of(r) == cut and r.n_lines == len(parts) and (r.text or "") == "".join(x for i, x in enumerate(parts) if i not in cut), r.doc_id
        several += bool(cut)
    assert several > 5
