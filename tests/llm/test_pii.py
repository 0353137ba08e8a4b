import random
import re

import pytest

from tests.llm.cases import clashing, docs
from tidemark.llm import pii

BASE = (
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"),
    re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def brute(text):
    out = []
    for kind, pattern in enumerate(BASE):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            good = (True, all(int(p) <= 255 for p in m.group().split(".") if p) if kind == 1 else True, 14 <= len(digits) <= 19 and pii.luhn(digits), 10 <= len(digits) <= 15)[kind]
            if good:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans_match_the_plain_patterns():
    rng = random.Random(1)
    for _ in range(4000):
        text = "".join(rng.choice(["a", "B", "1", "25", "4", "0", ".", "@", "-", "+", " ", "(", ")", "_", "%", "é", "😀", "4929", "\n"]) for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(text) == brute(text), text
    for digits in ("4337166598464399", "4337 1665-9846 4399", "40418949746087"):
        assert pii.base_spans(f"x {digits} y") == brute(f"x {digits} y")


@pytest.fixture(scope="module")
def field(spark, sf_dir):
    return pii.fit(spark.read.parquet(f"{sf_dir}/documents.parquet").unionByName(spark.read.parquet(sf_dir.replace("sf0.001", "sf0.01") + "/documents.parquet")))


def found(spark, field, rows):
    got = pii.find_personal_data(docs(spark, [(k, t, None, None, None) for k, t in enumerate(rows)]), field, keep=["doc_id"])
    return {r.doc_id: r for r in got.collect()}


def test_the_field_adds_a_repeated_number_and_leaves_others(spark, field):
    text = "Call me at +1 (988) 555-2485 any day. Words between them are many. Again, that is (988) 555-2485 and no other."
    got = found(spark, field, [text, "Version 2.10 of page 17 in 1998 has 350 lines.", "nothing here"])
    extra = [s for s in got[0].spans.split(",") if s not in got[0].base.split(",")]
    assert got[0].n_phone == 1 and got[1].spans == "" and got[2].spans == ""
    for s in extra:
        kind, start, end = s.split(":")
        assert kind == "phone" and text[int(start) : int(end)].strip("()") in "(988) 555-2485"


#: Written by hand, apart from the texts that the field is trained on: what it must find beyond the base forms, and what it must leave.
OTHER_FORMS = [
    ("Reach the office at jane.doe [at] firm [dot] org before noon.", ["email:jane.doe [at] firm [dot] org"]),
    ("Write to press(at)museum-shop.co.uk for details.", ["email:press(at)museum-shop.co.uk"]),
    ("Our number is 0621 4432189, ask for Mia. Once more: 0621 4432189", ["phone:0621 4432189", "phone:0621 4432189"]),
    ("See erntou +1 (269) 555-3296 4524132264652876 and on", ["phone:+1 (269) 555-3296", "card:4524132264652876"]),
    ("They paid with 4222222222222 yesterday.", ["card:4222222222222"]),
    ("The server 2001:db8:85a3::8a2e:370 is down again.", ["ip:2001:db8:85a3::8a2e:370"]),
    ("Rufen Sie 089/1234567 an, bitte.", ["phone:089/1234567"]),
    ("tel. 06 12 34 56 78 ou le soir.", ["phone:06 12 34 56 78"]),
    ("Fax (040) 365-2201, Herr Braun.", ["phone:(040) 365-2201"]),
]
CLEAN = [
    "In 2023-04-05 12:30:11 we sold 120 units, ref 20231144556, ISBN 978-3-16-148410-0.", "Version 10.2.3 of 1995-1998, see chapter 12.4 and 14:22, price 1.200,50 EUR.",
    "Let us meet (at) noon, please.", "MAC 00:1a:2b:3c:4d:5e, build 7f3a9c, about 1,500 people on 12 May 1987.", "The commit 0641917ea4e9feb9cda83477b57ac2654884f485 of page 17 has 350 lines.",
    "Invoice 100200300 of 03.11.2021 over 45 kg.", "Follow @ana77 there.",
]


def test_other_forms_are_found_and_clean_texts_left_alone(spark, field):
    got = found(spark, field, [t for t, _ in OTHER_FORMS] + CLEAN)
    right = wanted = 0
    for k, (text, want) in enumerate(OTHER_FORMS):
        have = [f"{kind}:{text[int(a) : int(b)]}" for kind, a, b in (x.split(":") for x in got[k].spans.split(",") if x)]
        wanted += len(want)
        right += sum(w in have for w in want)
        assert got[k].base == "" and set(have) <= set(want), (text, have)
    assert right >= 0.9 * wanted
    assert all(got[len(OTHER_FORMS) + k].spans == "" for k in range(len(CLEAN)))


def test_training_learns_features_and_pairs_together():
    """Two labels that the features tell in half of the nodes; the others are told by their neighbours alone."""
    import numpy as np

    rng, rows = random.Random(4), []
    pad = list(range(100, 100 + pii.FEATURES - 1))
    for _ in range(300):
        label = rng.choice((0, 3))
        rows.append((label, [label, *pad], [label], []))
        rows.append((label, [50, *pad], [label], []))
    field = pii.train(rows)
    assert field.chain[0, 0] > field.chain[0, 3] and np.allclose(field.chain, field.chain.T)
    unary = field.unary[np.array([[3, *pad], [50, *pad]])].sum(axis=1)
    assert pii.beliefs(unary, np.array([[0, 1]]), np.array([0]), field).argmax(axis=1).tolist() == [3, 3]


def test_fit_gives_the_same_field_again(spark, sf_dir):
    import numpy as np

    docs_ = spark.read.parquet(f"{sf_dir}/documents.parquet")
    one, two = pii.fit(docs_, sample_docs=50, made=200), pii.fit(docs_.repartition(5), sample_docs=50, made=200)
    assert np.array_equal(one.unary, two.unary) and np.array_equal(one.chain, two.chain) and np.array_equal(one.skip, two.skip)


def test_messages_reach_agreement_across_a_skip_edge():
    import numpy as np

    skip = np.full((pii.LABELS, pii.LABELS), -1.0)
    np.fill_diagonal(skip, 2.0)
    field = pii.Field(np.zeros((1, pii.LABELS)), np.zeros((pii.LABELS, pii.LABELS)), skip)
    unary = np.zeros((2, pii.LABELS))
    unary[0, 3] = 6.0
    alone = pii.beliefs(unary, np.zeros((0, 2), int), np.zeros(0, int), field)
    tied = pii.beliefs(unary, np.array([[0, 1]]), np.array([1]), field)
    assert alone[1, 3] < 0.3 and tied[1, 3] > 0.7
    exact = np.exp(unary[0][:, None] + unary[1][None, :] + skip)
    assert np.allclose(tied[1], exact.sum(axis=0) / exact.sum(), atol=1e-3)


def test_awkward_rows(spark, field):
    got = pii.find_personal_data(clashing(docs(spark)), field, keep=["doc_id", "base", "kept"]).collect()
    assert len(got) == 14 and all(r.spans == "" for r in got if r.doc_id in (4, 5, 6))
    assert pii.find_personal_data(docs(spark, []), field, keep=["doc_id"]).collect() == []
    empty = pii.fit(docs(spark, []))
    assert found(spark, empty, ["a@b.cd 555"])[0].n_email == 1
    long = "1" * 300_000 + " " + "a" * 300_000 + "@" + "+" * 1000
    assert found(spark, field, [long])[0].n_email == 0
