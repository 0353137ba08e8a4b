from tests.llm.cases import clashing, docs
from tidemark.llm import license_scan as L

KNOWN = "licence string, text string"


def scan(spark, rows, known=L.KNOWN_LICENCES):
    got = L.scan_licences(docs(spark, [(k, t, None, None, None) for k, t in rows]), spark.createDataFrame(list(known), KNOWN)).collect()
    return {r.doc_id: (r.licence, r.notices, r.n_notices) for r in got}


def test_whole_texts_in_other_clothes(spark):
    mit = dict((n, t) for n, t in L.KNOWN_LICENCES if t.startswith("MIT License"))["MIT"]
    rows = [
        (1, "Copyright (c) 1999-2020 Some One\nAll rights reserved.\n\n" + mit.upper()), (2, mit.replace("license", "licence").replace("\n", " \r\n  ").replace(",", " ,") + "\n"),
        (3, mit + " More words."), (4, "Text.\n licensed under the APACHE licence, version 2.0\nAll rights reserved."), (5, "All rights reserved."), (6, "© 2020 Someone"),
    ]
    got = scan(spark, rows)
    assert got[1][0] == got[2][0] == "MIT" and got[3][0] is None
    assert got[4] == (None, ["All-rights-reserved", "Apache-2.0"], 2) and got[5][0] == "All-rights-reserved" and got[6] == (None, [], 0)


def test_awkward_rows(spark):
    known = spark.createDataFrame([("Z", "one two three four"), ("A", "One, two; three four!"), (None, "x"), ("E", None), ("F", " . ")], KNOWN)
    got = L.scan_licences(clashing(docs(spark)), known).collect()
    assert len(got) == 14 and {r.doc_id: r.licence for r in got if r.licence} == {10: "A", 11: "A"}
    assert L.scan_licences(docs(spark, []), known).collect() == []
    assert L.scan_licences(docs(spark), known.where("false")).where("licence is not null").collect() == []


def test_a_folder_of_whole_licences(spark, tmp_path):
    texts = {"Long-1.0": " ".join(f"Clause {k} of this licence." for k in range(4000)), "Short-2.0": "Do as you like."}
    for name, text in texts.items():
        (tmp_path / f"{name}.txt").write_text(text)
    known = L.known_in_folder(spark, str(tmp_path))
    rows = docs(spark, [(1, texts["Long-1.0"].upper().replace(" ", "  "), None, None, None), (2, "do as you like", None, None, None), (3, "else", None, None, None)])
    assert {r.doc_id: r.licence for r in L.scan_licences(rows, known).collect()} == {1: "Long-1.0", 2: "Short-2.0", 3: None}


def test_more_licences_than_are_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        known = spark.range(7000).selectExpr("concat('L', id) as licence", "concat('terms number ', id) as text")
        rows = spark.range(0, 7000, 100).selectExpr("id as doc_id", "concat('Terms, NUMBER ', id) as text")
        assert all(r.licence == f"L{r.doc_id}" for r in L.scan_licences(rows, known).collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_whole_licences_of_the_folder(spark):
    held = dict(L.whole_licences())
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0"} == set(held) and all(len(t) > 6000 for t in held.values())
    changed = {n: t.replace("license", "licence").replace(",", " ,").replace("Copyright (C) 2007 Free Software Foundation", "Copyright (C) 1999 Somebody Else").upper() for n, t in held.items()}
    rows = [(k, t) for k, t in enumerate(changed.values())] + [(100 + k, t + "\nand a clause of our own") for k, t in enumerate(held.values())]
    known = spark.createDataFrame([*L.KNOWN_LICENCES, *held.items()], "licence string, text string")
    got = {r.doc_id: r.licence for r in L.scan_licences(spark.createDataFrame(rows, "doc_id long, text string"), known).collect()}
    assert [got[k] for k in range(len(held))] == list(held) and {got[100 + k] for k in range(len(held))} == {None}
