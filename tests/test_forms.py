import json
import random

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import markup
from tidemark.functions.text import nfkc
from tidemark.operators import automaton, longest, sectors, segments
from tidemark.plans import registry

FORM = """만족도 조사
1. 이 프로그램에 만족하십니까?
① 매우 만족 ○ 아님
② 보통
필수 응답
Q2-1. 강사에 대해서 평가해주시기 바랍니다.
항목 | 매우 그렇다 | 그렇다 | 보통 | 아니다
강의가 알기 쉬웠다 | ○ | ○ | ○
1. 자료가 충분했다 | ○ | ○ | ○ | ○
3) 나이는?
- 20대
- 30대
선택 사항
이메일:
12
주관: 어느 기관입니다
문 7. 이 프로그램에 만족하십니까?
가. 예
나. 아니오
다. 모름
"""


def test_questions_of_a_form(spark):
    rows = [(1, FORM), (2, None), (3, ""), (4, "1. 하나입니까?\r\n- 예\r\n- 아니오"), (5, "아무 것도 없는 글")]
    got = segments.questions(spark.createDataFrame(rows, "id long, t string"), "id", "t").orderBy("id", "place").collect()
    first = [(r.number, r.title, r.required, list(r.options), r.confidence) for r in got if r.id == 1]
    assert first[0] == (7, "이 프로그램에 만족하십니까?", False, ["예", "아니오", "모름"], "medium")  # the richer list, at the first place
    assert first[1][1:4] == ("Q2-1) 강의가 알기 쉬웠다", False, ["매우 그렇다", "그렇다", "보통", "아니다"])
    assert first[2][1] == "Q2-1) 자료가 충분했다"
    assert first[3] == (3, "나이는?", False, ["20대", "30대"], "medium")
    assert first[4][1] == "이메일:" and first[4][4] == "high"
    assert not any("주관" in t for _, t, *_ in first)
    assert [(r.title, list(r.options)) for r in got if r.id == 4] == [("하나입니까?", ["예", "아니오"])]
    assert not [r for r in got if r.id in (2, 3)]
    assert segments.questions(spark.createDataFrame([], "id long, t string"), "id", "t").collect() == []


def test_an_automaton_finds_all_entries(spark):
    rng = random.Random(2)
    draw = lambda n: "".join(rng.choice("abc가나") for _ in range(n))
    words = {draw(rng.randint(1, 4)) for _ in range(150)}
    texts = [(k, draw(rng.randint(0, 60)).upper()) for k in range(80)] + [(99, None)]
    df, entries = spark.createDataFrame(texts, "id long, t string"), spark.createDataFrame([(w,) for w in [*words, "", None]], "w string")
    for r in automaton.with_hits(df, "t", entries, "w").collect():
        assert r.hits == (None if r.t is None else sorted(w for w in words if w in r.t.lower()))
    assert [r.hits for r in automaton.with_hits(df.where("id < 2"), "t", entries.where("false"), "w").collect()] == [[], []]


BODIES = [("용인시", "용인시", False), ("서울특별시", "서울특별시", False), ("한국도로공사", "한국도로공사", False), ("도로공사", "한국도로공사", True)]
TEXTS = [
    (1, "title", "한국도로공사 고객 조사"), (2, "title", "도로공사 의견"), (3, "question", "서울특별시"), (4, "title", "용인시 마을 박물관 안내"), (5, "title", "우리 동네 보건소 이용"), (6, "title", "거주 지역은 용인시 입니까"),
    (7, "option:1", "한국도로공사"), (8, "title", "민간 마케팅 보건소"), (9, "title", "서울특별시 민간 컨설팅"), (10, "title", " "), (11, "footer", "서울특별시"), (12, "title", None),
]


def bodies(spark, most, monkeypatch):
    monkeypatch.setattr(automaton, "MOST_BYTES", most)
    rows = spark.createDataFrame([(k, 0, s, t) for k, s, t in TEXTS], "id long, place int, source string, text string")
    listed = spark.createDataFrame(BODIES, "entry string, name string, via_alias boolean")
    plain = lambda t: F.regexp_replace(nfkc(t), r"\s+", "")
    return {r.id: (r.matched, r.matched_by, r.confidence) for r in sectors.match_institutions(rows, "id", listed, plain).collect()}


def test_institutions_by_tiers(spark, monkeypatch):
    want = {
        1: ("한국도로공사", "exact_list", "high"), 2: ("한국도로공사", "alias", "medium"), 4: ("용인시", "exact_list", "high"), 5: ("보건소", "keyword_fallback", "medium"),
        11: ("서울특별시", "exact_list", "high"),
    }
    got = bodies(spark, 8 << 20, monkeypatch)
    assert got == want and bodies(spark, 0, monkeypatch) == want


def test_public_sector(spark):
    texts = ["국립 병원 만족도 조사", "교육청 알림", "재단법인 어떤 모임", "민간재단 모임", "동네 빵집", "주최: 어느 시청 담당", "홍성군 문화재단 설문", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    none = spark.createDataFrame([], "id long, matched string, matched_by string, confidence string")
    got = {r.id: (r.subject, r.detected, r.confidence) for r in sectors.detect_public(df, "id", none).collect()}
    assert got[0] == ("medical", True, "medium") and got[1] == ("education", True, "medium") and got[2] == ("unknown", False, "low")
    assert got[3] == ("private_company", False, "none") and got[4] == ("private_company", False, "none") and got[7] == ("private_company", False, "none")
    assert got[5][1:] == (True, "high") and got[6] == ("public_sector", True, "high")


def test_public_bodies_looks_into_a_text_once(spark, sf_dir):
    plan = registry.QUERIES["public_bodies"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2  # titles and whole texts
    assert plan.count("ionst") == plan.count("heit") == 1


PARTS = [
    "tion", "keit", "ment", "ings", "ungen", "eaux", "shing", "icense", "opyright", "ndly", "eleu", "ación", "with", "avec", "para", "mit", "intion", "chung", "thand", "kund", "erand", "of", "the", "la", "de", "time", "abheit", "Ünheit", "xyzheit",
    "ation", "Apache", "MIT License", "rerer", "lement", "ionst", "ioni", "\n", "\n\n", "  ", "é", "a", "b", "c", "ab", "Cab", "bce", "ae",
]


def odd_documents(rng):
    """Texts in which every rule is met, with and without a name in their first line; with null, blank and repeated ones."""
    text = lambda: rng.choice(["", "", "\n", " "]) + " ".join(rng.choice(PARTS) for _ in range(rng.choice([1, 2, 3, 6, 30]))) + "."
    rows = [(k, text()) for k in range(400)] + [(k, text()) for k in rng.sample(range(400), 40)]
    return rows + [(500, None), (501, ""), (502, " "), (503, "of time"), (503, "the ae\nb"), (None, text()), (None, "of a b c"), (504, "w" * 70 + " " + "v" * 70 + " z"), (505, "\n" + "w" * 70 + " " + "v" * 70)]


@pytest.mark.parametrize(("most", "window"), [(automaton.MOST_BYTES, longest.WINDOW_BYTES), (0, longest.WINDOW_BYTES), (0, 0)])
def test_public_bodies_is_its_sql_on_odd_texts(spark, tmp_path, monkeypatch, most, window):
    monkeypatch.setattr(automaton, "MOST_BYTES", most)
    monkeypatch.setattr(longest, "WINDOW_BYTES", window)
    spark.createDataFrame(odd_documents(random.Random(11)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = duckdb.sql(f"CREATE OR REPLACE TEMP VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'; " + registry.ORACLES["public_bodies"])
    frame = registry.QUERIES["public_bodies"](spark, str(tmp_path))
    got = [tuple(r) for r in frame.select(*want.columns).collect()]
    by = lambda r: tuple(map(str, r))
    assert sorted(got, key=by) == sorted(want.fetchall(), key=by)
    assert len({r[want.columns.index("subject")] for r in got}) == 7 and len({r[want.columns.index("matched_by")] for r in got}) == 4
    # Up to WINDOW_BYTES of names no text is taken apart, and a text goes to be searched only where its title has not settled it.
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert bool(window) == ("Generate" not in plan)
    assert not window or "found(CASE WHEN (NOT coalesce((" in plan


def test_a_finder_gives_what_a_plain_search_does(monkeypatch):
    rng = random.Random(4)
    for _ in range(40):
        for name, sizes in (("WIDEST", (2, 5, 64)), ("STEP", (7, 50, 1 << 16)), ("GROUP", (10, 300, 1 << 21))):
            monkeypatch.setattr(longest, name, rng.choice(sizes))
        longest._powers.cache_clear()
        letters = rng.choice(["ab", "abc가나", "a b😀\0"])
        draw = lambda n: "".join(rng.choice(letters) for _ in range(n))  # noqa: E731, B023
        words = sorted({draw(rng.randint(1, 9)) for _ in range(rng.choice([0, 1, 5, 120]))}, key=lambda w: (-len(w), w))
        broad, placelike = ({w for w in words if rng.random() < 0.3} for _ in range(2))
        texts = [draw(rng.choice([0, 1, 3, 20, 200])) for _ in range(40)]
        no_broad, no_whole = (np.array([rng.random() < 0.4 for _ in texts]) for _ in range(2))
        table = pa.table({"entry": pa.array(words, pa.string()), "size": pa.array([len(w) for w in words], pa.int64()), "broad": pa.array([w in broad for w in words], pa.bool_()), "placelike": pa.array([w in placelike for w in words], pa.bool_())})
        want = []
        for t, b, w in zip(texts, no_broad, no_whole, strict=True):
            held = [k for k, e in enumerate(words) if e in t]
            good = [k for k in held if words[k] not in broad or not (b or (w and words[k] == t))]
            want.append((good[0], 0) if good else (min([k for k in held if words[k] in placelike], default=len(words)), 1))
        for few in (True, False):
            best, tier = longest.Finder(table, few).best(texts, no_broad, no_whole)
            assert [(k, n) for k, n in zip(best.tolist(), tier.tolist(), strict=True)] == want
    longest._powers.cache_clear()


PAGE = """<html><head><title>A &amp; b</title><meta name="date" content="2024.3.5"></head><body><ul><li>one<li>two <b>bold</ul><p>first<p>second
<form><label for=m>Your <i>mail</i></label><input id="m" type="EMAIL" required><label>Phone <input type=tel name=t></label><input aria-label="Age" type="number"><textarea placeholder="Say"></textarea>
<select name="home_town"><option>x<option>y</select><input type="hidden" name="token"><input name="ab"><input aria-label="age"></form><script>var t = "</p>";</script></body></html>"""


def test_page_tree_and_fields(spark):
    df = spark.createDataFrame([(1, PAGE), (2, None), (3, ""), (4, "<p>open <b>bold <br> x</i></p> after")], "id long, h string").select("id", markup.page_tree("h").alias("t"))
    rows = {r.id: r.t for r in df.collect()}
    tags = [(n["tag"], None if n["parent"] is None else rows[1][n["parent"]]["tag"]) for n in rows[1]]
    assert ("li", "ul") in tags and tags.count(("li", "ul")) == 2 and tags.count(("p", "body")) == 2 and ("option", "select") in tags and ("b", "li") in tags
    assert rows[2] is None and rows[3] == [] and [n["tag"] for n in rows[4]] == ["p", "b", "br"]
    fields = {r.id: r.f for r in df.select("id", markup.form_fields(F.col("t")).alias("f")).collect()}
    assert [(f.label, f.kind, f.required) for f in fields[1]] == [("Your mail", "email", True), ("Phone", "phone", False), ("Age", "number", False), ("Say", "long_text", False), ("home town", "dropdown", False)]
    days = {r.id: r.d for r in df.select("id", markup.page_day(markup.published_days(F.col("t"))).alias("d")).collect()}
    assert days[1] == "2024-03-05" and days[2] is None and days[4] is None


def test_page_trees_is_its_sql_where_titles_end_in_a_reference(spark, tmp_path):
    pages = ["Of &quot;x&amp;", "A &amp; b &amp", "&lt;c&gt; &#39;d&#39; &nbsp", "&amp;quot; e", None]
    html = [None if t is None else f'<html><head><title>{t}</title><script>a &amp;& b</script></head><body><h1>{t}</h1><ul><li><a href="/x?a=1&amp;b=2">go</a></li></ul></body></html>' for t in pages]
    spark.createDataFrame([(k, "https://a.com/", h) for k, h in enumerate(html)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    want = duckdb.sql(registry.ORACLES["page_trees"].replace("FROM pages", f"FROM '{tmp_path}/pages.parquet/*.parquet'")).fetchall()
    got = registry.QUERIES["page_trees"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_scripts_are_kept_as_written(spark):
    df = spark.createDataFrame([("<script>a && b &amp; c</script><p>d &amp; e</p>",)], "h string").select(markup.page_tree_as_written("h").alias("t"))
    assert [n["text"] for n in df.first().t] == ["a && b &amp; c", "d &amp; e"]


def test_pages_are_parsed_in_portions_and_once(spark, sf_dir):
    pages = pd.Series(["x" * 40, None, "", "y" * 200, "z"])
    assert [list(p) for p in markup.portions(pages, 100)] == [["x" * 40, None, "", "y" * 200], ["z"]]
    assert list(markup.portions(pages.iloc[:0], 100)) == []
    plan = registry.QUERIES["html_fields"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


json_values = st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=8), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=4), x, max_size=4), max_leaves=12)


@settings(max_examples=200, deadline=None)
@given(st.lists(json_values, max_size=4) | st.dictionaries(st.text(max_size=4), json_values, max_size=4), st.text(max_size=12), st.booleans())
def test_a_scan_ends_where_the_value_ends(value, after, ascii_):
    text = json.dumps(value, ensure_ascii=ascii_)
    assert json.loads(markup.balanced(text + after, 0)) == value


def test_values_that_scripts_assign(spark):
    pages = ['<script>xA = [1]; A = [[1,"]"],{"b":"}\\""}]; B={"c":1};</script>', "<script>A = ; A = [2]</script>", "<script>A = [1, {</script>", None, "<script>window['A'] = {b: '}'};</script>"]
    df = spark.createDataFrame(list(enumerate(pages)), "id long, h string")
    got = {r.id: r.v for r in df.select("id", markup.assigned_value(F.col("h"), "A").alias("v")).collect()}
    assert got == {0: '[[1,"]"],{"b":"}\\""}]', 1: "[2]", 2: None, 3: None, 4: "{b: '}'}"}
