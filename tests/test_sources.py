import json
import zipfile

import pytest

from tidemark.sources import office, readers, reports, sinks


def test_schemas_parse_and_conform(spark):
    for name in readers.SCHEMAS:
        assert len(readers.schema_of(name)) > 3
    df = spark.createDataFrame([(1, "x")], "ID long, extra string")
    assert readers.conformed(df, readers.schema_of("survey_links")).first().asDict()["id"] == "1"


def test_repeated_appends_and_upserts(spark, tmp_path):
    path = f"{tmp_path}/t"
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k long, v string")
    sinks.append_new(df, path, ["k"])
    sinks.append_new(df, path, ["k"])
    assert spark.read.parquet(path).count() == 2
    changed = sinks.upsert(df.dropDuplicates(["k"]), spark.createDataFrame([(2, "z"), (5, "n")], "k long, v string"), ["k"])
    assert {r.k for r in changed.collect()} == {1, 2, 5} and changed.where("k = 2").first().v == "z"


def test_exports_read_back(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi", a\nb', ["x"]), (2, None, None)], "k long, v string, tags array<string>")
    sinks.write_csv(df, f"{tmp_path}/c")
    back = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(f"{tmp_path}/c").collect()
    assert {r.v for r in back} == {'say "hi", a\nb', None} and {r.tags for r in back} == {'["x"]', None}
    sinks.write_json(df, f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").count() == 2
    with pytest.raises(ValueError):
        sinks.assert_without(spark.createDataFrame([((1,),)], "a struct<Secret:int>"), ["secret"])


def test_reports_to_rows(spark):
    form = {"url": "u", "platform": "p", "title": "t", "questions": [{"id": "1", "label": "a", "dataRiskLevel": "D3", "detectedCategories": ["n", "n"], "options": ["x", "y"]}, {"id": "2", "label": "b", "dataRiskLevel": "D5", "required": True}]}
    raw = spark.createDataFrame([(json.dumps({"scan_id": "s", "form": form, "findings": [{"type": "f", "domain": "d"}], "score": 61.5}),), ("no json",), (json.dumps({"scan_id": "e"}),), (None,)], "report_json string")
    parsed = reports.parse_reports(raw)
    rows = {r.id: r for r in reports.survey_rows(parsed).where("id is not null").collect()}
    assert rows["s"].question_count == 2 and rows["s"].has_personal_info and rows["s"].has_high_risk_info and not rows["s"].has_sensitive_info
    assert rows["e"].question_count <= 0 or rows["e"].question_count == 0
    assert reports.question_rows(parsed).count() == 2 and reports.category_rows(parsed).count() == 1 and reports.finding_rows(parsed).count() == 1


def test_office_files(spark, tmp_path):
    def archive(name, parts):
        with zipfile.ZipFile(f"{tmp_path}/{name}", "w") as z:
            for part, body in parts.items():
                z.writestr(part, body)

    archive("a.docx", {"word/document.xml": '<w:d xmlns:w="w"><w:p><w:r><w:t>One </w:t><w:t>line</w:t></w:r></w:p><w:p/></w:d>'})
    archive("b.hwpx", {"Contents/section0.xml": '<h:s xmlns:h="h"><h:p><h:t>Zeile</h:t></h:p></h:s>'})
    archive("c.xlsx", {"xl/sharedStrings.xml": '<sst xmlns="m"><si><t>name</t></si></sst>', "xl/worksheets/sheet1.xml": '<w xmlns="m"><row><c t="s"><v>0</v></c><c><v>5</v></c></row></w>'})
    (tmp_path / "d.docx").write_bytes(b"no archive")
    (tmp_path / "e.exe").write_bytes(b"x")
    got = {(r.path.rpartition("/")[2], r.line, r.error) for r in office.read_office(spark, str(tmp_path)).collect()}
    assert got == {("a.docx", "One line", None), ("b.hwpx", "Zeile", None), ("c.xlsx", "name\t5", None), ("d.docx", None, "unreadable"), ("e.exe", None, "unsupported_type")}
