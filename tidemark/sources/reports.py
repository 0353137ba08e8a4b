"""Nested diagnosis reports as flat tables, and back to single values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REPORT = "scan_id string, form struct<url:string,platform:string,title:string,questions:array<struct<id:string,label:string,type:string,required:boolean,dataRiskLevel:string,detectedCategories:array<string>,options:array<string>>>>, findings array<struct<type:string,domain:string,severity:string,title:string>>, score double, limitedReason string"
PERSONAL, SENSITIVE, HIGH = ("D1", "D2", "D3"), ("D4",), ("D5",)


def parse_reports(raw: DataFrame, column: str = "report_json") -> DataFrame:
    """``raw`` with ``report``, the typed form of a JSON text; what doesn't parse is null."""
    return raw.withColumn("report", F.from_json(column, REPORT))


def survey_rows(reports: DataFrame) -> DataFrame:
    """One row for each report, with counts of its questions by level and derived flags."""
    q = F.col("report.form.questions")
    count = lambda levels: F.coalesce(F.size(F.filter(q, lambda x: x["dataRiskLevel"].isin(*levels))), F.lit(0))
    rows = reports.where("report is not null").select(
        F.col("report.scan_id").alias("id"), F.col("report.form.url").alias("survey_url"), F.col("report.form.platform").alias("platform"), F.col("report.form.title").alias("survey_title"),
        F.coalesce(F.size(q), F.lit(0)).alias("question_count"), count(PERSONAL).alias("personal_info_question_count"), count(SENSITIVE).alias("sensitive_question_count"), count(HIGH).alias("high_risk_question_count"),
        F.when(F.col("report.limitedReason").isNotNull(), "limited").otherwise("completed").alias("diagnosis_status"), F.col("report.score").alias("score"),
    )
    positive = {"has_personal_info": "personal_info_question_count", "has_sensitive_info": "sensitive_question_count", "has_high_risk_info": "high_risk_question_count"}
    return rows.withColumns({name: F.col(c) > 0 for name, c in positive.items()})


def question_rows(reports: DataFrame) -> DataFrame:
    rows = reports.where("report is not null").select(F.col("report.scan_id").alias("survey_record_id"), F.posexplode("report.form.questions").alias("sort_order", "q"))
    return rows.select("survey_record_id", "sort_order", F.col("q.id").alias("question_key"), F.col("q.label").alias("question_label"), F.col("q.type").alias("question_type"), F.coalesce("q.required", F.lit(False)).alias("is_required"), F.col("q.dataRiskLevel").alias("data_risk_level"), F.col("q.detectedCategories").alias("risk_tags"), F.coalesce(F.size("q.options"), F.lit(0)).alias("n_options"))


def category_rows(reports: DataFrame) -> DataFrame:
    """One row for each question and category, each once."""
    return question_rows(reports).select("survey_record_id", "question_key", F.explode("risk_tags").alias("category_code")).distinct()


def finding_rows(reports: DataFrame) -> DataFrame:
    rows = reports.where("report is not null").select(F.col("report.scan_id").alias("survey_record_id"), F.explode("report.findings").alias("f"))
    return rows.select("survey_record_id", F.col("f.type").alias("finding_type"), F.col("f.domain").alias("check_domain"), F.col("f.severity").alias("severity"), F.col("f.title").alias("title"))
