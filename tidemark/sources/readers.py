"""Typed tables: reading with a schema, older files with missing columns, landed pages and search hits."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMAS: Mapping[str, str] = {
    "survey_records": "id string, scan_job_id string, scan_report_id string, organization_id string, survey_title string, survey_url string, url_host string, platform string, operator_name string, public_private_type string, subject_type string, sector string, industry string, region string, overall_risk_level string, user_decision_label string, safety_type_id string, has_personal_info boolean, has_sensitive_info boolean, has_high_risk_info boolean, question_count int, personal_info_question_count int, sensitive_question_count int, high_risk_question_count int, review_status string, publish_status string, observed_at timestamp, observed_date_kst date",
    "survey_index_scores": "survey_record_id string, score_version string, overall_score decimal(5,2), data_score decimal(5,2), tool_score decimal(5,2), notice_score decimal(5,2), management_score decimal(5,2)",
    "survey_findings": "id string, survey_record_id string, finding_type string, check_domain string, severity string, status string, title string, observed_date_kst date",
    "survey_compliance_checks": "id string, survey_record_id string, check_domain string, check_item string, status string, status_label string, observed_date_kst date",
    "survey_questions": "id string, survey_record_id string, question_key string, question_label string, question_type string, is_required boolean, data_risk_level string, risk_tags array<string>, has_personal_info boolean, has_sensitive_info boolean, has_high_risk_info boolean, sort_order int, observed_date_kst date",
    "question_data_categories": "survey_question_id string, category_code string, category_label string, risk_category string",
    "evidence_files": "id string, survey_record_id string, scan_job_id string, capture_job_id string, evidence_type string, is_key_evidence boolean, created_at timestamp",
    "capture_jobs": "id string, survey_record_id string, scan_job_id string, status string, completeness string, captured_page_count int, observed_date_kst date, priority int, queued_at timestamp, locked_at timestamp",
    "scan_jobs": "id string, external_scan_id string, cache_key string, status string, priority int, queued_at timestamp, created_at timestamp, updated_at timestamp, completed_at timestamp, locked_at timestamp, locked_by string, attempt_count int",
    "survey_links": "id string, canonical_url string, original_url string, platform string, title string, status string, first_discovered_at timestamp, last_discovered_at timestamp, discovery_count int",
    "collection_query_stats": "collection_run_id string, search_query string, source_type string, sort_mode string, results_count int, candidate_count int, valid_survey_count int, new_survey_count int, invalid_count int, duplicate_survey_count int",
    "organizations": "id string, name string, name_normalized string, public_private_type string, sector string, industry string, region string, aliases array<string>",
}


def schema_of(name: str) -> T.StructType:
    return T.StructType.fromDDL(SCHEMAS[name])


def read_table(spark: SparkSession, root: str, name: str, fmt: str = "parquet") -> DataFrame:
    """A table with its declared types; files that lack a column give nulls for it, columns they have besides are not read."""
    return spark.read.format(fmt).schema(schema_of(name)).load(f"{root.rstrip('/')}/{name}.{fmt}")


def conformed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with exactly the columns of ``schema``: cast where it has them, null where it doesn't."""
    present = {c.lower(): c for c in df.columns}
    return df.select(*[(F.col(f"`{present[f.name.lower()]}`") if f.name.lower() in present else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def read_json_lines(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Landed search hits; lines that are no JSON of the schema are kept apart in ``_corrupt``."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    with_bad = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    return spark.read.schema(with_bad).option("columnNameOfCorruptRecord", "_corrupt").json(path)


def upload_gate(files: DataFrame, most_bytes: int = 10 * 1024 * 1024) -> DataFrame:
    """``files`` (path, length) with ``error``: null for what may be read, else why not."""
    extension = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    error = F.when(~extension.isin("xlsx", "docx", "hwpx", "csv", "txt", "html"), "unsupported_type").when(F.col("length") == 0, "empty").when(F.col("length") > most_bytes, "too_large")
    return files.withColumn("error", error)
