"""The QA row of a job table and its sections, and the manifest of a load: one pass over each table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The fields of the QA row, what each measures and of which column.
JOB_FIELDS = {
    "pct_missing_job_title_display": ("missing", "job_title_display"),
    "pct_missing_job_title_canonical": ("missing", "job_title_canonical"),
    "pct_unknown_job_family": ("unknown", "job_family"),
    "pct_missing_location_city": ("missing", "location_city"),
    "pct_true_is_multi_location": ("true", "is_multi_location"),
    "pct_unknown_work_mode": ("unknown", "work_mode"),
    "pct_missing_salary_min": ("missing", "salary_min_vnd_month"),
    "pct_missing_salary_max": ("missing", "salary_max_vnd_month"),
    "pct_negotiable_salary": ("true", "salary_is_negotiable"),
    "pct_missing_experience_min": ("missing", "experience_min_years"),
    "pct_missing_experience_max": ("missing", "experience_max_years"),
    "pct_unknown_experience_type": ("unknown", "experience_type"),
    "pct_unknown_education_level": ("unknown", "education_level_norm"),
    "pct_unknown_employment_type": ("unknown", "employment_type_norm"),
    "pct_unknown_job_level": ("unknown", "job_level_norm"),
    "avg_tags_per_job": ("entries", "tags_list"),
    "avg_skills_per_job": ("entries", "skills_extracted"),
    "avg_required_skills_per_job": ("entries", "skills_required"),
    "avg_preferred_skills_per_job": ("entries", "skills_preferred"),
    "pct_jobs_without_skills": ("empty", "skills_extracted"),
    "avg_job_text_sparse_len": ("length", "job_text_sparse"),
    "avg_job_text_match_len": ("length", "job_text_match"),
    "avg_job_text_chatbot_len": ("length", "job_text_chatbot"),
    "job_has_dense_embedding_rate": ("true", "has_dense_embedding"),
}
SECTION_FIELDS = {"avg_section_chunk_len": ("length", "chunk_text"), "section_has_dense_embedding_rate": ("true", "has_dense_embedding")}


def _measure(kind: str, c: Column) -> Column:
    """The number that is averaged over rows."""
    entries = F.coalesce(F.nullif(F.size(c), F.lit(-1)), F.lit(0)) if kind in ("entries", "empty") else None
    return {
        "missing": lambda: c.isNull(), "unknown": lambda: F.coalesce(F.lower(F.trim(c.cast("string"))) == "unknown", F.lit(False)), "true": lambda: F.coalesce(c.cast("int"), F.lit(0)) != 0,
        "entries": lambda: entries, "empty": lambda: entries == 0, "length": lambda: F.length(F.coalesce(c, F.lit(""))),
    }[kind]().cast("double")


def _fields(df: DataFrame, fields: dict[str, tuple[str, str]]) -> list[Column]:
    absent = F.lit(None).cast("double")
    return [(F.coalesce(F.avg(_measure(kind, F.col(c))), F.lit(0.0)) if c in df.columns else absent).alias(name) for name, (kind, c) in fields.items()]


def qa_row(jobs: DataFrame, sections: DataFrame) -> DataFrame:
    """One row: n_jobs, n_sections and all fields, each table read once. A field whose column is not there is null, one of an empty
    table 0. Null lists have no entries, null texts no characters, null flags are false."""
    n = F.count(F.lit(1))
    return jobs.agg(n.alias("n_jobs"), *_fields(jobs, JOB_FIELDS)).crossJoin(sections.agg(n.alias("n_sections"), *_fields(sections, SECTION_FIELDS)))


def audit_row(jobs: DataFrame, url: str, title: str, bodies: list[str]) -> DataFrame:
    """One row before cleaning: n_rows, dup_by_url_ratio (null addresses are one), has_minimum_content_ratio (a title and any body)."""
    filled = lambda c: F.coalesce(F.length(c), F.lit(0)) > 0
    body = F.lit(False)
    for b in bodies:
        body = body | filled(b)
    distinct = F.countDistinct(url) + F.coalesce(F.max(F.col(url).isNull().cast("int")), F.lit(0))
    ratio = lambda x: F.coalesce(x, F.lit(0.0))
    n = F.count(F.lit(1))
    return jobs.agg(n.alias("n_rows"), ratio(F.try_divide((n - distinct).cast("double"), n)).alias("dup_by_url_ratio"), ratio(F.avg((filled(title) & body).cast("double"))).alias("has_minimum_content_ratio"))


def manifest(tables: dict[str, DataFrame], run: str) -> DataFrame:
    """run, name, rows, columns, schema: a row for each table of a load."""
    parts = None
    for name, df in tables.items():
        fields = ",".join(f"{c}:{t}" for c, t in df.dtypes)
        row = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(run).alias("run"), F.lit(name).alias("name"), "rows", F.lit(len(df.columns)).alias("columns"), F.lit(fields).alias("schema"))
        parts = row if parts is None else parts.unionByName(row)
    return parts
