"""Questions, descriptions and QA rows on odd input."""

import pytest
from pyspark.sql import functions as F

from talentlake.functions import questions
from talentlake.operators import qa


@pytest.mark.parametrize(
    ("stated", "asked", "career", "guest"),
    [
        ("Score ", "gap", "score", "score"), ("general", "gợi ý job", "recommend", "general"), (None, "Cải thiện kỹ năng", "score", "improve_cv"), ("", "improve my job", "recommend", "improve_cv"),
        (None, None, "score", "general"), ("x", "chấm điểm", "score", "general"), (None, "VIỆC LÀM", "score", "recommend"),
    ],
)
def test_intents(spark, stated, asked, career, guest):
    df = spark.createDataFrame([(stated, asked)], "s string, q string")
    r = df.select(questions.career_intent(F.col("s"), F.col("q")).alias("c"), questions.guest_intent(F.col("s"), F.col("q")).alias("g")).first()
    assert (r.c, r.g) == (career, guest)


def test_a_guess_comes_before_words(spark):
    df = spark.createDataFrame([("x", "job", " Improve_CV"), (None, "job", "dunno"), ("score", "job", "general")], "s string, q string, l string")
    got = df.select(questions.guest_intent(F.col("s"), F.col("q"), F.col("l")).alias("g")).collect()
    assert [r.g for r in got] == ["improve_cv", "recommend", "score"]


def test_descriptions(spark):
    df = spark.createDataFrame([("Số lượng tuyển: 3 người. Java", 1.0, 2.5), ("so luong tuyen 5", None, 3.0), (None, 2.0, None), (" ", None, None), ("x " * 200, None, None)], "r string, a double, b double")
    got = [r.d for r in df.select(questions.job_description(F.col("r"), F.col("a"), F.col("b")).alias("d")).collect()]
    assert got[0] == "Kinh nghiệm: 1-2.5 năm | Số lượng tuyển: 3 người | Số lượng tuyển: 3 người. Java"
    assert got[1] == "Kinh nghiệm tối đa: 3 năm | Số lượng tuyển: 5 | so luong tuyen 5" and got[2] == "Kinh nghiệm tối thiểu: 2 năm"
    assert got[3] == questions.NO_DESCRIPTION and len(got[4]) == 223


def test_skills_of_a_domain(spark):
    df = spark.createDataFrame([(["Go", "React", "SQL"],), (None,)], "s array<string>")
    got = df.select(questions.skills_of_domain_first(F.col("s"), F.lit("WEB")).alias("w"), questions.skills_of_domain_first(F.col("s"), F.lit("GENERAL")).alias("g")).collect()
    assert got[0].w == ["React", "Go", "SQL"] and got[0].g == ["Go", "React", "SQL"] and got[1].w is None


def test_qa_row_of_odd_tables(spark):
    jobs = spark.createDataFrame([("unknown", None, None, True), (" x", [], "abc", None), (None, ["a", "b"], "a", False)], "job_family string, skills_extracted array<string>, job_text_sparse string, salary_is_negotiable boolean")
    r = qa.qa_row(jobs, jobs.limit(0)).first()
    assert r.n_jobs == 3 and r.n_sections == 0 and r.pct_missing_salary_min is None and r.avg_section_chunk_len is None
    assert abs(r.pct_unknown_job_family - 1 / 3) < 1e-9 and abs(r.avg_skills_per_job - 2 / 3) < 1e-9 and abs(r.pct_jobs_without_skills - 2 / 3) < 1e-9
    assert abs(r.avg_job_text_sparse_len - 4 / 3) < 1e-9 and abs(r.pct_negotiable_salary - 1 / 3) < 1e-9
    assert qa.qa_row(jobs.limit(0), jobs.limit(0)).first().pct_unknown_job_family == 0.0
    assert len(qa.JOB_FIELDS) + len(qa.SECTION_FIELDS) == 26
    a = qa.audit_row(jobs.select(F.col("job_family").alias("u"), F.col("job_text_sparse").alias("t")), "u", "t", ["t"]).first()
    assert (a.n_rows, a.dup_by_url_ratio) == (3, 0.0) and abs(a.has_minimum_content_ratio - 2 / 3) < 1e-9
    assert qa.audit_row(jobs.limit(0).select(F.col("job_family").alias("u")), "u", "u", ["u"]).first().n_rows == 0
