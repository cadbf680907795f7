"""Golden vectors and properties of the function library."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from talentlake.functions import build, jobs, scores, skills, text, titles, vector
from talentlake.operators import refdata
from talentlake.sources import readers


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return df.select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(("x", "want"), [("  Unknown ", None), ("đang cập nhật", None), (" a ", "a"), ("", None), (None, None), ("N/A", None)])
def test_norm_empty(spark, x, want):
    assert one(spark, text.norm_empty(F.col("x")), x=x) == want


def test_match_key_strips_marks(spark):
    assert one(spark, text.match_key(F.col("x")), x="<b>Kỹ sư Đường – C++ / .NET</b>") == "ky su duong - c++ / .net"


def test_dedup_lines_keeps_short_ones(spark):
    assert one(spark, text.dedup_lines(F.col("x")), x="ab\nab\na longer line\n\nA  longer line\nend") == "ab\nab\na longer line\nend"


def test_clean_light_is_idempotent(spark):
    once = text.clean_light(F.col("x"))
    x = "A&nbsp;<br/>b • c\\nd​\n\n\n\nlong long line\nlong long line"
    assert one(spark, once, x=x) == one(spark, text.clean_light(once), x=x)


@pytest.mark.parametrize(("x", "want"), [("10,000,000 - 20.000.000", (10.0, 0.0)), ("1,000 - 1,500 usd", (25000.0, 37500.0))])
def test_pay_compat_reads_one_separator(spark, x, want):
    r = one(spark, jobs.parse_pay(F.col("x"), compat=True), x=x)
    assert (r["low"], r["high"]) == want


def test_experience_compat(spark):
    r = one(spark, jobs.parse_experience(F.col("x"), compat=True), x="2-3 năm")
    assert (r["low"], r["high"], r["type"]) == (3.0, 3.0, "fixed")


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 20)), min_size=1, max_size=20))
def test_experience_low_is_under_high(spark, pairs):
    df = spark.createDataFrame([(f"{a} - {b} years",) for a, b in pairs], "x string").select(jobs.parse_experience(F.col("x")).alias("p"))
    assert df.where("p.low > p.high").isEmpty()


def test_null_experience_is_not_senior(spark):
    assert one(spark, jobs.level_from_experience(F.lit(None).cast("double"))) == "unknown"


@pytest.mark.parametrize(("n", "want"), [(0, 0), (1, 1), (700, 1), (701, 2), (1320, 2), (1321, 3)])
def test_chunk_counts(spark, n, want):
    assert len(one(spark, build.chunks(F.col("x")), x="a" * n)) == want


def test_skill_guards(spark):
    found = one(spark, skills.skills_in(F.col("x"), {"C++": ["c++"], ".NET": [".net"], "R": ["r"]}), x="knows c++, .net and ơr")
    assert found == ["C++", ".NET"]


def test_longest_synonym_wins(spark):
    assert one(spark, titles.canonical_title(F.col("x")), x="Machine Learning Engineer / Data") == "AI Engineer"


def test_empty_sets_agree(spark):
    empty = F.array().cast("array<string>")
    assert one(spark, scores.jaccard(empty, empty)) == 1.0
    assert tuple(one(spark, scores.precision_recall_f1(empty, empty))) == (1.0, 1.0, 1.0)


def test_drift(spark):
    assert [one(spark, scores.drift(F.lit(a), F.lit(b))) for a, b in ((0.0, 0.0), (0.0, 3.0), (2.0, 3.0))] == [0.0, 1.0, 0.5]


def test_repeated_judgements_count_once(spark):
    from talentlake.operators.metrics import ranking_metrics

    predictions = spark.createDataFrame([("m", 1, 10, 1), ("m", 1, 11, 2)], "method string, cv_id int, job_id int, rank int")
    qrels = spark.createDataFrame([(1, 10, 3, 1), (1, 10, 2, 2), (1, 11, 0, 1)], "cv_id int, job_id int, relevance int, order int")
    got = ranking_metrics(predictions, qrels, ["method", "cv_id"], "job_id", 2).first()
    assert (got["precision"], got["recall"], got["hit"], got["mrr"], got["ndcg"]) == (0.5, 1.0, 1.0, 1.0, 1.0)


def test_recommend_fills_up_with_jobs_without_a_match(spark):
    from talentlake.operators.match import recommend_all

    frame = spark.createDataFrame
    cvs = frame([(1, 3), (2, None)], "cv_id int, years int")
    owned, targets = frame([(1, "SQL")], "cv_id int, skill string"), frame([(1, "data"), (2, "none")], "cv_id int, role string")
    certified = frame([(2, "java")], "cv_id int, skill string")
    required = frame([(10, "sql", "required"), (10, "java", "preferred"), (11, "java", "required")], "job_id int, skill string, importance string")
    jobs = frame([(10, "Dev", "it", 5), (11, "Dev", "it", None), (12, "Data Lead", "it", 2), (13, "Cook", "food", None)], "job_id int, title string, job_family string, min_years int")
    got = {(r["cv_id"], r["rank"]): (r["job_id"], r["has_match"], round(r["score"], 6)) for r in recommend_all(cvs, owned, required, jobs, targets, 4, certified).collect()}
    assert [got[1, k] for k in (1, 2, 3, 4)] == [(10, 1, 3.0), (12, 0, 0.3), (11, 0, 0.05), (13, 0, 0.05)]
    assert [got[2, k] for k in (1, 2, 3, 4)] == [(10, 0, 0.05), (11, 0, 0.05), (12, 0, 0.0), (13, 0, 0.0)]


def test_text_functions_of_fields(spark):
    df = spark.createDataFrame([("Café <b>x</b> & y!", ["a", " a", "", None, "B", "a"], "* one\n+ two\n- three and more words", "data-engineer_LEAD x", "Java –  Script ")], "m string, l array<string>, s string, r string, a string")
    r = df.select(
        text.nfc(F.col("m")).alias("nfc"), text.clean_model(F.col("m")).alias("model"), text.dedup_list(F.col("l")).alias("list"), text.clean_structure(F.col("s")).alias("structure"),
        text.role_name(F.col("r")).alias("role"), text.alias_key(F.col("a")).alias("alias"), build.chunk_text(F.lit("Head"), F.lit("one two three"), 2).alias("chunk"), build.chunk_text(F.lit("unknown"), F.lit("one"), 2).alias("bare"),
    ).first()
    assert r.nfc.startswith("Café") and r.list == ["a", "B"] and r.role == "Data Engineer Lead X" and r.alias == "java - script"
    assert r.structure == "- one\n- two\n- three and more words" and r.chunk == "Head\none two" and r.bare == "one"
    assert "<b>" not in r.model and "!" not in r.model and "&" not in r.model


def test_cells_and_profiles(spark):
    rows = spark.createDataFrame([('["a","b"]',), ("plain",), ("[broken",), (None,)], "x string")
    assert [r.d for r in rows.select(readers.decode_cell(F.col("x")).alias("d")).collect()] == [["a", "b"], None, None, None]
    profiles = spark.createDataFrame([("A", 3, ["x"]), ("B", 0, ["x"]), ("C", 1, []), ("D", None, None)], "role_name string, job_count int, common_skills array<string>")
    assert sorted(tuple(r) for r in refdata.profile_errors(profiles).collect()) == [("B", "no jobs"), ("C", "too few skills"), ("D", "no jobs"), ("D", "too few skills")]


def test_equal_texts_have_equal_unit_vectors(spark):
    df = spark.createDataFrame([("a b c b",), ("A, b. C b",), ("other words here",), ("",), (None,)], "t string").select(vector.hash_encode(F.col("t"), 16).alias("v"))
    v = [r.v for r in df.collect()]
    assert v[0] == v[1] != v[2] and abs(sum(x * x for x in v[0]) - 1) < 1e-9 and set(v[3]) == set(v[4]) == {0.0}


@pytest.mark.parametrize(
    ("title", "level"),
    [("Senior Director", "director"), ("Trưởng phòng", "manager"), ("Team lead", "lead"), ("Chuyên viên cao cấp", "senior"), ("Midfield", "unknown"), ("Thực tập sinh", "intern"), ("overhead", "unknown"), ("Nhân viên mới tốt nghiệp", "junior")],
)
def test_level_words(spark, title, level):
    assert one(spark, jobs.level_from_text(F.col("x")), x=title) == level


@pytest.mark.parametrize(
    ("words", "mode", "source"),
    [("Remote 2 days/month", "hybrid", "remote 2 days/month"), ("3 ngày/tuần", "hybrid", "3 ngay/tuan"), ("fully remote", "remote", "fully remote"), ("on site", "onsite", "on site"), ("remotely", "unknown", None), ("Hybird onsite", "hybrid", "hybird")],
)
def test_work_modes(spark, words, mode, source):
    r = one(spark, F.struct(jobs.work_mode(F.col("x")).alias("m"), jobs.work_mode_source(F.col("x")).alias("s")), x=words)
    assert (r.m, r.s) == (mode, source)


@pytest.mark.parametrize(
    ("x", "want"),
    [
        ("15 - 25 triệu", ("range", 15e6, 25e6, "20m_30m")), ("Thỏa thuận", ("negotiable", None, None, "negotiable")), ("1,000 - 1,500 USD", ("range", 25e6, 37.5e6, "30m_50m")), ("Up to 2000$", ("upper_bound", None, 50e6, "50m_plus")),
        ("10,000,000 - 20.000.000", ("range", 10e6, 20e6, "20m_30m")), ("Từ 8 triệu", ("fixed", 8e6, 8e6, "under_10m")), ("", ("unknown", None, None, "unknown")), ("500k", ("fixed", 500e3, 500e3, "under_10m")), ("12.5 triệu", ("fixed", 12.5e6, 12.5e6, "10m_20m")),
    ],
)
def test_pay_vectors(spark, x, want):
    r = one(spark, jobs.parse_pay(F.col("x")), x=x)
    assert (r.type, r.low, r.high, r.bucket) == want


@pytest.mark.parametrize(
    ("x", "want"),
    [
        ("6 tháng - 1 năm", (0.5, 1.0, "range")), ("2-3 năm", (2.0, 3.0, "range")), ("từ 2 đến 3 năm", (2.0, 3.0, "range")), ("trên 5 năm", (5.0, None, "minimum")), ("3+ years", (3.0, None, "minimum")), ("dưới 1 năm", (0.0, 1.0, "maximum")),
        ("Không yêu cầu kinh nghiệm", (0.0, 0.0, "no_experience")), ("4 năm", (4.0, 4.0, "fixed")), ("", (None, None, "unknown")), ("18 months", (1.5, 1.5, "fixed")),
    ],
)
def test_experience_vectors(spark, x, want):
    r = one(spark, jobs.parse_experience(F.col("x")), x=x)
    assert (r.low, r.high, r.type) == want
