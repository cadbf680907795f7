"""Properties that hold whatever the data: bounds, prefixes, order of input."""

import random

import pytest
from pyspark.sql import functions as F

from talentlake.operators import match, metrics, skills, tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def lists(spark):
    rng = random.Random(1)
    rows = [("m", q, i, r) for q in range(20) for r, i in enumerate(rng.sample(range(30), 8), 1)]
    qrels = [(q, i, rng.randint(0, 3)) for q in range(20) for i in range(0, 30, 2)]
    return spark.createDataFrame(rows, "method string, cv_id int, job_id int, rank int"), spark.createDataFrame(qrels, "cv_id int, job_id int, relevance int")


def test_metrics_are_shares(lists):
    out = metrics.ranking_metrics(*lists, ["method", "cv_id"], "job_id", 5)
    bad = " or ".join(f"{m} < 0 or {m} > 1 or {m} is null" for m in ("precision", "recall", "hit", "mrr", "ndcg"))
    assert out.count() == 20
    assert out.where(bad).isEmpty()


def test_ndcg_of_the_ideal_order_is_one(spark):
    p = spark.createDataFrame([("m", 1, 1, 1), ("m", 1, 2, 2), ("m", 1, 3, 3)], "method string, cv_id int, job_id int, rank int")
    q = spark.createDataFrame([(1, 1, 3), (1, 2, 1)], "cv_id int, job_id int, relevance int")
    r = metrics.ranking_metrics(p, q, ["method", "cv_id"], "job_id", 3).first()
    assert r.ndcg == pytest.approx(1.0)
    assert (r.recall, r.mrr) == (1.0, 1.0)


def test_no_judgement_is_zero(spark):
    p = spark.createDataFrame([("m", 1, 1, 1)], "method string, cv_id int, job_id int, rank int")
    q = spark.createDataFrame([(2, 1, 3)], "cv_id int, job_id int, relevance int")
    r = metrics.ranking_metrics(p, q, ["method", "cv_id"], "job_id", 3).first()
    assert (r.precision, r.recall, r.hit, r.mrr, r.ndcg) == (0.0, 0.0, 0.0, 0.0, 0.0)


def test_topk_is_a_prefix(spark):
    words = skills.keyword_counts(spark.read.parquet(f"{SF}/documents.parquet"), "lang", F.col("text"), [])
    five = {tuple(r) for r in skills.top_by(words, "lang", "word", 5).collect()}
    assert five < {tuple(r) for r in skills.top_by(words, "lang", "word", 9).collect()}


def test_order_of_input_does_not_matter(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    vocabulary = {"Erin": ["erin"], "Para": ["para"]}
    one = skills.skill_records(docs.orderBy("doc_id"), ["doc_id"], {"description": F.col("text")}, vocabulary)
    two = skills.skill_records(docs.orderBy(F.col("doc_id").desc()).repartition(7), ["doc_id"], {"description": F.col("text")}, vocabulary)
    assert one.exceptAll(two).isEmpty()
    assert two.exceptAll(one).isEmpty()


def test_anti_join_survives_null_skills(spark):
    owned = spark.createDataFrame([(1, "a"), (1, None)], "cv_id int, skill string")
    required = spark.createDataFrame([(9, "a", "required"), (9, "b", "required")], "job_id int, skill string, importance string")
    pairs = spark.createDataFrame([(1, 9)], "cv_id int, job_id int")
    assert [(r.skill, r.n) for r in match.skill_gap(owned, required, pairs, 5).collect()] == [("b", 1)]


def test_constant_scores_have_no_correlation(spark):
    df = spark.createDataFrame([("g", 1.0, 2.0), ("g", 1.0, 3.0)], "g string, p double, h double")
    r = metrics.calibration(df, "g", "p", "h", 1.0).first()
    assert (r.pearson, r.spearman) == (0.0, 0.0)


def test_empty_tables(spark):
    nothing = spark.createDataFrame([], "k int, v string, version int")
    assert tables.duplicate_ratio(nothing, "k").first()[0] == 0.0
    assert {r.missing for r in tables.missing_ratio(nothing).collect()} == {0.0}
    assert tables.upsert(nothing, nothing, ["k"]).count() == 0
    assert tables.latest(nothing, ["k"], F.col("version").desc()).count() == 0


def test_filters_reach_the_scan(spark, capsys):
    from talentlake.plans import catalog

    catalog.QUERIES["point_lookup"](spark, SF).explain("formatted")
    plan = capsys.readouterr().out
    assert "EqualTo(c_custkey,7)" in plan
    assert "c_mktsegment" not in plan
