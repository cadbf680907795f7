"""Top-k by terms and vectors, label loads, profiles and sketches against plain Python."""

import collections
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from talentlake.operators import labels, metrics, rank, skills


@pytest.mark.parametrize(("k", "first"), [(1, 1), (3, 1), (3, 3), (50, 2)])
def test_pruning_changes_nothing(spark, k, first):
    rng = random.Random(k * 10 + first)
    common = [f"t{i}" for i in range(40)]
    draw = lambda n: list({rng.choice(common[: rng.choice([3, 10, 40])]) for _ in range(n)})
    docs = [(i, draw(rng.randint(0, 12))) for i in range(120)]
    questions = [(q, t, float(rng.choice([1, 1.5, 2]))) for q in range(12) for t in draw(8)] + [(99, "none", 1.0)]
    got = rank.top_by_terms(spark.createDataFrame(questions, "q int, term string, w double"), "q", spark.createDataFrame(docs, "doc int, terms array<string>"), "doc", k, first)
    want = set()
    for q in {x[0] for x in questions}:
        weights = {t: w for p, t, w in questions if p == q}
        scored = sorted((-round(sum(weights[t] for t in terms if t in weights), 9), d) for d, terms in docs if set(terms) & set(weights))
        want |= {(q, d, -s, n) for n, (s, d) in enumerate(scored[:k], 1)}
    assert {tuple(r) for r in got.select("q", "doc", "score", "rank").collect()} == want


def test_common_terms_are_not_joined(spark):
    """A term that all documents have is left out once the rare ones have settled the answer."""
    docs = [(i, ["all", *(["rare"] if i < 5 else [])]) for i in range(200)]
    w = spark.createDataFrame([(1, "all", 1.0), (1, "rare", 5.0)], "q int, term string, w double")
    out = rank.top_by_terms(w, "q", spark.createDataFrame(docs, "doc int, terms array<string>"), "doc", 3, 1)
    assert [(r.doc, r.score) for r in out.orderBy("rank").collect()] == [(0, 6.0), (1, 6.0), (2, 6.0)]


def test_nearest_in_blocks(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(70, 9))
    v[5] = v[6]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(100, None), (101, []), (102, [0.0] * 9)]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    for apart in (False, True):
        got = {(r.query, r["rank"]): r.id for r in rank.nearest(df, df, "id", "v", 4, apart, rows=16).collect()}
        u = v / np.linalg.norm(v, axis=1)[:, None]
        d = np.round(1 - u @ u.T, 12)
        want = {}
        for q in range(70):
            order = sorted((d[q, i], i) for i in range(70) if not (apart and i == q))
            want |= {(q, n): i for n, (_, i) in enumerate(order[:4], 1)}
        assert got == want
    assert rank.nearest(df, df.limit(0), "id", "v", 4).count() == 0


def test_nearest_in_many_groups_with_ties(spark, monkeypatch):
    """Blocks are exchanged once for each group of the other side; before, once for each of its blocks."""
    monkeypatch.setattr(rank, "GROUP_ROWS", 12)
    v = np.repeat(np.random.default_rng(5).normal(size=(9, 4)), 8, axis=0)  # eight copies of each
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>").repartition(5, "id")
    got = {}
    for r in rank.nearest(df.where("id % 5 = 0"), df, "id", "v", 10, rows=4).orderBy("query", "rank").collect():
        got.setdefault(r.query, []).append(r.id)
    u = v / np.linalg.norm(v, axis=1)[:, None]
    d = np.round(1 - u @ u.T, 12)
    assert got == {q: sorted(range(72), key=lambda i: (d[q, i], i))[:10] for q in range(0, 72, 5)}


def test_groups_of_blocks_bound_what_is_exchanged():
    for n, tasks in ((1000, 8), (50_000, 8), (600_000, 200), (600_000, 4000)):
        of_queries, of_vectors = rank._groups(n, n, tasks)
        assert n / max(of_queries, of_vectors) <= 32768 and of_queries + of_vectors <= 2 * max(-(-n // 32768), tasks**0.5 + 2)


GOOD = {
    "cv_id": "1", "role": "x", "final_label_score": "50", "grade": "d", "subscore_skill": "20", "subscore_experience": "10", "subscore_achievement": "10", "subscore_education": "5", "subscore_formatting": "3", "subscore_keywords": "2",
    "label_source": "committee", "labeler_id": "a", "label_confidence": "0.5", "labeled_at": "2024",
}


def label_rows(spark, changes):
    rows = [tuple((GOOD | c)[k] for k in labels.COLUMNS) + (i,) for i, c in enumerate(changes)]
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in labels.COLUMNS) + ", line int")


def test_label_rules_in_order(spark):
    changes = [
        {}, {"cv_id": " ", "role": ""}, {"cv_id": "2", "role": "", "grade": "B", "final_label_score": "x"}, {"cv_id": "3", "grade": "A", "label_source": "me", "label_confidence": None},
        {"cv_id": "4", "subscore_skill": "31"}, {"cv_id": "5", "subscore_skill": "25"}, {"cv_id": "6", "final_label_score": "50.9"}, {"cv_id": "7"}, {"role": "later"},
    ]
    known = spark.createDataFrame([(i,) for i in range(1, 7)], "cv_id int")
    old = spark.createDataFrame([("1", "a", "2024", 1.0, "kept"), ("1", "b", "2024", 2.0, "kept")], "cv_id string, labeler_id string, labeled_at string, final_label_score double, extra string")
    merged, report = labels.load_labels(old, label_rows(spark, changes), known, ["line"])
    assert [(r.row_no, r.status, r.reasons) for r in report.orderBy("row_no").collect()] == [
        (2, "replaced", ["replaced by row 10"]), (3, "rejected", ["cv_id is empty"]), (4, "rejected", ["role is empty", "final_label_score out of bounds"]),
        (5, "rejected", ["grade does not fit the score", "unknown label_source", "label_confidence out of bounds"]), (6, "rejected", ["subscore_skill out of bounds"]), (7, "rejected", ["subscores do not add up"]),
        (8, "accepted", []), (9, "rejected", ["no such record"]), (10, "accepted", []),
    ]
    assert sorted(tuple(r) for r in merged.collect() if r.cv_id == "1") == [("1", "a", "2024", 50.0, None), ("1", "b", "2024", 2.0, "kept")]
    assert merged.count() == 3


def test_the_same_rules_as_sql(spark):
    """Columns and SQL come from one table, and the SQL runs elsewhere too."""
    rows = labels.typed(label_rows(spark, [{}, {"grade": "A"}, {"role": ""}, {"final_label_score": "200"}]))
    rows.createOrReplaceTempView("typed_labels")
    sql = labels.sql_checks("typed_labels", labels.rules())
    ours = {r.rule: r.rows for r in spark.sql(sql).collect()}
    con = duckdb.connect()
    con.register("typed_labels", rows.toArrow())
    assert {r[0]: r[1] for r in con.sql(sql).fetchall()} == ours
    assert ours["role is empty"] == 1 and ours["final_label_score out of bounds"] == 1 and ours["grade does not fit the score"] == 2


def test_reasons_grow_with_the_rules_only(spark):
    """Twice the rules make an expression twice as long; a tree of conditions doubled with every rule."""
    table = labels.rules()
    some, twice = len(str(labels.reasons(table))), len(str(labels.reasons(table + table)))
    assert twice < 5 * some and some < 20_000


def test_labels_need_their_columns(spark):
    with pytest.raises(ValueError, match="grade"):
        labels.typed(label_rows(spark, [{}]).drop("grade"))


def test_profiles(spark):
    rows = [("data-engineer", "SQL and java spark", "2 năm")] * 3 + [("Data Engineer", "sql only", "")] * 2 + [("tester", "java", None)]
    df = spark.createDataFrame(rows, "role string, text string, exp string")
    items = skills.role_items(df, F.col("role"), F.col("text"), F.col("exp"), {"SQL": ["sql"], "Java": ["java"], "Spark": ["spark"], "Rust": ["rust"]}, ["and"])
    counts = collections.Counter({(r.role, r.kind, r.item): r.n for r in items.collect()})
    assert counts["Data Engineer", "skill", "SQL"] == 5 and counts["Data Engineer", "job", ""] == 5 and counts["Tester", "experience", "Unknown"] == 1
    got = {r.role_name: r for r in skills.profiles(items, least_jobs=1, top_skills=1, more=2).collect()}
    assert got["Data Engineer"].common_skills == ["SQL"] and got["Data Engineer"].recommended_next_skills == ["Java", "Spark"]
    assert got["Data Engineer"].common_experience_patterns == ["2 years", "Unknown"]
    assert got["Tester"].common_skills == ["Java"] and got["Tester"].recommended_next_skills == ["SQL", "Spark"]
    assert [r.role_name for r in skills.profiles(items, least_jobs=2).collect()] == ["Data Engineer"]


def test_merged_sketches_keep_their_error(spark):
    n = 400_000
    df = spark.range(n).select((F.col("id") % 7).alias("day"), F.pmod(F.xxhash64("id"), F.lit(10**9)).cast("double").alias("v"))
    merged = metrics.merge_sketches(metrics.quantile_sketches(df, ["day"], F.col("v")).withColumn("g", F.lit(1)), ["g"])
    r = metrics.sketched_quantiles(merged, ["g"], {"p50": 0.5, "p95": 0.95, "p99": 0.99}).first()
    values = np.sort(np.array([x.v for x in df.select("v").collect()]))
    assert r.n == n
    for share, found in ((0.5, r.p50), (0.95, r.p95), (0.99, r.p99)):
        assert abs(np.searchsorted(values, found) / n - share) < metrics.SKETCH_ERROR


def test_quantiles_are_exact_whatever_the_sketch_says(spark):
    n = 60_000
    df = spark.range(n).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"), F.pmod(F.xxhash64("id"), F.lit(10**9)).cast("double").alias("v"))
    df = df.unionByName(spark.createDataFrame([(7, 5.0), (7, None), (7, 4.0)], "g long, v double"))
    sketches = metrics.quantile_sketches(df, ["g"], F.col("v"), 64)
    wrong = sketches.select("g", "n", F.first("sketch").over(Window.partitionBy(F.lit(1)).orderBy("n")).alias("sketch"))  # the small group's for all
    values = collections.defaultdict(list)
    for r in df.where("v is not null").orderBy("v").collect():
        values[r.g].append(r.v)
    want = {(g, len(v), *[v[-(-len(v) * p // 1000) - 1] for p in (500, 950, 999)]) for g, v in values.items()}
    for known in (sketches, wrong):
        got = metrics.exact_quantiles(df, known, "g", F.col("v"), {"p50": 0.5, "p95": 0.95, "p999": 0.999})
        assert {tuple(r) for r in got.collect()} == want


def test_lists_are_dealt_by_their_number(spark, monkeypatch):
    """A task had as many rows as fit into so many bytes, and hash tables of their keys; the parts grow with the rows now, and there is no join."""
    from talentlake.operators import metrics

    monkeypatch.setattr(metrics, "TASK_ROWS", 5)
    p = spark.createDataFrame([("m", c, f"j{i}", i) for c in (1, 2, None) for i in (1, 2, 3)] + [("n", 1, None, 1), ("n", 1, "j1", 2)], "method string, cv_id int, job_id string, rank int")
    q = [(1, "j1", 1, 1), (1, "j1", 0, 2), (1, "j2", 3, 1), (1, "j9", 2, 1), (1, None, 1, 1), (2, "j1", 0, 1), (None, "j1", 3, 1), (7, "j1", 3, 1)]
    q = spark.createDataFrame(q, "cv_id int, job_id string, relevance int, order int")
    out = metrics.ranking_metrics(p, q, ["method", "cv_id"], "job_id", 2)
    got = {(r.method, r.cv_id): (r.precision, round(r.recall, 6), r.hit, r.mrr, round(r.ndcg, 6)) for r in out.collect()}
    assert got == {("m", 1): (0.5, 0.333333, 1.0, 0.5, 0.63093), ("m", 2): (0.0, 0.0, 0.0, 0.0, 0.0), ("m", None): (0.0, 0.0, 0.0, 0.0, 0.0), ("n", 1): (0.0, 0.0, 0.0, 0.0, 0.0)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(cv_id" in plan and "REPARTITION_BY_NUM" in plan and "Join" not in plan
    plain = metrics.ranking_metrics(p, q.drop("order"), ["method", "cv_id"], "job_id", 2).where("method = 'n'").first()  # the highest judgement
    assert (plain.precision, round(plain.recall, 6), plain.mrr) == (0.5, 0.25, 0.5)
