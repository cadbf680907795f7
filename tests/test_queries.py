"""Every registered query against its SQL twin on the small tables."""

import math
import os

import duckdb
import pytest

from talentlake.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    return v if v is None or isinstance(v, int | str | bool) else str(v)[:19]


def test_every_query_has_a_twin():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_twin(spark, duck, name):
    ours = catalog.QUERIES[name](spark, SF)
    theirs = duck.sql(catalog.ORACLES[name])
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    left = sorted([tuple(map(plain, r)) for r in ours.select(*columns).collect()], key=str)
    right = sorted([tuple(map(plain, r)) for r in theirs.project(", ".join(f'"{c}"' for c in columns)).fetchall()], key=str)
    assert left == right


def test_strict_cleaning_covers_all_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name in ("text_strict", "text_strict_whole"):
        assert catalog.QUERIES[name](spark, SF).count() == docs.count()


def test_whole_texts_are_read(spark):
    total = lambda name: catalog.QUERIES[name](spark, SF).selectExpr("sum(share)").first()[0]
    assert total("grounded_share_whole") == total("grounded_share") > 0
    turns = spark.read.parquet(f"{SF}/conversations.parquet").where("turn % 2 = 1")
    for name in ("model_input", "model_input_whole"):
        longest = catalog.QUERIES[name](spark, SF).selectExpr("max(length(model_text))").first()[0]
        assert longest == turns.selectExpr("max(length(trim(text)))").first()[0]


@pytest.mark.parametrize("name", ["job_rules", "answer_metrics", "title_canonical"])
def test_rules_on_short_rows_use_all_cores(spark, name):
    """A table of parts is one split of a file, so that all rules ran in one task."""
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobinPartitioning(4)" in plan


def test_terms_of_documents_are_worked_out_once(spark):
    """What is ranked reads written terms, not the texts again for each step."""
    plan = catalog.QUERIES["rerank_weighted"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "documents.parquet" not in plan and "/terms-" in plan


def test_model_text_of_odd_documents_equals_its_twin(spark, tmp_path):
    """Empty, blank, unknown and missing fields, and white space of other kinds."""
    odd = [None, "", " ", "\u00a0", "unknown", " Unknown ", "\n\t", "a\x0bb", "\u00a0a\u00a0b \u00a0", "\u3000 a\u2003 ", "a\u0085 b\u2028", "a \u2028", "a\x1cb", "x  \r\n\fy", "a b " * 80, "a\u00a0b " * 130, "-", "\ufeff a", "😀 \x00 b"]
    rows = [(i, a, b, c) for i, (a, b, c) in enumerate([(t, "src", "en") for t in odd] + [("some text", t, "en") for t in odd] + [("some text", "src", t) for t in odd] + [(None, None, None), ("", "", "")])]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    columns = ["doc_id", "labelled", "sparse"]
    theirs = con.sql(f"SELECT {', '.join(columns)} FROM ({catalog.ORACLES['model_text']}) ORDER BY doc_id").fetchall()
    assert [tuple(r) for r in catalog.QUERIES["model_text"](spark, str(tmp_path)).select(*columns).orderBy("doc_id").collect()] == theirs
