"""Distributed numbering, prefix sums and ranks against plain Python."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from talentlake.operators import metrics, ordinals


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    groups = ["hot"] * 600 + ["a"] * 40 + [None] * 30 + ["b"]
    return [(i, g, rng.choice([None, 1.0, 2.5, 2.5, 7.0, rng.random()]), rng.randint(0, 9)) for i, g in enumerate(groups)]


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "id long, g string, v double, n int").repartition(7)


def test_numbers_are_gapless_in_order(df, rows):
    want, seen = {}, collections.Counter()
    for i, g, *_ in sorted(rows, key=lambda r: -r[0]):
        seen[g] += 1
        want[i] = seen[g]
    assert {r.id: r.k for r in ordinals.numbered(df, ["g"], [F.col("id").desc()], "k").collect()} == want


def test_one_group_over_all(df, rows):
    got = [r.id for r in sorted(ordinals.numbered(df, [], ["n", "id"], "k").collect(), key=lambda r: r.k)]
    assert got == [r[0] for r in sorted(rows, key=lambda r: (r[3], r[0]))]


def test_prefix_sums(df, rows):
    want, seen = {}, collections.Counter()
    for i, g, _, n in sorted(rows):
        want[i] = seen[g]
        seen[g] += n
    assert {r.id: r.s for r in ordinals.prefix_sums(df, ["g"], ["id"], "n", "s").collect()} == want


def test_average_ranks(df, rows):
    want = {}
    for g in {r[1] for r in rows}:
        values = sorted(r[2] for r in rows if r[1] == g and r[2] is not None)
        for v in set(values):
            at = [k for k, x in enumerate(values, 1) if x == v]
            want[g, v] = (len(at), sum(at) / len(at))
    assert {(r.g, r.v): (r.n, r.rank) for r in ordinals.average_ranks(df, ["g"], "v", "rank").collect()} == want


def test_unique_ids(df, rows):
    got = {r.id: r.u for r in ordinals.unique_ids(df, "g", ["id"], "u").collect()}
    assert got[0] == "hot" and got[1] == "hot_2" and got[599] == "hot_600" and got[640] is None and len({u for u in got.values() if u}) == 641


def test_empty_tables(df):
    none = df.limit(0)
    assert ordinals.numbered(none, ["g"], ["id"], "k").count() == 0
    assert ordinals.average_ranks(none, ["g"], "v", "rank").count() == 0
    assert metrics.calibration(none, "g", "v", "n", 1.0).count() == 0


def test_no_group_is_one_task(df):
    """The only windows are over the small table of ranges, or within one range."""
    plan = ordinals.numbered(df, ["g"], ["id"], "k")._jdf.queryExecution().toString()
    assert "Window" in plan and "_ord_part" in plan.split("Window", 1)[1]


def test_calibration_with_constant_sides(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0)] * 5 + [("b", float(i), float(i * i)) for i in range(9)], "g string, p double, h double")
    got = {r.g: r for r in metrics.calibration(df, "g", "p", "h", 1.0).collect()}
    assert got["a"].pearson == got["a"].spearman == 0.0 and got["a"].mae == 1.0 and got["a"].within == 1.0
    assert abs(got["b"].spearman - 1.0) < 1e-9 and 0.9 < got["b"].pearson < 1.0
