"""Numbers, prefix sums and ranks within groups, however large a group is.

A window function puts a group into one task. Here rows are dealt by ranges of (group, order), so that a hot group spans many
tasks; each task places its own rows, a small table of (group, range) has how many came before, and a place in the group is the
sum of both. That table has at most one row for each range and one for each group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import staged

#: `monotonically_increasing_id` has the partition above these bits and the place in it below.
_BITS = 33
AT, PART, START, BEFORE = "_ord_at", "_ord_part", "_ord_start", "_ord_before"


def _ranges(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` sorted over all partitions, written, with a place that rises in that order."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return staged(rows.withColumn(AT, F.monotonically_increasing_id()), name).withColumn(PART, F.shiftright(AT, _BITS))


def _with_before(rows: DataFrame, groups: list[str], amount: Column) -> DataFrame:
    """``rows`` with the first place of their group in their range and what the group has in the ranges before."""
    parts = rows.groupBy(*groups, PART).agg(F.min(AT).alias(START), F.sum(amount).alias("_n"))
    earlier = Window.partitionBy(*groups).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    parts = parts.withColumn(BEFORE, F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    parts = parts.toDF(*[f"_ord_{i}" for i in range(len(groups))], PART + "_", START, BEFORE)
    same = F.col(PART) == F.col(PART + "_")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_ord_{i}"))
    return rows.join(parts, same).drop(*[f"_ord_{i}" for i in range(len(groups))], PART + "_")


def _sorting(groups: list[str], order: list[Column | str]) -> list[Column]:
    return [F.col(g).asc_nulls_first() for g in groups] + [F.col(o).asc_nulls_first() if isinstance(o, str) else o for o in order]


def numbered(df: DataFrame, groups: list[str], order: list[Column | str], out: str, name: str = "ordinals") -> DataFrame:
    """``df`` with ``out``: 1, 2, 3... within each group in ``order`` (names ascend with nulls first).

    Null group values are one group. Rows that are equal in ``order`` get neighbouring numbers in any order, and lie in one
    task: end the order with a key that tells rows apart. An empty table stays empty."""
    rows = _with_before(_ranges(df, _sorting(groups, order), name), groups, F.lit(1).cast("long"))
    return rows.withColumn(out, (F.col(AT) - F.col(START) + F.col(BEFORE) + 1).cast("long")).drop(AT, PART, START, BEFORE)


def prefix_sums(df: DataFrame, groups: list[str], order: list[Column | str], amount: str, out: str, name: str = "prefix") -> DataFrame:
    """``df`` with ``out``: the sum of ``amount`` (longs, null: 0) over the rows of the group that come earlier in ``order``."""
    n = F.coalesce(F.col(amount).cast("long"), F.lit(0))
    rows = _with_before(_ranges(df, _sorting(groups, order), name), groups, n)
    within = Window.partitionBy(*groups, PART).orderBy(AT).rowsBetween(Window.unboundedPreceding, -1)  # one range of one group
    return rows.withColumn(out, (F.coalesce(F.sum(n).over(within), F.lit(0)) + F.col(BEFORE)).cast("long")).drop(AT, PART, START, BEFORE)


def average_ranks(df: DataFrame, groups: list[str], value: str, out: str) -> DataFrame:
    """One row per distinct ``value`` of each group: groups, value, n and ``out``, the mean of the ranks (from 1) of its rows.

    Equal values are counted before anything is exchanged, so a value that a third of all rows has is one row here. Null values
    have no rank and no row; a null group is a group."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("n"))
    ranked = prefix_sums(counts, groups, [value], "n", "_before", "ranks")
    return ranked.withColumn(out, F.col("_before") + (F.col("n") + 1) / 2.0).drop("_before")


def unique_ids(df: DataFrame, id_: str, order: list[Column | str], out: str, joint: str = "_") -> DataFrame:
    """``df`` with ``out``: ``id_``, with _2, _3... behind it from its second row in ``order`` on. Null ids stay null."""
    nth = "_ord_nth"
    rows = numbered(df, [id_], order, nth, "ids")
    return rows.withColumn(out, F.when(F.col(nth) == 1, F.col(id_).cast("string")).otherwise(F.concat(F.col(id_).cast("string"), F.lit(joint), F.col(nth).cast("string")))).drop(nth)
