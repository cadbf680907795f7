"""Evaluation: ranking, retrieval, agreement, calibration, stability, coverage, grounding, latency."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import ratio
from ..storage import staged
from .ordinals import average_ranks, prefix_sums

#: Short rows that a task sorts: some 100 MB.
TASK_ROWS = 500_000


def dealt(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """``df`` of some ``rows`` dealt by ``keys``, into more parts where there are more rows, so that what a task holds does not grow with the table.
    Left to itself Spark joins parts up to so many bytes, in which millions of short rows fit."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS)), *keys)


def ranking_metrics(predictions: DataFrame, qrels: DataFrame, group: list[str], item: str, k: int, size: int | None = None) -> DataFrame:
    """Per list (``group``): precision, recall, hit, reciprocal rank and NDCG at ``k``. predictions(group, item, rank),
    qrels(group without method, item, relevance). NDCG's ideal order is that of the retrieved gains. Of repeated judgements
    the last one counts by the column ``order`` if qrels have it, else the highest; an item that a list repeats counts each time. ``size``
    is how many predictions and judgements there are, counted if it is not given; it decides into how many parts they are dealt."""
    keys = [g for g in group if g in qrels.columns]
    order = F.col("order") if "order" in qrels.columns else F.lit(None).cast("int")
    lists = predictions.where(F.col("rank") <= k)
    asked = qrels.select(*keys, item, "relevance", order.alias("_order"), F.lit(True).alias("_judged")).dropna(subset=keys)  # null is no list's key
    # Lists and judgements of a key meet in one exchange and are sorted there; a hash table of all keys and items has no bound.
    rows = dealt(lists.withColumn("_judged", F.lit(False)).unionByName(asked, allowMissingColumns=True), keys, predictions.count() + qrels.count() if size is None else size)
    here = Window.partitionBy(*keys, item).orderBy(F.col("_judged").desc())
    every = here.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = F.max_by("relevance", "_order") if "order" in qrels.columns else F.max("relevance")
    rows = rows.withColumns({"_rel": last.over(every), "_nth": F.row_number().over(here)})
    relevant = F.sum(F.when(F.col("_judged") & (F.col("_nth") == 1) & (F.col("_rel") > 0), 1)).over(Window.partitionBy(*keys))
    rows = rows.withColumn("relevant", relevant).where(~F.col("_judged")).withColumn("rel", F.coalesce(F.when(F.col(item).isNotNull(), F.col("_rel")), F.lit(0)))
    gain = F.pow(F.lit(2.0), F.col("rel")) - 1.0
    best = Window.partitionBy(*group).orderBy(F.col("rel").desc(), F.col("rank"))
    rows = rows.withColumn("ideal", F.row_number().over(best))
    out = rows.groupBy(*group).agg(
        F.sum((F.col("rel") > 0).cast("long")).alias("hits"), F.min(F.when(F.col("rel") > 0, F.col("rank"))).alias("first_hit"),
        F.sum(gain / F.log2(F.col("rank") + 1.0)).alias("dcg"), F.sum(gain / F.log2(F.col("ideal") + 1.0)).alias("idcg"),
        F.max("relevant").alias("relevant"),
    )
    return out.select(
        *group, (F.col("hits") / float(k)).alias("precision"), ratio(F.col("hits"), F.col("relevant")).alias("recall"), (F.col("hits") > 0).cast("double").alias("hit"),
        F.coalesce(1.0 / F.col("first_hit"), F.lit(0.0)).alias("mrr"), ratio(F.col("dcg"), F.nullif(F.col("idcg"), F.lit(0.0))).alias("ndcg"),
    )


def calibration(df: DataFrame, by: str, predicted: str, human: str, tolerance: float) -> DataFrame:
    """Per group: Pearson, Spearman (average ranks), MAE, RMSE, share within tolerance; 0 where a correlation is undefined.

    Rows without either score do not count. Equal pairs of scores are counted first and weigh as many; ranks come from
    ``ordinals.average_ranks``, so no group has to fit into one task."""
    pairs = df.where(F.col(predicted).isNotNull() & F.col(human).isNotNull())
    cells = staged(pairs.groupBy(F.col(by).alias("_g"), F.col(predicted).cast("double").alias("_x"), F.col(human).cast("double").alias("_y")).agg(F.count(F.lit(1)).alias("_w")), "calibration")
    for value, rank in (("_x", "_rx"), ("_y", "_ry")):
        ranks = average_ranks(pairs.select(F.col(by).alias("_h"), F.col(predicted if value == "_x" else human).cast("double").alias("_v")), ["_h"], "_v", rank).drop("n")
        cells = cells.join(ranks, F.col("_g").eqNullSafe(F.col("_h")) & (F.col(value) == F.col("_v"))).drop("_h", "_v")
    mean = lambda c: F.try_divide(F.sum(F.col(c) * F.col("_w")), F.sum("_w"))
    centres = cells.groupBy("_g").agg(*[mean(c).alias(f"{c}_m") for c in ("_x", "_y", "_rx", "_ry")]).withColumnRenamed("_g", "_k")
    d = cells.join(centres, F.col("_g").eqNullSafe(F.col("_k")))
    w, error = F.col("_w"), F.col("_x") - F.col("_y")

    def correlation(a: str, b: str) -> Column:
        x, y = F.col(a) - F.col(f"{a}_m"), F.col(b) - F.col(f"{b}_m")
        return F.coalesce(F.try_divide(F.sum(w * x * y), F.sqrt(F.sum(w * x * x)) * F.sqrt(F.sum(w * y * y))), F.lit(0.0))

    return d.groupBy(F.col("_g").alias(by)).agg(
        correlation("_x", "_y").alias("pearson"), correlation("_rx", "_ry").alias("spearman"), (F.sum(w * F.abs(error)) / F.sum(w)).alias("mae"),
        F.sqrt(F.sum(w * error * error) / F.sum(w)).alias("rmse"), (F.sum(w * (F.abs(error) <= tolerance).cast("double")) / F.sum(w)).alias("within"),
    )


def stability(df: DataFrame, by: str, score: Column, grade: Column) -> DataFrame:
    """Per group: runs, population deviation, range, coefficient of variation, whether the grade ever changed."""
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("runs"), F.stddev_pop(score).alias("std"), (F.max(score) - F.min(score)).alias("spread"),
        F.coalesce(F.try_divide(F.stddev_pop(score), F.avg(score)), F.lit(0.0)).alias("cv"), (F.countDistinct(grade) > 1).alias("grade_changed"),
    )


def coverage(predictions: DataFrame, catalog_size: int, method: str, list_id: str, item: str, k: int) -> DataFrame:
    """Per method: distinct items within the first ``k`` of each list, as a share of the catalog."""
    top = predictions.where(F.col("rank") <= k)
    return top.groupBy(method).agg(F.countDistinct(item).alias("items"), F.countDistinct(list_id).alias("lists"), (F.countDistinct(item) / float(catalog_size)).alias("coverage"))


def novelty(predictions: DataFrame, method: str, item: str) -> DataFrame:
    """Per method: the mean of -log2 of an item's share of all recommendations."""
    shares = predictions.groupBy(method, item).agg(F.count(F.lit(1)).alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy(method))
    return shares.withColumn("bits", -F.log2(p)).groupBy(method).agg((F.sum(F.col("bits") * F.col("n")) / F.sum("n")).alias("novelty"))


def diversity(predictions: DataFrame, method: str, list_id: str, family: str, k: int) -> DataFrame:
    """Per method: the mean share of distinct families in a list's first ``k``."""
    lists = predictions.where(F.col("rank") <= k).groupBy(method, list_id).agg((F.countDistinct(family) / F.count(F.lit(1))).alias("d"))
    return lists.groupBy(method).agg(F.avg("d").alias("diversity"))


def latency(df: DataFrame, by: str, value: Column) -> DataFrame:
    """Per group: n and exact interpolated p50, p95, p99."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *[F.percentile(value, F.lit(p)).alias(name) for p, name in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"))])


def field_accuracy(df: DataFrame, field: str, kind: str, score: Column) -> DataFrame:
    """The mean score by field and over all, in one pass with grouping sets: the overall row has null keys."""
    rows = df.select(field, kind, score.alias("score"))
    return rows.groupingSets([[field, kind], []], field, kind).agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("accuracy"))


def retrieval_metrics(hits: DataFrame, relevant: DataFrame, query: str, item: str, ks: list[int]) -> DataFrame:
    """query, k, precision, recall, hit, mrr for each cut-off: hits(query, item, rank) against the set relevant(query, item)."""
    total = relevant.groupBy(query).agg(F.countDistinct(item).alias("total"))
    found = hits.join(relevant.select(query, item, F.lit(1).alias("good")).distinct(), [query, item], "left")
    cuts = found.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).where(F.col("rank") <= F.col("k"))
    g = cuts.groupBy(query, "k").agg(F.count("good").alias("n"), F.min(F.when(F.col("good") == 1, F.col("rank"))).alias("first"))
    return g.join(total, query, "left").select(
        query, "k", ratio(F.col("n"), F.col("k")).alias("precision"), ratio(F.col("n"), F.col("total")).alias("recall"),
        (F.col("n") > 0).cast("double").alias("hit"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"),
    )


#: Values that a sketch keeps at most in a level. Up to as many values it is exact; beyond, the rank of an answer is wrong by less than
#: SKETCH_ERROR of all values, with a probability of 99 in 100.
SKETCH_K = 4096
SKETCH_ERROR = 0.0011


def quantile_sketches(df: DataFrame, groups: list[str], value: Column, k: int = SKETCH_K) -> DataFrame:
    """``groups``, n, sketch: a mergeable sketch of the values of each group, as binary; null values do not count. Each task
    sketches what it has, so only sketches are exchanged. Keep one row per day and merge the days that are asked for."""
    rows = df.select(*groups, value.cast("double").alias("_v")).where("_v is not null")
    return rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double("_v", F.lit(k)).alias("sketch"))


def merge_sketches(sketches: DataFrame, groups: list[str]) -> DataFrame:
    """``groups``, n, sketch of finer ones, such as days into a month."""
    return sketches.groupBy(*groups).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))


def sketched_quantiles(sketches: DataFrame, groups: list[str], shares: dict[str, float]) -> DataFrame:
    """``groups``, n and a column for each share: the least value that so many are no larger than, by the sketch."""
    return sketches.select(*groups, "n", *[F.kll_sketch_get_quantile_double("sketch", F.lit(p)).alias(name) for name, p in shares.items()])


def exact_quantiles(df: DataFrame, sketches: DataFrame, group: str, value: Column, shares: dict[str, float]) -> DataFrame:
    """``group``, n and a column for each share: the least value of ``df`` that so many are no larger than, exactly; null values do not count.

    ``sketches`` (group, n, sketch) are those of the same values: they say between which two values an answer should lie, with three
    times their error to either side. One pass then counts what lies below and keeps what lies between, some hundredth of all. Where
    a sketch was wrong, or has no room to a side, all of the group's values are looked at, so the result never depends on it."""
    rows = df.select(F.col(group).alias("_g"), value.cast("double").alias("_v")).where("_v is not null")
    at = lambda p: F.kll_sketch_get_quantile_double("sketch", F.lit(p))
    marks = []
    for name, p in shares.items():
        low, high = p - 3 * SKETCH_ERROR, p + 3 * SKETCH_ERROR
        low, high = at(low) if low > 0 else F.lit(None).cast("double"), at(high) if high < 1 else F.lit(None).cast("double")
        marks.append(F.struct(F.lit(name).alias("name"), F.ceil(F.col("n").cast("decimal(20,0)") * F.lit(Decimal(str(p)))).cast("long").alias("nth"), low.alias("low"), high.alias("high")))
    asked = staged(sketches.select(F.col(group).alias("_h"), F.explode(F.array(*marks)).alias("m")).select("_h", "m.*"), "quantile-marks")

    def found(marks: DataFrame) -> DataFrame:
        """_h, name, nth, and the value at that place (null where it lies outside the marks)."""
        met = rows.join(F.broadcast(marks), F.col("_g").eqNullSafe(F.col("_h")))  # a row for each group and share
        below, above = F.coalesce(F.col("_v") < F.col("low"), F.lit(False)), F.coalesce(F.col("_v") > F.col("high"), F.lit(False))
        cells = met.where(~above).groupBy("_h", "name", F.when(~below, F.col("_v")).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
        placed = prefix_sums(cells, ["_h", "name"], ["_v"], "_n", "_before", "quantiles")  # what lies below is the null before all
        named = marks.select(F.col("_h").alias("_k"), F.col("name").alias("_name"), "nth")
        hit = placed.join(F.broadcast(named), F.col("_h").eqNullSafe(F.col("_k")) & (F.col("name") == F.col("_name")))
        here = F.col("_v").isNotNull() & (F.col("_before") < F.col("nth")) & (F.col("nth") <= F.col("_before") + F.col("_n"))
        return hit.groupBy("_h", "name").agg(F.max(F.when(here, F.col("_v"))).alias("answer"))

    first = staged(found(asked), "quantile-answers")
    answers = first.where("answer is not null")
    had = answers.select(F.col("_h").alias("_b"), F.col("name").alias("_had"))
    left = asked.join(had, F.col("_h").eqNullSafe(F.col("_b")) & (F.col("name") == F.col("_had")), "left_anti")
    if not left.isEmpty():
        open_ = staged(left.withColumns({c: F.lit(None).cast("double") for c in ("low", "high")}), "quantile-open")
        answers = answers.unionByName(found(open_))
    wide = answers.groupBy("_h").agg(*[F.max(F.when(F.col("name") == name, F.col("answer"))).alias(name) for name in shares])
    return sketches.select(group, "n").join(wide, F.col(group).eqNullSafe(F.col("_h"))).select(group, "n", *shares)
