"""Exact dedup by skew-safe combining.

Texts are equal when they are identical after lower-casing A-Z. Three stages, each of which groups by the
digest *and* the whole text, so that no decision rests on a hash alone:

1. every task combines its own rows (Spark's partial aggregation before the exchange),
2. what is left is merged by (digest, salt); only digests that hold more than 1/1000 of all rows are
   salted, so there are never 1000 of them, which is what bounds the table that is broadcast,
3. the salt winners of those digests are combined globally.

The text crosses the network once. Rows get their verdict by a join on the digest, in which Spark can split
a hot key; digests that stand for several texts (a hash collision) are resolved by comparing the texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut, free_name

SALTS = 32
HOT_SHARE = 1000


def duplicate_classes(docs: DataFrame, digest_chars: int = 64) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    ``digest_chars`` is how many characters of the SHA-256 group the texts; fewer make collisions, which the
    comparison of whole texts resolves (used in tests).

    Null text counts as the empty text. A null doc_id is smaller than any other; a group of nothing but null
    ids has keep_id null and all its rows ``kept``. Rows that repeat both doc_id and text carry the same
    verdict, and group_size counts each. An empty table gives an empty result; other columns are ignored."""
    text = ascii_lower(F.coalesce(F.col("text"), F.lit("")))
    rows = docs.select("doc_id", text.alias("norm")).withColumn("sha", F.sha2("norm", 256)).withColumn("digest", F.substring("sha", 1, digest_chars))
    narrow = cut(rows.select("doc_id", "sha", "digest"), "exact-digests")
    total = narrow.count()
    hot = narrow.groupBy("digest").count().where(F.col("count") * HOT_SHARE > total).select("digest", F.lit(True).alias("hot"))
    salted = (
        rows.join(F.broadcast(hot), "digest", "left")  # under HOT_SHARE rows by its definition
        .withColumn("salt", F.when(F.col("hot"), F.spark_partition_id() % SALTS).otherwise(F.lit(-1)))
        .groupBy("digest", "norm", "salt")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    )
    # Cold digests have one salt: each of their rows here is one whole text already.
    merged = cut(salted.select("digest", "salt", F.when(F.col("salt") >= 0, F.col("norm")).alias("norm"), "keep_id", "n"), "exact-merged")
    winners = merged.where("salt < 0").select("digest", "keep_id", "n").unionByName(
        merged.where("salt >= 0").groupBy("digest", "norm").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("n")).drop("norm")
    )
    classes = cut(winners.groupBy("digest").agg(F.count(F.lit(1)).alias("texts"), F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size")), "exact-classes")
    plain = narrow.join(classes.where("texts = 1"), "digest").select("doc_id", "keep_id", "group_size", "sha")
    shared = classes.where("texts > 1").select("digest")
    if not shared.isEmpty():
        clash = rows.join(shared, "digest", "left_semi")
        own = clash.groupBy("norm").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        plain = plain.unionByName(clash.join(own, "norm").select("doc_id", "keep_id", "group_size", "sha"))
    return plain.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of equal texts the one with the largest doc_id.

    Of rows that repeat both doc_id and text one stays, any of them where other columns differ. Null texts
    count as empty; extra columns are kept whatever their names."""
    key, sha, keep = free_name(docs, "dedup_key", "dedup_sha", "dedup_keep")
    stays = duplicate_classes(docs).where("kept").groupBy(F.col("text_sha256").alias(sha), F.col("keep_id").alias(keep))
    stays = cut(stays.agg(F.count(F.lit(1)).alias("rows")), "exact-stays")
    keyed = docs.withColumn(key, F.sha2(ascii_lower(F.coalesce(F.col("text"), F.lit(""))), 256))

    def of(verdict: DataFrame) -> DataFrame:
        return keyed.join(verdict.select(sha, keep), (F.col(key) == F.col(sha)) & F.col("doc_id").eqNullSafe(F.col(keep)), "left_semi")

    best, repeated = of(stays.where("rows = 1")), stays.where("rows > 1")
    if not repeated.isEmpty():  # rows that repeat doc_id and text: only they cross the network again
        best = best.unionByName(of(repeated).dropDuplicates([key, "doc_id"]))
    return best.drop(key)
