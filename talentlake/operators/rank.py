"""The best k of many: documents by weighted terms with exact pruning, vectors by blocks of matrix products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import staged

#: Rarest terms of a question by which the first candidates are found; any number gives the same result.
FIRST = 3
#: Vectors in a group of blocks: one task holds two groups.
GROUP_ROWS = 32768


def term_weights(*weighted: tuple[DataFrame, float], key: str) -> DataFrame:
    """(key, term, w): the weights that a question's terms have in all lists, added. Each list is (key, terms: array)."""
    parts = None
    for lists, weight in weighted:
        part = lists.select(key, F.explode(F.array_distinct("terms")).alias("term")).withColumn("w", F.lit(float(weight)))
        parts = part if parts is None else parts.unionByName(part)
    return parts.where("term is not null").groupBy(key, "term").agg(F.sum("w").alias("w"))


def top_by_terms(weights: DataFrame, key: str, docs: DataFrame, doc: str, k: int, first: int = FIRST) -> DataFrame:
    """(key, doc, score, rank): the ``k`` documents (doc, terms: array) with the greatest sum of the weights (key, term, w >= 0) of the
    terms that they share with a question; equal sums by ``doc``. Documents that share nothing are in no list.

    Exact, but common terms are not joined where they cannot matter. A question's terms stand by the number of documents that have them.
    Documents with one of its ``first`` rarest terms are scored; the k-th best of them is a bound that the answer meets. A document
    can only reach it if it has a term from which on all weights together are no less: so postings of these terms alone are joined. Scores of
    candidates come from whole lists of terms."""
    # Both are read many times below; written, the terms of each text are worked out once.
    docs, weights = staged(docs.select(doc, F.array_distinct("terms").alias("terms")), "terms"), staged(weights, "weights")
    asked = staged(docs.select(doc, F.explode("terms").alias("term")).join(weights.select("term").distinct(), "term", "left_semi"), "postings")
    often = asked.groupBy("term").agg(F.count(F.lit(1)).alias("docs"))
    by_rarity = Window.partitionBy(key).orderBy("docs", "term")
    rest = by_rarity.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    placed = weights.join(often, "term").withColumns({"place": F.row_number().over(by_rarity), "reach": F.sum("w").over(rest)})
    whole = placed.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("term", "w"))).alias("_weights"))

    def scored(terms: DataFrame) -> DataFrame:
        pairs = terms.select(key, "term").join(asked, "term").select(key, doc).distinct()
        both = pairs.join(whole, key).join(docs.select(doc, "terms"), doc)
        shared = F.array_intersect(F.map_keys("_weights"), F.col("terms"))
        return both.select(key, doc, F.round(F.aggregate(shared, F.lit(0.0), lambda s, t: s + F.element_at("_weights", t)), 9).alias("score"))

    order = Window.partitionBy(key).orderBy(F.col("score").desc(), doc)
    best = scored(placed.where(F.col("place") <= first)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    bound = best.groupBy(key).agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(0.0).alias("bound"))
    able = placed.join(bound, key, "left").where(F.round("reach", 9) >= F.coalesce("bound", F.lit(0.0)))
    return scored(able).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _blocks(df: DataFrame, key: str, vector: str, rows: int) -> DataFrame:
    """(ids, matrix, n): blocks of normalised vectors as binary; rows without a vector, or of length zero, are left out."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                ids, vectors = part.column(0).to_pylist(), part.column(1).to_pylist()
                kept = [(i, np.asarray(v, np.float64)) for i, v in zip(ids, vectors) if v and None not in v]
                kept = [(i, v / n) for i, v in kept if (n := np.sqrt(v @ v)) > 0]
                if kept:
                    matrix = np.stack([v for _, v in kept])
                    yield pa.RecordBatch.from_arrays([pa.array([[i for i, _ in kept]], pa.list_(pa.int64())), pa.array([matrix.tobytes()], pa.binary()), pa.array([matrix.shape[1]], pa.int32())], ["ids", "matrix", "n"])

    return df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(pack, "ids array<long>, matrix binary, n int")


def _groups(queries: int, vectors: int, tasks: int) -> tuple[int, int]:
    """Into how many groups queries and vectors are dealt: none much above ``GROUP_ROWS``, and enough pairs of groups for all ``tasks``."""
    most = lambda n: max(-(-n // 1024), 1)
    of_queries = max(-(-queries // GROUP_ROWS), min(most(queries), round(tasks**0.5)), 1)
    return of_queries, max(-(-vectors // GROUP_ROWS), min(most(vectors), -(-tasks // of_queries)), 1)


def nearest(queries: DataFrame, vectors: DataFrame, key: str, vector: str, k: int, apart: bool = False, rows: int = 1024) -> DataFrame:
    """(query, id, distance, rank): the ``k`` vectors nearest to each query by cosine distance, equal ones by id. Both tables have
    ``key`` (long) and ``vector`` (equally long arrays); with ``apart`` a row is no neighbour of itself.

    Exact search in blocks: every block of vectors meets every block of queries once, as a product of two matrices of at most
    ``rows`` rows. Blocks are dealt into groups of some ``GROUP_ROWS`` rows; every pair of groups is one part of the grid and hands on ``k``
    for each query; these are merged. A block is exchanged once for each group of the other side and not for each block. Null, empty and zero vectors are
    left out on both sides."""
    tasks = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    of_queries, of_vectors = _groups(queries.count(), vectors.count(), tasks)
    dealt = lambda df, n: _blocks(df, key, vector, rows).withColumn("_g", F.pmod(F.xxhash64("ids"), F.lit(n)).cast("int"))
    asked = dealt(queries, of_queries).withColumn("_h", F.explode(F.sequence(F.lit(0), F.lit(of_vectors - 1))))
    held = dealt(vectors, of_vectors).withColumnRenamed("_g", "_h").withColumn("_g", F.explode(F.sequence(F.lit(0), F.lit(of_queries - 1))))

    def read(blocks: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for i in range(blocks.num_rows):
            n = blocks.column("n")[i].as_py()
            yield np.array(blocks.column("ids")[i].as_py(), np.int64), np.frombuffer(blocks.column("matrix")[i].as_buffer(), np.float64).reshape(-1, n)

    def product(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]]
        others = list(read(right))
        for own, q in read(left):
            # The best so far: place of the query, distance, id; `worst` is the k-th distance of each query.
            at, best, ids, worst = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64), np.full(len(own), np.inf)
            for found, v in others:
                near = q @ v.T
                if apart and np.isin(own, found).any():
                    near[own[:, None] == found[None, :]] = -np.inf
                bound = 1.0 - worst
                if len(found) > k and np.isinf(bound).any():  # the first blocks: a bound by this block alone
                    bound = np.maximum(bound, np.partition(near, len(found) - k, axis=1)[:, len(found) - k])
                # A little more than the bound, as distances are rounded; no similarity is less than -1.
                place = np.flatnonzero(near >= np.maximum(bound - 1e-11, -2.0)[:, None])
                if not len(place):
                    continue
                i, j = np.divmod(place, len(found))
                at, best, ids = np.append(at, i), np.append(best, np.round(1.0 - near[i, j], 12)), np.append(ids, found[j])
                order = np.lexsort((ids, best, at))
                at, best, ids = at[order], best[order], ids[order]
                starts = np.searchsorted(at, np.arange(len(own)))
                nth = np.arange(len(at)) - starts[at]
                worst[at[nth == k - 1]] = best[nth == k - 1]
                at, best, ids = at[nth < k], best[nth < k], ids[nth < k]
            for column, values in zip(out, (own[at], ids, best)):
                column.append(values)
        return pa.table([pa.array(np.concatenate(c)) for c in out], ["query", "id", "distance"])

    each = asked.groupBy("_g", "_h").cogroup(held.groupBy("_g", "_h")).applyInArrow(product, "query long, id long, distance double")
    first = Window.partitionBy("query").orderBy("distance", "id")
    return each.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)


def with_documents(hits: DataFrame, chunks: DataFrame, documents: DataFrame, chunk: str, document: str) -> DataFrame:
    """Hits with their chunk and its document: joined after the cut to k, so that few rows meet the large tables. Hits whose chunk or
    document is not there are left out, as an inner join of all three does."""
    return hits.withColumnRenamed("id", chunk).join(chunks, chunk).join(documents, document)


def nearest_documents(hits: DataFrame, document: str, k: int) -> DataFrame:
    """The ``k`` documents of each query by their nearest chunk (query, distance, ``document``...): rank anew, equal ones by document."""
    best = Window.partitionBy("query", document).orderBy("distance", "rank")
    one = hits.withColumn("_nth", F.row_number().over(best)).where("_nth = 1").drop("_nth", "rank")
    return one.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("distance", document))).where(F.col("rank") <= k)
