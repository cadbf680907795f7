"""Importance resampling towards a target distribution.

Documents and target texts are bags of hashed word n-grams. Their postings (bucket, document, count) are exchanged by ranges of
buckets, so that a task holds the same buckets of both corpora: it counts them locally, the counts of a bucket's salts are
added, and each bucket gets its gain, the log ratio of its shares in both corpora. The same exchanged postings then meet the
gains of their range, emit what each bucket contributes to each document, and contributions are reduced by document.

A posting is a 16-bit code (place of the document in its block, count; a larger count is several codes), sorted by bucket: a block of
documents sends one row to each range of buckets. Blocks are bounded in bytes and rows. The gains are BUCKETS
numbers, a bound that does not depend on the data, and so are all that is broadcast.

The highest scores are found by ``ordinals.numbered``: no task sorts all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordinals import numbered
from .common import cut, map_text

BUCKETS, RANGES, NGRAM = 10_000, 16, 3
#: A code has the place of a document in its block above these bits and a count below.
COUNT_BITS, BLOCK_ROWS = 5, 1 << 11
MOST = (1 << COUNT_BITS) - 1
#: Words of a long text that are hashed at a time.
PIECE = 1 << 18
#: Everything but digits, a-z and bytes of characters beyond ASCII parts words; A-Z are lower-cased.
_TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def feature_buckets(text: bytes | None, buckets: int = BUCKETS, most: int = NGRAM) -> tuple[int, np.ndarray]:
    """The number of words of a text, and the buckets of all its runs of 1 to ``most`` words, repeats included."""
    words = text.translate(_TABLE).split() if text else []
    found = []
    for start in range(0, len(words), PIECE):
        part = words[start : start + PIECE + most - 1]  # runs may end in the next piece, but begin in this one
        follow = [b" " + w for w in part]
        sums = list(map(crc32, part))
        for n in range(1, most + 1):
            found.append(np.array(sums[:PIECE], np.uint32))
            sums = list(map(crc32, follow[n:], sums))  # CRC-32 goes on where that of the shorter run ended
    return len(words), (np.concatenate(found) % buckets).astype(np.int64) if found else np.empty(0, np.int64)


def _postings(rows: DataFrame, buckets: int, ranges: int, salts: int) -> DataFrame:
    """A row per block of documents and range of buckets: part, salt, target, block, counts (postings of each bucket of the range),
    codes; and with part 0 the block's ids, words and features."""
    width = -(-buckets // ranges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 20
        for batch in batches:
            target = batch.column("target").to_pylist()
            texts = [t for t in batch.column("text").cast(pa.binary()).to_pylist()]
            for wanted in (False, True):  # a block is of one corpus
                at = [i for i, t in enumerate(target) if t == wanted]
                for start in range(0, len(at), BLOCK_ROWS):
                    chosen = at[start : start + BLOCK_ROWS]
                    n_words, n_features, keys = [], [], []
                    for place, i in enumerate(chosen):
                        words, found = feature_buckets(texts[i], buckets)
                        n_words.append(words)
                        n_features.append(len(found))
                        keys.append(found * BLOCK_ROWS + place)
                    key, count = np.unique(np.concatenate(keys), return_counts=True)
                    if (count > MOST).any():  # large counts become several codes
                        whole = (count - 1) // MOST
                        count = np.concatenate([count - whole * MOST, np.full(whole.sum(), MOST)])
                        key = np.concatenate([key, np.repeat(key, whole)])
                        order = np.argsort(key, kind="stable")
                        key, count = key[order], count[order]
                    bucket = key // BLOCK_ROWS
                    codes = ((key % BLOCK_ROWS) << COUNT_BITS | count).astype(np.uint16)
                    cuts = np.searchsorted(bucket, np.arange(ranges + 1) * width)
                    out = {"part": [], "counts": [], "codes": []}
                    for p in range(ranges):
                        own = slice(cuts[p], cuts[p + 1])
                        out["part"].append(p)
                        out["counts"].append(np.bincount(bucket[own] - p * width, minlength=width).astype(np.uint32).tobytes())
                        out["codes"].append(codes[own].tobytes())
                    facts = lambda v: pa.array([v] + [None] * (ranges - 1), pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(out["part"], pa.int32()), pa.array([block % salts] * ranges, pa.int32()), pa.array([wanted] * ranges), pa.array([block] * ranges, pa.int64()),
                            pa.array(out["counts"], pa.binary()), pa.array(out["codes"], pa.binary()), facts([batch.column("doc_id")[i].as_py() for i in chosen]), facts(n_words), facts(n_features),
                        ],
                        ["part", "salt", "target", "block", "counts", "codes", "ids", "words", "features"],
                    )
                    block += 1

    schema = "part int, salt int, target boolean, block long, counts binary, codes binary, ids array<long>, words array<long>, features array<long>"
    return map_text(rows, run, schema).repartition(ranges * salts, "part", "salt")


def _decoded(counts: bytes, codes: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bucket in its range, the place of the document and the count of each posting."""
    counts, codes = np.frombuffer(counts, np.uint32), np.frombuffer(codes, np.uint16)
    return np.repeat(np.arange(len(counts)), counts), (codes >> COUNT_BITS).astype(np.int64), (codes & MOST).astype(np.int64)


def _counted(postings: DataFrame, buckets: int, ranges: int) -> DataFrame:
    """(bucket, s, t): how often each bucket occurs in the documents and in the target, buckets that do not occur too."""
    width = -(-buckets // ranges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, bool], np.ndarray] = {}
        for batch in batches:
            for part, target, counts, codes in zip(*(batch.column(c).to_pylist() for c in ("part", "target", "counts", "codes"))):
                bucket, _, count = _decoded(counts, codes)
                own = sums.setdefault((part, target), np.zeros(width, np.int64))
                own += np.bincount(bucket, weights=count, minlength=width).astype(np.int64)
        for (part, target), own in sums.items():
            n, zero = pa.array(own), pa.array(np.zeros(width, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width) + part * width), zero if target else n, n if target else zero], ["bucket", "s", "t"])

    sums = postings.mapInArrow(run, "bucket long, s long, t long").groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    every = postings.sparkSession.range(buckets).select(F.col("id").alias("bucket"))
    return every.join(sums, "bucket", "left").select("bucket", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("s", "t")])


def _gains(counted: DataFrame, buckets: int, ranges: int) -> DataFrame:
    """(part, gains): the gain of each bucket of a range, in order."""
    width, smooth = -(-buckets // ranges), float(buckets)
    totals = counted.agg(F.sum("s").cast("double").alias("all_s"), F.sum("t").cast("double").alias("all_t"))
    s, t = F.col("s").cast("double"), F.col("t").cast("double")
    ratio = (t + 1.0) * (F.col("all_s") + smooth) / ((s + 1.0) * (F.col("all_t") + smooth))
    rows = counted.crossJoin(F.broadcast(totals)).select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("gain"))
    by_part = rows.groupBy(F.floor(F.col("bucket") / width).cast("int").alias("part"))
    return by_part.agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "gain"))), lambda x: x["gain"]).alias("gains"))


def _contributions(postings: DataFrame, gains: DataFrame) -> DataFrame:
    """(row, doc_id, n_words, n_features, weight): what each range of buckets adds to each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                bucket, place, count = _decoded(r["counts"], r["codes"])
                gain = np.zeros(len(r["counts"]) // 4, np.int64)
                gain[: len(r["gains"])] = r["gains"]
                known = r["ids"] is not None
                n = len(r["ids"]) if known else int(place.max()) + 1 if len(place) else 0
                weight = np.bincount(place, weights=gain[bucket] * count, minlength=n).astype(np.int64)  # whole numbers far below 2^53
                at = np.arange(n) if known else np.flatnonzero(np.bincount(place, minlength=n))
                facts = [pa.array(r[c] if known else [None] * len(at), pa.int64()) for c in ("ids", "words", "features")]
                yield pa.RecordBatch.from_arrays([pa.array(r["block"] * BLOCK_ROWS + at), *facts, pa.array(weight[at])], ["row", "doc_id", "n_words", "n_features", "weight"])

    return postings.where(~F.col("target")).join(F.broadcast(gains), "part").mapInArrow(run, "row long, doc_id long, n_words long, n_features long, weight long")


def importance_weights(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, ranges: int = RANGES) -> DataFrame:
    """One row per row of ``docs``: row (a number of its own), doc_id, n_words, n_features, weight.

    Words are runs of digits, letters a-z (A-Z count as these) and characters beyond ASCII; features all runs of 1 to 3 words,
    joined by a space; a feature's bucket is its CRC-32 modulo ``buckets``. A bucket with s of all S features of the documents
    and t of all T of ``target`` (column text) gains floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))); weight is the sum over the document's
    features, 0 without any. Null texts have no words. An empty target leaves T and t at 0."""
    salts = max(1, -(-int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // ranges))
    both = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.lit(False).alias("target"))
    both = both.unionByName(target.select(F.lit(None).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.lit(True).alias("target")))
    postings = _postings(both, buckets, ranges, salts)
    each = _contributions(postings, _gains(_counted(postings, buckets, ranges), buckets, ranges))
    return each.groupBy("row").agg(*[F.max(c).alias(c) for c in ("doc_id", "n_words", "n_features")], F.sum("weight").alias("weight"))


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_features, weight, score, rank; ranks 1, 2, 3... are those drawn, the others null.

    score is the weight and a Gumbel variate from sha256 of "seed:doc_id" (null id: nothing behind the colon), so that taking the highest
    scores draws without replacement in proportion to exp(weight / 1000). Of the N rows with at least ``least_words`` words the
    floor(percent N / 100) highest are drawn; ties go to the smaller doc_id, null ids last. Rows that repeat a doc_id are drawn each
    for itself. An empty table gives an empty result; other columns are ignored."""
    weights = importance_weights(docs, target)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")
    scored = cut(weights.withColumn("score", F.col("weight") + noise), "resample-scored")
    able = scored.where(F.col("n_words") >= least_words)
    drawn = able.agg(F.floor(F.count(F.lit(1)) * percent / 100).cast("long").alias("drawn"))
    placed = numbered(able, [], [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "row"], "place", "resample-places").crossJoin(F.broadcast(drawn))
    rank = F.when(F.col("place") <= F.col("drawn"), F.col("place"))
    out = placed.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))
    return out.unionByName(scored.where(F.col("n_words") < least_words).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank")))
