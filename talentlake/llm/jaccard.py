"""The similarity mode of near dedup: every pair of texts with a Jaccard similarity of at least LEAST is found, and no other, but
for errors of 64-bit hashes.

A text is the set of its 5-word shingles (64-bit hashes). Two sets that are similar enough share a shingle among the first
of either in one global order, rare ones first (by their counts in a bounded sample; any order is right, this one only
keeps hot shingles out). So each of those shingles makes a shard of the sets that hold it.

Jaccard distance is a metric, and shards with many members are searched by vantage points: the member with the least hash is
compared with all others (whole sets, a number of pairs linear in the shard). Members close to it are one component at once.
The largest component of a shard never meets itself again: only members of the others are joined with all, and of these
pairs only those are looked at that the triangle bound (the distances from the vantage point differ by no more than the
radius) leaves. Counts and places of common shingles rule many of them out, a bit for each class of shingles nearly all others, and
whole sets decide about the rest. A dense group of n copies so costs about n rows and comparisons, not its square; copies that stay
outside its component are each joined with all.

Texts that share a rare shingle by chance are pairs too, and these grow faster than the texts. So no whole set is exchanged for
a pair before the bits have let it through: a class that only one of two sets has is a shingle that only one has.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name, free_shuffles, map_text, release
from .components import components

SHINGLE = 5
#: The least similarity as a fraction, so that bounds are whole numbers.
LEAST = (4, 5)
#: Documents whose shingles are counted for the order: one of SHARE, but at least and at most so many; how often one must be there
#: to be kept; most that are kept.
SHARE, SAMPLE_RANGE, OFTEN, KEPT = 16, (1 << 13, 1 << 17), 3, 1 << 19
#: Least classes of a set's shingles; a larger set has a power of two of at least its size.
CLASSES = 256
#: Numbers that the rows of texts are dealt into, to exchange only those whose number is asked for: a bound of what is broadcast.
BUCKETS = 1 << 20
#: First shingles are exchanged in so many goes, a share of all shingles in each, so that they are never on disk all at once.
GOES = 2
#: Shards with more members have a vantage point.
CROWD = 32
ALIKE = 4


def shingles(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted. A text of fewer words is one shingle, an empty one too."""
    words = text.lower().split() if text else []
    line = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(line, 42)], np.uint64).view(np.int64)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    begins = np.append(0, ends[:-1] + 1)[: len(words) - size + 1].tolist()
    digest = xxhash.xxh64_digest
    return np.unique(np.frombuffer(b"".join([digest(line[a:b], 42) for a, b in zip(begins, ends[size - 1 :].tolist())]), np.int64))


def classes(s: np.ndarray) -> bytes:
    """A bit for each class of shingles, set if the set has one of it; the last bits of a hash are its class."""
    bits = np.zeros(max(CLASSES, 1 << max(0, len(s) - 1).bit_length()), np.uint8)
    bits[s & (len(bits) - 1)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def most_common(x: bytes, y: bytes, nx: int, ny: int) -> int:
    """The most shingles that sets of these classes and sizes can have in common: a class that one of them lacks is a shingle that
    only the other has. The more classes are folded into the fewer."""
    width = min(len(x), len(y)) * 8
    u, v = int.from_bytes(x, "little"), int.from_bytes(y, "little")
    for big in (len(x) * 8, len(y) * 8):
        while big > width:
            big //= 2
            u, v = (u >> big) | (u & ((1 << big) - 1)), (v >> big) | (v & ((1 << big) - 1))
    return min(nx - (u & ~v).bit_count(), ny - (v & ~u).bit_count())


def prefix(n: int | F.Column, num: int, den: int) -> int | F.Column:
    """n - ceil(n * num / den) + 1, which is floor(n * (den - num) / den) + 1."""
    scaled = n * (den - num)
    return (scaled // den if isinstance(n, int) else F.floor(scaled / den)) + 1


def _numbered(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.hash(text).alias("rev"), text.alias("text"))


def _often(rows: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are frequent in a bounded sample (sorted) and their counts."""
    n = max(1, rows.count())
    share = min(1.0, min(max(n // SHARE, SAMPLE_RANGE[0]), SAMPLE_RANGE[1]) / n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, size) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets or [np.empty(0, np.int64)]))], ["token"])

    sample = rows.where(F.pmod(F.xxhash64("doc_id", "rev"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    counts = map_text(sample, run, "token long").groupBy("token").count().where(F.col("count") >= OFTEN)
    found = sorted((r["token"], r["count"]) for r in counts.orderBy(F.desc("count"), "token").limit(KEPT).collect())
    return np.array([t for t, _ in found], np.int64), np.array([c for _, c in found], np.int64)


def _known(rows: DataFrame, size: int, least: tuple[int, int]) -> DataFrame:
    """(doc_id, rev, key, n, bits, tokens): a hash, the size and the classes of the set, and its first shingles in the global order."""
    often, counts = _often(rows, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, bits, firsts = [], [], [], []
            for t in batch.column("text").cast(pa.binary()).to_pylist():
                s = shingles(t, size)
                keys.append(xxhash.xxh64_intdigest(s.tobytes(), 42))
                sizes.append(len(s))
                bits.append(classes(s))
                if len(often):
                    at = np.minimum(np.searchsorted(often, s), len(often) - 1)
                    s = s[np.argsort(np.where(often[at] == s, counts[at], 0), kind="stable")]
                firsts.append(s[: prefix(len(s), *least)])
            offsets = np.cumsum([0, *map(len, firsts)]).astype(np.int32)
            tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(firsts or [np.empty(0, np.int64)])))
            keys = pa.array(np.array(keys, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("rev"), keys, pa.array(sizes, pa.int32()), pa.array(bits, pa.binary()), tokens], ["doc_id", "rev", "key", "n", "bits", "tokens"]
            )

    return map_text(rows, run, "doc_id long, rev int, key long, n int, bits binary, tokens array<long>")


def _places(known: DataFrame) -> DataFrame:
    """(token, key, n, pos, members) of the first shingles that more than one set has, and how many have it, written. One exchange
    serves to find them and to keep them; a shingle is one row of what it is joined with, however many sets have it."""
    parts = []
    for go in range(GOES):
        places = known.select("key", "n", F.posexplode("tokens").alias("pos", "token"))
        places = places.where(F.pmod("token", F.lit(GOES)) == go).repartition("token")
        shared = places.groupBy("token").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low <> high").select("token")
        parts.append(cut(places.join(shared.hint("shuffle_hash"), "token", "left_semi").distinct(), "jaccard-shared"))
    found = reduce(DataFrame.unionByName, parts)
    counted = cut(found.join(found.groupBy("token").agg(F.count(F.lit(1)).alias("members")), "token"), "jaccard-places")
    release(*parts)
    return counted


def _sets_of(asked: DataFrame, named: DataFrame, rows: DataFrame, size: int, halves: bool = False) -> DataFrame:
    """(key, shingles): the whole sets of the ``asked`` keys, as bytes; with ``halves`` only the upper halves of the hashes. Of the
    texts only those are exchanged whose bucket has one that is asked for."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t, size) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            if halves:
                found = [np.unique((s.view(np.uint64) >> np.uint64(32)).astype(np.uint32)) for s in found]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([s.tobytes() for s in found], pa.binary())], ["key", "shingles"])

    bucket = lambda *of: F.pmod(F.xxhash64(*of), F.lit(BUCKETS)).alias("bucket")
    asked = cut(named.join(asked.distinct(), "key").select("key", F.col("least.doc_id").alias("id"), F.col("least.rev").alias("r")), "jaccard-asked")
    rows = rows.withColumn("bucket", bucket("doc_id", "rev")).join(F.broadcast(asked.select(bucket("id", "r")).distinct()), "bucket", "left_semi")
    texts = rows.join(asked, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("rev") == F.col("r"))).dropDuplicates(["key"]).select("key", "text")
    return map_text(texts, sets, "key long, shingles binary")


def _bounded(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """(a, b, na, nb, most): the sizes of both sets and the most shingles that they can have in common by their classes."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = [most_common(*x) for x in zip(*(batch.column(c).to_pylist() for c in ("sa", "sb", "na", "nb")))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("a", "b", "na", "nb")), pa.array(most, pa.int32())], ["a", "b", "na", "nb", "most"])

    sets = points.select("key", "bits", "n")
    both = pairs.select("a", "b").join(sets.toDF("a", "sa", "na"), "a").join(sets.toDF("b", "sb", "nb"), "b")
    return both.mapInArrow(check, "a long, b long, na int, nb int, most int")


def _compared(pairs: DataFrame, whole: DataFrame) -> DataFrame:
    """(a, b, common, total): how many shingles both sets have, and how many either has."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            common, total = [], []
            for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist()):
                n = len(np.intersect1d(np.frombuffer(x, np.int64), np.frombuffer(y, np.int64), assume_unique=True))
                common.append(n)
                total.append((len(x) + len(y)) // 8 - n)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(common, pa.int64()), pa.array(total, pa.int64())], ["a", "b", "common", "total"])

    both = pairs.select("a", "b").join(whole.toDF("a", "sa"), "a").join(whole.toDF("b", "sb"), "b")
    return both.mapInArrow(check, "a long, b long, common long, total long")


def _judged(pairs: DataFrame, halves: DataFrame, sizes: DataFrame, least: tuple[int, int]) -> DataFrame:
    """(a, b, verdict): 1 if the sets are similar enough, 0 if not, -1 if the halves of the hashes leave it open.

    Equal hashes have equal halves. Of the others some n_a * n_b / 2^32 agree in them, and far fewer than ALIKE times as many
    and ALIKE more; shingles of one set that share their half are one in it."""
    num, den = least

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            verdicts = []
            for x, y, na, nb in zip(*(batch.column(c).to_pylist() for c in ("sa", "sb", "na", "nb"))):
                u, v = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
                common, need = len(np.intersect1d(u, v, assume_unique=True)), -(-(na + nb) * num // (num + den))
                most = common + min(na - len(u), nb - len(v))
                verdicts.append(0 if most < need else 1 if common - ALIKE * (1 + na * nb / 2**32) >= need else -1)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(verdicts, pa.int32())], ["a", "b", "verdict"])

    sets = halves.join(sizes, "key")
    both = pairs.select("a", "b").join(sets.toDF("a", "sa", "na"), "a").join(sets.toDF("b", "sb", "nb"), "b")
    return both.mapInArrow(check, "a long, b long, verdict int")


def _both(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key")))


def _candidates(places: DataFrame, least: tuple[int, int], roots: DataFrame | None, far: DataFrame | None) -> DataFrame:
    """(a, b): keys of sets in two components (roots: node, root) that may be similar enough; na <= nb. ``far`` (a, b, low, high)
    has bounds of the distances from vantage points, equal ones where whole sets were compared."""
    num, den = least
    own, unknown, split = F.col("key"), F.lit(None).cast("double"), F.lit(True)
    low, high = unknown, unknown
    if roots is not None:
        places = places.join(roots.withColumnRenamed("node", "key"), "key", "left")
        own = F.coalesce("root", "key")
        seen = far.select(F.col("a").alias("vantage"), F.col("b").alias("key"), "low", "high")
        # Only crowded shards have a vantage point that was compared: few keys, so the others skip the join.
        crowd = places.where(F.col("members") > CROWD).join(seen, ["vantage", "key"], "left")
        crowd = crowd.withColumns({c: F.when(F.col("key") == F.col("vantage"), 0.0).otherwise(F.col(c)) for c in ("low", "high")})
        places = places.where(F.col("members") <= CROWD).withColumns({"low": unknown, "high": unknown}).unionByName(crowd)
        low, high = F.col("low"), F.col("high")
        radius = (1.0 - num / den) + 1e-9
        split = ~((F.col("la") - F.col("hb") > radius) | (F.col("lb") - F.col("ha") > radius))
    places = places.select("token", "members", "key", "n", "pos", own.alias("own"), low.alias("low"), high.alias("high"))
    first = lambda side: F.col("p" + side) < prefix(F.col("n" + side), 2 * num, num + den)
    named = lambda df, side: df.select("token", *[F.col(c).alias(x + side) for c, x in (("key", ""), ("n", "n"), ("pos", "p"), ("own", "o"), ("low", "l"), ("high", "h"))])
    ordered = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    near = (F.col("oa") != F.col("ob")) & (F.col("na") * den >= F.col("nb") * num) & F.coalesce(split, F.lit(True))
    small = places.where(F.col("members") <= CROWD) if roots is not None else places
    met = named(small, "a").where(first("a")).join(named(small, "b"), "token").where(ordered & near)
    if roots is not None:
        # The largest component of a crowded shard never meets itself: members of the others are joined with all, either way round.
        crowd = places.where(F.col("members") > CROWD)
        sizes = crowd.groupBy("token", "own").agg(F.count(F.lit(1)).alias("held"))
        main = sizes.groupBy("token").agg(F.max_by("own", F.struct("held", "own")).alias("main"))
        crowd = crowd.join(main, "token")
        few = crowd.where("own <> main")
        up = named(few, "a").where(first("a")).join(named(crowd, "b"), "token").where(ordered & near)
        down = named(crowd.where("own = main"), "a").where(first("a")).join(named(few, "b"), "token").where(ordered & near)
        met = met.unionByName(up).unionByName(down)
    met = met.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("common"), F.max("pa").alias("pa"), F.max("pb").alias("pb"))
    # Common shingles up to the last one found are all counted (a pair that a triangle bound rules out in one of its shards may
    # be counted short in another, but is no link); after it there are at most as many as either has left.
    most = F.col("common") + F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) - 1
    return met.where(most * (num + den) >= (F.col("na") + F.col("nb")) * num).select("a", "b")


def _links(known: DataFrame, points: DataFrame, rows: DataFrame, size: int, least: tuple[int, int], more: DataFrame | None = None) -> DataFrame:
    """(node, root) over the keys that links connect, those of ``more`` (a, b) too; ``known`` is released."""
    num, den = least
    named, linked = points.select("key", "least"), F.col("common") * den >= F.col("total") * num
    reached = F.col("most") * (num + den) >= (F.col("na") + F.col("nb")) * num
    places = _places(known)
    release(known)
    crowd = places.where(F.col("members") > CROWD)
    # Who shares most with others lies in their middle, and so close to many.
    middle = F.struct(F.col("shared"), F.xxhash64("key"), F.col("key"))
    shared = crowd.groupBy("key").agg(F.count(F.lit(1)).alias("shared"))
    vantage = cut(crowd.join(shared, "key").groupBy("token").agg(F.max_by("key", middle).alias("vantage")), "jaccard-vantage")
    crowd = crowd.join(vantage, "token")
    stars = crowd.where("key <> vantage").join(points.select(F.col("key").alias("vantage"), F.col("n").alias("nv")), "vantage")
    # A size out of reach gives the pair a distance that is known to be over the radius, but not which; it is left to the rest.
    stars = stars.where(F.least("n", "nv") * den >= F.greatest("n", "nv") * num).select(F.col("vantage").alias("a"), F.col("key").alias("b")).distinct()
    stars = cut(_bounded(stars, points), "jaccard-stars")
    roots = far = None
    if not stars.isEmpty():
        close = stars.where(reached)
        whole = cut(_sets_of(_both(close), named, rows, size), "jaccard-sets")
        exact = cut(_compared(close, whole), "jaccard-far")
        release(whole)
        roots = components(exact.where(linked).select("a", "b"))
        # Of those that classes rule out only the least distance is known, which is enough where the other is close.
        bound = lambda common, total: 1.0 - F.col(common) / total
        far = exact.select("a", "b", bound("common", F.col("total")).alias("low"), bound("common", F.col("total")).alias("high"))
        far = far.unionByName(stars.where(~reached).select("a", "b", bound("most", F.col("na") + F.col("nb") - F.col("most")).alias("low"), F.lit(1.0).alias("high")))
    pairs = _bounded(_candidates(places.join(vantage, "token", "left"), least, roots, far), points)
    pairs = cut(pairs.where(reached).select("a", "b"), "jaccard-pairs")
    release(places, stars)
    # Halves of the hashes decide nearly all pairs; the few that lie at the very border are compared by whole hashes.
    halves = cut(_sets_of(_both(pairs), named, rows, size, halves=True), "jaccard-sets")
    free_shuffles(rows.sparkSession)
    judged = cut(_judged(pairs, halves, points.select("key", "n"), least), "jaccard-judged")
    release(halves)
    edges, border = judged.where("verdict = 1").select("a", "b"), judged.where("verdict = -1")
    if not border.isEmpty():
        edges = edges.unionByName(_compared(border, _sets_of(_both(border), named, rows, size)).where(linked).select("a", "b"))
    if roots is not None:
        edges = edges.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
    return components(edges if more is None else edges.unionByName(more))


def _stars(own: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): links of the keys of each class (doc_id, rev, class) with the least of them, fewer than there are keys."""
    mark = classes.select(F.col("doc_id").alias("_id"), F.col("rev").alias("_rev"), "class").distinct()
    held = own.join(mark, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("rev") == F.col("_rev"))).select("class", "key").distinct()
    first = held.groupBy("class").agg(F.min("key").alias("b"))
    return held.join(first, "class").where("key <> b").select(F.col("key").alias("a"), "b")


def near_classes(docs: DataFrame, size: int = SHINGLE, least: tuple[int, int] = LEAST, classes: DataFrame | None = None) -> DataFrame:
    """doc_id, rev, and `least` (doc_id, rev) of every row: the first row, nulls last, of those its links reach. Rows of one class in
    ``classes`` (doc_id, rev, class), by whatever made it, are linked too."""
    rows = _numbered(docs)
    known = cut(_known(rows, size, least), "jaccard-known")
    own = cut(known.select("doc_id", "rev", "key", "n"), "jaccard-rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rev"))
    points = known.groupBy("key").agg(first.alias("least"), F.first("n").alias("n"), F.first("bits").alias("bits"))
    points = cut(points, "jaccard-points")
    more = None if classes is None else cut(_stars(own, classes), "jaccard-classes")
    roots = _links(known, points, rows, size, least, more)
    named = points.select("key", "least")
    placed = named.join(roots.withColumnRenamed("node", "key"), "key", "left").select("key", "least", F.coalesce("root", "key").alias("root"))
    firsts = placed.groupBy("root").agg(F.min("least").alias("first"))
    answer = cut(placed.join(firsts, "root").select("key", F.col("first").alias("least")), "jaccard-named")
    return own.select("doc_id", "rev", "key").join(answer, "key").select("doc_id", "rev", "least")


def drop_similar(docs: DataFrame, size: int = SHINGLE, least: tuple[int, int] = LEAST, classes: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of texts that links of at least ``least``, or of one class as in
    ``near_classes``, connect the one with the smallest doc_id.

    Words are lower-cased (A-Z) runs of anything but ASCII white space; null and empty texts are equal. Rows that repeat
    both doc_id and text stay or go together; of rows that share a doc_id but not the text, a hash of the text decides;
    null ids come last. Only what goes is joined with the texts. An empty table stays empty."""
    id_, rev = free_name(docs, "near_id", "near_rev")
    rows = near_classes(docs, size, least, classes)
    goes = rows.where(~(F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("rev") == F.col("least.rev"))))
    goes = cut(goes.select(F.col("doc_id").alias(id_), F.col("rev").alias(rev)).distinct(), "jaccard-goes")
    return docs.join(goes, docs["doc_id"].cast("long").eqNullSafe(F.col(id_)) & (F.hash(F.coalesce(docs["text"], F.lit(""))) == F.col(rev)), "left_anti")
