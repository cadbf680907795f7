"""MinHash near-dedup by a multi-index Hamming join.

A text is the set of its 5-word shingles (64-bit hashes). Its signature has 32 min-hashes of 16 bits in 8 chunks of 4. Two
signatures that differ in at most 15 places agree, by pigeonhole, in all or all but one place of some chunk: 8 chunks with two errors each make
16. So each text is filed under every chunk with each of its places left out in turn, 32 keys of three places (a chunk
without an error agrees with any place left out), and every pair of signatures within the distance meets under at least one key, for certain. What is left to
chance is the signature alone: two sets with a similarity of 0.85 differ in more than 15 of 32 places once in some million pairs.

Equal sets are one point before anything is joined, and a set with too many shingles that no other has leaves. Under a key, pairs are not all formed: in rounds, a text in the middle of
the key is compared with all others (as many pairs as members), and what links is one component. Then the largest
component of each key never meets itself: only members of the other components are joined with all. Full sets decide about each
pair that is within the distance, on 64-bit hashes of all shingles. What stays quadratic are texts that are all
alike, but none of them enough: pairs that lie just below the threshold are compared one by one, as there is no other exact way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, map_text, release
from .components import components

SHINGLE, LEAST = 5, (85, 100)
CHUNKS, PLACES, BITS = 8, 4, 16
#: Places that may differ: with one more there could be two errors in every chunk.
DISTANCE = 2 * CHUNKS - 1
#: Rounds of comparing a middle with the members of its key.
ROUNDS = 3
_SEEDS = np.array([xxhash.xxh64_intdigest(str(i).encode(), 12) for i in range(CHUNKS * PLACES)], np.uint64)
_SIGNATURE = [f"s{i}" for i in range(CHUNKS)]
#: Which of 1024 classes of shingles a set has: a class that only one of two sets has is a shingle that only one has, for certain.
CLASSES = 1 << 10
_POINT = ["node", "n", "shared", *_SIGNATURE, "classes"]


def shingles(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """The distinct 64-bit hashes of a text's shingles, sorted. Fewer words are one shingle; no words make an empty set."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(line, 42)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    begins = np.append(0, ends[:-1] + 1)[: len(words) - size + 1].tolist()
    digest = xxhash.xxh64_digest
    return np.unique(np.frombuffer(b"".join([digest(line[a:b], 42) for a, b in zip(begins, ends[size - 1 :].tolist())]), ">u8").astype(np.uint64))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of 64-bit chunks for each set, none of which is empty: 16 bits of the least hash under each permutation."""
    every = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    out = np.zeros((len(sets), CHUNKS), np.uint64)
    for i, seed in enumerate(_SEEDS):
        x = (every ^ seed) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        low = np.minimum.reduceat(x, starts)
        low ^= low >> np.uint64(32)  # the least hash is small, so its upper bits say little
        out[:, i // PLACES] |= (low & np.uint64(0xFFFF)) << np.uint64(BITS * (i % PLACES))
    return out


def classes(own: np.ndarray) -> np.ndarray:
    """The classes of a set's shingles as bits of 64-bit numbers."""
    held = np.zeros(CLASSES, np.uint8)
    held[own >> np.uint64(65 - CLASSES.bit_length())] = 1
    return np.packbits(held).view(np.int64)


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, rev, text): rev tells texts under one doc_id apart."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("rev"), text.alias("text"))


def _signed(rows: DataFrame, size: int) -> DataFrame:
    """(doc_id, rev, node, n, s0...): the hash and the size of each row's set, and its signature; node null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, size) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            full = [i for i, s in enumerate(sets) if len(s)]
            node = np.zeros(len(sets), np.uint64)
            node[full] = [xxhash.xxh64_intdigest(sets[i].tobytes(), 7) for i in full]
            chunks = np.zeros((len(sets), CHUNKS), np.uint64)
            if full:
                chunks[full] = signatures([sets[i] for i in full])
            empty = np.array([not len(s) for s in sets], bool)
            longs = [pa.array(node.view(np.int64), mask=empty), pa.array([len(s) for s in sets], pa.int64()), *[pa.array(np.ascontiguousarray(chunks[:, k]).view(np.int64)) for k in range(CHUNKS)]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("rev"), *longs], ["doc_id", "rev", "node", "n", *_SIGNATURE])

    return map_text(rows, run, "doc_id long, rev long, node long, n long, " + ", ".join(f"{s} long" for s in _SIGNATURE))


def _keys() -> Column:
    """All keys of a signature: the chunk and the place left out above, the three other places below. No two are alike by chance."""
    out = []
    for k, name in enumerate(_SIGNATURE):
        c = F.col(name)
        for place in range(PLACES):
            low = c.bitwiseAND((1 << BITS * place) - 1) if place else F.lit(0).cast("long")
            high = F.shiftleft(F.shiftrightunsigned(c, BITS * (place + 1)), BITS * place) if place < PLACES - 1 else F.lit(0).cast("long")
            out.append(low.bitwiseOR(high).bitwiseOR(F.lit((k * PLACES + place) << BITS * (PLACES - 1)).cast("long")))
    return F.array(*out)


def _differing(a: str, b: str) -> list[Column]:
    """In how many places each chunk of two signatures differs."""
    out = []
    for s in _SIGNATURE:
        x = F.col(a + s).bitwiseXOR(F.col(b + s))
        for shift in (8, 4, 2, 1):  # each place's bits are gathered in its lowest one
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        out.append(F.bit_count(x.bitwiseAND(0x0001000100010001)))
    return out


def _distance(a: str, b: str) -> Column:
    """In how many places two signatures differ."""
    return sum(_differing(a, b)[1:], _differing(a, b)[0])


def _first_meeting(key: Column, a: str, b: str) -> Column:
    """Whether ``key`` is the first of the keys that two signatures share: that of the first chunk with one error at most; without an
    error all its keys are shared, and the first has the first place left out."""
    chunk, test = F.shiftright(key, BITS * (PLACES - 1) + 2), F.lit(False)
    left_out = F.shiftright(key, BITS * (PLACES - 1)).bitwiseAND(PLACES - 1)
    for k, errors in reversed(list(enumerate(_differing(a, b)))):
        test = F.when(errors <= 1, (chunk == k) & ((left_out == 0) | (errors == 1))).otherwise(test)
    return test


def _close(a: str, b: str, least: tuple[int, int]) -> Column:
    """Whether signatures, what the sets have that is not theirs alone, and classes that only one has allow a link: an intersection of
    I needs I den >= (n_a + n_b - I) num."""
    num, den = least
    # As arrays: written out, the condition of a join is too long a method for the JVM to compile.
    alone = lambda x, y: F.aggregate(F.zip_with(x + "classes", y + "classes", lambda c, d: F.bit_count(c.bitwiseAND(F.bitwise_not(d)))), F.lit(0), lambda s, k: s + k)
    enough = lambda most: most * (num + den) >= (F.col(a + "n") + F.col(b + "n")) * num
    shared = F.least(F.col(a + "shared"), F.col(b + "shared"))
    return enough(shared) & (_distance(a, b) <= DISTANCE) & enough(F.col(a + "n") - alone(a, b)) & enough(F.col(b + "n") - alone(b, a))


def _named(points: DataFrame, prefix: str) -> DataFrame:
    return points.select(*[F.col(c).alias(prefix + c) for c in _POINT])


def _sets(asked: DataFrame, points: DataFrame, rows: DataFrame, size: int) -> DataFrame:
    """(node, shingles, classes): the whole sets of the ``asked`` nodes, as bytes, and their classes."""
    first = points.join(asked, "node", "left_semi").select("node", F.col("least.doc_id").alias("id"), F.col("least.rev").alias("r"))
    texts = rows.join(first, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("rev") == F.col("r"))).dropDuplicates(["node"]).select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t, size) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            held = pa.array([classes(s) for s in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([s.tobytes() for s in found], pa.binary()), held], ["node", "shingles", "classes"])

    return map_text(texts, run, "node long, shingles binary, classes array<long>")


def _linkable(sets: DataFrame, least: tuple[int, int]) -> DataFrame:
    """(node, shared, classes): the sets that can have a link at all, and how many of their shingles any other of the ``sets`` has. Only those
    can be in an intersection, so a set with more than 15 in 100 of its own links with none. That tells apart texts that share
    a long passage, and, pair by pair, copies with too many edits of their own, however many they are."""
    num, den = least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                held = part.column("shingles").to_pylist()
                nodes = np.repeat(part.column("node").to_numpy(), [len(s) // 8 for s in held])
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(np.frombuffer(b"".join(held), np.int64))], ["node", "token"])

    own = sets.select("node", "shingles").mapInArrow(run, "node long, token long").groupBy("token").agg(F.count(F.lit(1)).alias("sets"), F.first("node").alias("node")).where("sets = 1")
    own = own.groupBy("node").agg(F.count(F.lit(1)).alias("own"))
    sizes = sets.select("node", F.expr("octet_length(shingles) div 8").alias("n"), "classes").join(own, "node", "left")
    return sizes.select("node", "n", "classes", (F.col("n") - F.coalesce("own", F.lit(0))).alias("shared")).where(F.col("shared") * den >= F.col("n") * num).drop("n")


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, common, total): how many shingles both full sets of each pair have, and how many either; the pairs are released."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            common, total = [], []
            for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist()):
                n = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
                common.append(n)
                total.append((len(x) + len(y)) // 8 - n)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(common, pa.int64()), pa.array(total, pa.int64())], ["a", "b", "common", "total"])

    held = sets.select("node", "shingles")
    both = pairs.select("a", "b").join(held.toDF("a", "sa"), "a").join(held.toDF("b", "sb"), "b")
    done = cut(both.mapInArrow(run, "a long, b long, common long, total long"), "minhash-compared")
    release(pairs)
    return done


def _edges(compared: DataFrame, least: tuple[int, int]) -> DataFrame:
    num, den = least
    return compared.where(F.col("common") * den >= F.col("total") * num).select("a", "b")


def _shared_keys(places: DataFrame) -> DataFrame:
    """``places`` (node, key) under keys that several nodes have."""
    return places.join(places.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1").select("key"), "key")


def _with_roots(places: DataFrame, roots: DataFrame | None) -> DataFrame:
    """``places`` with the component of each node; keys with one component only have nothing to give and go."""
    rows = places.withColumn("root", F.col("node"))
    if roots is not None:
        rows = places.join(roots.withColumnRenamed("root", "_r"), "node", "left").withColumn("root", F.coalesce("_r", "node")).drop("_r")
    open_ = rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    return rows.join(open_, "key", "left_semi")


def _stars(places: DataFrame, compared: DataFrame | None) -> DataFrame:
    """(a, b): the middle of each key and its members of other components, once each. At first in the middle is who meets most others
    over all its keys, as those do whose places are what most have; it is the same for most keys of a group, so that a member
    meets few. Later (``compared`` has the pairs so far) it is who is closest to one that has been in the middle before, which
    walks towards the true middle."""
    sizes = places.groupBy("key").agg(F.count(F.lit(1)).alias("members"))
    able = places.join(places.join(sizes, "key").groupBy("node").agg(F.sum("members").alias("met")), "node")
    close = F.lit(0.0)
    if compared is not None:
        able = able.join(compared.select(F.col("a").alias("node")).distinct(), "node", "left_anti")
        able = able.join(compared.groupBy(F.col("b").alias("node")).agg(F.max(F.col("common") / F.col("total")).alias("close")), "node", "left")
        close = F.coalesce("close", F.lit(0.0))
    order = F.struct(close.alias("close"), F.col("met"), F.xxhash64("node").alias("h"), F.col("node"))
    middle = able.groupBy("key").agg(F.max_by(F.struct("node", "root"), order).alias("m"))
    return places.join(middle, "key").where("root <> m.root").select(F.col("m.node").alias("a"), F.col("node").alias("b")).distinct()


def _within(pairs: DataFrame, points: DataFrame, least: tuple[int, int]) -> DataFrame:
    """Those of the pairs (a, b) that sizes and signatures allow."""
    pairs = pairs.join(_named(points, "a_"), F.col("a") == F.col("a_node")).join(_named(points, "b_"), F.col("b") == F.col("b_node"))
    return pairs.where(_close("a_", "b_", least)).select("a", "b")


def _rest(places: DataFrame, points: DataFrame, least: tuple[int, int]) -> DataFrame:
    """(a, b): all pairs within the distance that share a key and lie in two components, once each. The largest component of a key
    never meets itself: members of the others (a) are joined with all (b)."""
    sizes = places.groupBy("key", "root").agg(F.count(F.lit(1)).alias("members"))
    main = sizes.groupBy("key").agg(F.max_by("root", F.struct("members", "root")).alias("main"))
    held = cut(places.join(main, "key").join(points.select(*_POINT), "node"), "minhash-open")
    columns = ["root", *_POINT]
    few = held.where("root <> main").select("key", *[F.col(c).alias("a_" + c) for c in columns])
    every = held.select("key", "main", *[F.col(c).alias("b_" + c) for c in columns])
    # Two that are both outside the largest component meet twice; one order is enough.
    once = (F.col("b_root") == F.col("main")) | (F.col("a_node") < F.col("b_node"))
    near = few.join(every, (few["key"] == every["key"]) & (F.col("a_root") != F.col("b_root")) & once & _close("a_", "b_", least) & _first_meeting(few["key"], "a_", "b_"))
    return near.select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))


def near_classes(docs: DataFrame, size: int = SHINGLE, least: tuple[int, int] = LEAST) -> DataFrame:
    """One row per row of ``docs``: doc_id, rev, n_shingles, and `least` (doc_id, rev), the first row of those that links reach."""
    rows = _rows(docs)
    signed = cut(_signed(rows, size), "minhash-signed")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rev"))
    full = signed.where("node is not null")
    points = cut(full.groupBy("node").agg(first.alias("least"), *[F.first(c).alias(c) for c in ("n", *_SIGNATURE)]), "minhash-points")
    places = cut(_shared_keys(points.select("node", F.explode(_keys()).alias("key"))), "minhash-places")
    sets = cut(_sets(places.select("node").distinct(), points, rows, size), "minhash-sets")
    able_points = cut(points.join(_linkable(sets, least), "node"), "minhash-linkable")
    able = cut(_shared_keys(places.join(able_points.select("node"), "node", "left_semi")), "minhash-able")
    release(places)

    compared = roots = None
    for _ in range(ROUNDS):
        open_ = cut(_with_roots(able, roots), "minhash-round")
        if open_.isEmpty():
            break
        found = _compared(cut(_within(_stars(open_, compared), able_points, least), "minhash-stars"), sets)
        compared = found if compared is None else compared.unionByName(found)
        roots = cut(components(_edges(compared, least)), "minhash-roots")
        release(open_)
    open_ = cut(_with_roots(able, roots), "minhash-round")
    if not open_.isEmpty():
        found = _compared(cut(_rest(open_, able_points, least), "minhash-pairs"), sets)
        roots = components(_edges(found if compared is None else compared.unionByName(found), least))
    release(able, open_, sets, able_points)

    placed = points.select("node", "least")
    if roots is not None:
        placed = placed.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        firsts = placed.groupBy("root").agg(F.min("least").alias("first"))
        placed = placed.join(firsts, "root").select("node", F.col("first").alias("least"))
    answer = cut(placed, "minhash-named")
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rev")
    alone = signed.where("node is null").select("doc_id", "rev", F.col("n").alias("n_shingles"), own.alias("least"))
    return full.select("doc_id", "rev", "node", F.col("n").alias("n_shingles")).join(answer, "node").select("doc_id", "rev", "n_shingles", "least").unionByName(alone)


def near_duplicates(docs: DataFrame, size: int = SHINGLE, least: tuple[int, int] = LEAST) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Texts whose sets of 5-word shingles have a Jaccard similarity of at least 85/100 are linked; component_id is the smallest doc_id
    that links reach, kept says whether it is the row's own. Words are runs of anything but ASCII white space, A-Z lower-cased; a
    text of fewer words is one shingle, null and empty texts have none and are linked with nothing. Null ids come after all
    others: a component of nothing but null ids has component_id null and all its rows kept. Rows that repeat a doc_id are each
    judged by their own text. An empty table gives an empty result; other columns are ignored."""
    rows = near_classes(docs, size, least)
    component = F.col("least.doc_id")
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
