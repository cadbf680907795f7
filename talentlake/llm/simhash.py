"""SimHash near-dedup with vantage-point trees.

Equal fingerprints are one point. The upper tree is built on the driver from a bounded sample of points: each node
takes the vantage point and radius, of a few tried, that put the fewest sample points near the border. Every point has
one home leaf; it also visits the leaves whose region its ball of RADIUS bits may reach by the triangle inequality.
A leaf is a shard: its task grows a local vantage-point tree over residents and visitors and compares what the bounds
leave. Each two points within RADIUS meet in the home leaf of either, so links are exact.

Within a shard links are joined into trees at once (a spanning forest), so a dense group of n points gives under n
edges, and Spark finds the components of those.

``drop_near_duplicates`` also takes a stated similarity of word shingles, which 64 bits cannot decide. The links of fingerprints
are found as ever, and those of ``jaccard`` come to them: there the points are sets of shingles, the distance is Jaccard's, and
vantage points and triangle bounds prune in the same way. Components are those of both kinds of links together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name, map_text
from .components import components
from .jaccard import drop_similar

SHINGLE = 3
RADIUS = 3
#: Residents of a shard; points that the upper tree is fitted on: SAMPLE a shard, but at least and at most so many.
POINTS, SAMPLE, SAMPLE_RANGE = 1 << 16, 128, (1 << 12, 1 << 20)
LEAF = 128


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The SimHash of a text: bit i is set if it is set in over half the XXH64 (seed 42) of its shingles."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(line, 42)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    begins = np.append(0, ends[:-1] + 1)[: len(words) - shingle + 1].tolist()
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(line[a:b], 42) for a, b in zip(begins, ends[shingle - 1 :].tolist())])
    bits = np.unpackbits(np.frombuffer(hashes, np.uint8)).reshape(-1, 64)
    return int.from_bytes(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(bits)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, rev, fp) for every row; rev, a hash of the text, tells rows apart that share a doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t, shingle) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("rev"), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "rev", "fp"])

    text = F.coalesce(F.col("text"), F.lit(""))
    return map_text(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.hash(text).alias("rev"), text.alias("text")), run, "doc_id long, rev int, fp long")


def distance(points: np.ndarray, point: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ point)


@dataclass
class Split:
    """Points within ``radius`` of ``vantage`` are inside. A leaf has a shard instead."""

    shard: int = -1
    vantage: np.uint64 = np.uint64(0)
    radius: int = 0
    inside: Split | None = None
    outside: Split | None = None


def best_split(points: np.ndarray, seed: int, reach: int, tried: int = 8) -> tuple[np.uint64, int] | None:
    """The vantage point, of ``tried`` ones, and the radius that leave the fewest points on both sides of the border in the
    larger half; None if all points are one."""
    best, score = None, 2.0
    for vantage in np.random.default_rng(seed).choice(points, min(tried, len(points)), replace=False):
        d = distance(points, vantage)
        middle = int(np.median(d))
        for radius in (middle - 1, middle, middle + 1):
            share = (d <= radius).mean()
            if 0.2 <= share <= 0.8 or (0 < share < 1 and best is None):
                cost = max((d <= radius + reach).mean(), (d > radius - reach).mean())
                if cost < score:
                    best, score = (vantage, radius), cost
    return best


def upper_tree(sample: np.ndarray, shards: int, reach: int) -> Split:
    """A tree with at most ``shards`` leaves over the sample, which is bounded."""
    root = Split()
    leaves = [(root, sample)]
    while len(leaves) < shards:
        k = max(range(len(leaves)), key=lambda i: len(leaves[i][1]))
        node, points = leaves[k]
        cut_at = best_split(points, len(leaves), reach) if len(points) > 1 else None
        if cut_at is None:
            break
        node.vantage, node.radius = cut_at
        node.inside, node.outside = Split(), Split()
        near = distance(points, node.vantage) <= node.radius
        leaves[k : k + 1] = [(node.inside, points[near]), (node.outside, points[~near])]
    for i, (node, _) in enumerate(leaves):
        node.shard = i
    return root


def routes(root: Split, points: np.ndarray, reach: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, indices of points that live there or may reach it, whether they live there)."""
    stack = [(root, np.arange(len(points)), np.ones(len(points), bool))]
    while stack:
        node, at, home = stack.pop()
        if not len(at):
            continue
        if node.inside is None:
            yield node.shard, at, home
            continue
        d = distance(points[at], node.vantage).astype(np.int16)
        near, far = d <= node.radius + reach, d > node.radius - reach
        stack.append((node.inside, at[near], (home & (d <= node.radius))[near]))
        stack.append((node.outside, at[far], (home & (d > node.radius))[far]))


def spanning_forest(points: np.ndarray, home: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (indices) that connect what links of at most ``reach`` bits between a resident and another point connect."""
    root = np.arange(len(points))

    def link(a: np.ndarray, b: np.ndarray) -> None:
        nonlocal root
        while len(a):
            ra, rb = root[a], root[b]
            open_ = ra != rb
            a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while (up := root[root]).tobytes() != root.tobytes():
                root = up

    stack = [(np.flatnonzero(home), np.arange(len(points)), 0)]
    while stack:
        own, all_, depth = stack.pop()
        split = best_split(points[own], depth, reach, 3) if len(own) > LEAF and depth < 40 else None
        if split is not None:
            vantage, radius = split
            d_own, d_all = distance(points[own], vantage).astype(np.int16), distance(points[all_], vantage).astype(np.int16)
            near, far = all_[d_all <= radius + reach], all_[d_all > radius - reach]
            if max(len(near), len(far)) < 0.98 * len(all_) or len(own) > 4096:
                stack.append((own[d_own <= radius], near, depth + 1))
                stack.append((own[d_own > radius], far, depth + 1))
                continue
        block = max(1, (1 << 20) // max(1, len(all_)))
        for i in range(0, len(own), block):
            a, b = np.nonzero(np.bitwise_count(points[own[i : i + block], None] ^ points[None, all_]) <= reach)
            a, b = own[i : i + block][a], all_[b]
            link(a[a != b], b[a != b])
    linked = np.flatnonzero(root != np.arange(len(root)))
    return linked, root[linked]


def near_links(points: DataFrame, reach: int = RADIUS, shards: int | None = None) -> DataFrame:
    """Edges (a, b) that connect the distinct ``points`` (fp) which chains of links of ``reach`` bits connect. The number of
    shards follows that of the points unless it is given."""
    shards = shards or 1 << max(0, (points.count() - 1) // POINTS).bit_length()
    fitted = min(max(SAMPLE * shards, SAMPLE_RANGE[0]), SAMPLE_RANGE[1])
    sample = np.array([r[0] for r in points.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(fitted).collect()], np.int64).view(np.uint64)
    tree = upper_tree(sample, shards, reach)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            for shard, at, home in routes(tree, fps.view(np.uint64), reach):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), shard, np.int32)), pa.array(fps[at]), pa.array(home)], ["shard", "fp", "home"])

    def shard_edges(table: pa.Table) -> pa.Table:
        fps = table.column("fp").to_numpy()
        a, b = spanning_forest(fps.view(np.uint64), table.column("home").to_numpy(), reach)
        return pa.table({"a": fps[a], "b": fps[b]})

    return points.select("fp").mapInArrow(route, "shard int, fp long, home boolean").groupBy("shard").applyInArrow(shard_edges, "a long, b long")


def _classes(docs: DataFrame, shingle: int, reach: int, shards: int | None) -> DataFrame:
    """(doc_id, rev, class) of every row: a point of its component."""
    known = cut(fingerprints(docs, shingle), "simhash-fingerprints")
    points = cut(known.select("fp").distinct(), "simhash-points")
    roots = components(near_links(points, reach, shards)).withColumnRenamed("node", "fp")
    return known.join(roots, "fp", "left").select("doc_id", "rev", F.coalesce("root", "fp").alias("class"))


def near_classes(docs: DataFrame, shingle: int = SHINGLE, reach: int = RADIUS, shards: int | None = None) -> DataFrame:
    """doc_id, rev, fp and `least` (doc_id, rev) of every row: the first row, nulls last, of those its links reach."""
    known = cut(fingerprints(docs, shingle), "simhash-fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rev"))
    points = cut(known.groupBy("fp").agg(first.alias("least")), "simhash-points")
    roots = components(near_links(points, reach, shards))
    placed = points.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = placed.join(placed.groupBy("root").agg(F.min("least").alias("first")), "root").select("fp", F.col("first").alias("least"))
    return known.join(cut(named, "simhash-named"), "fp")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, reach: int = RADIUS, shards: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id that links reach).

    Words are lower-cased (A-Z) runs of anything but ASCII white space. A text of fewer words than ``shingle`` is one
    shingle; null and empty texts have the fingerprint zero and are linked like others. A null doc_id counts in no
    component_id (null if no other is there). Equal rows get equal results; an empty table gives an empty result; extra
    columns are ignored. There are about POINTS distinct fingerprints a shard unless ``shards`` says otherwise."""
    rows = near_classes(docs, shingle, reach, shards)
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("least.doc_id").alias("component_id"))


def drop_near_duplicates(
    docs: DataFrame, shingle: int = SHINGLE, reach: int = RADIUS, shards: int | None = None, similarity: tuple[int, int] | None = None, set_shingle: int | None = None
) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each component the one with the smallest doc_id. Links are
    fingerprints within ``reach`` bits and, with ``similarity`` (a fraction), also a Jaccard similarity of so much over shingles of
    ``set_shingle`` words (without it of ``shingle``).

    Rows that repeat both doc_id and text are one document and stay or go together; of rows that share a doc_id but not
    the text, a hash of the text decides; null ids come last."""
    if similarity is not None:
        return drop_similar(docs, set_shingle or shingle, similarity, _classes(docs, shingle, reach, shards))
    id_, rev = free_name(docs, "near_id", "near_rev")
    rows = near_classes(docs, shingle, reach, shards)
    stays = rows.where(F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("rev") == F.col("least.rev")))
    stays = stays.select(F.col("doc_id").alias(id_), F.col("rev").alias(rev)).hint("shuffle_hash")
    return docs.join(stays, docs["doc_id"].cast("long").eqNullSafe(F.col(id_)) & (F.hash(F.coalesce(docs["text"], F.lit(""))) == F.col(rev)), "left_semi")
