"""Sharding by a k-d tree with distributed weighted medians.

The tree is grown level by level. In each level every node takes the metadata dimension along which it is
widest and is cut where the bytes on both sides are in proportion to the leaves they still get. The cut is
found by counting bytes in equal bins and counting again inside the bin that holds it; the driver sees at
most ``shards`` x ``BINS`` sums at once, whatever the number of rows. Ties, such as a source with a third of
all rows, are split by a hash of the row, which is the low half of every coordinate.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import cut

BINS = 1024
#: A coordinate is COARSE bits of the metadata value, then FINE bits of a hash of the row.
COARSE, FINE = 20, 32
SLOT_BUCKETS = 1024
DIMENSIONS = ("source", "lang", "size", "doc_id")


@dataclass
class Node:
    leaves: int
    first: int  # the first shard below it
    dim: str = ""
    cut: int = 0
    kids: list[Node] = field(default_factory=list)

    def shard(self) -> Column:
        """The shard of a row, as nested CASE expressions."""
        if not self.kids:
            return F.lit(self.first)
        return F.when(F.col(self.dim) <= F.lit(self.cut), self.kids[0].shard()).otherwise(self.kids[1].shard())

    def ends(self) -> list[Node]:
        return [e for k in self.kids for e in k.ends()] if self.kids else [self]


def _scaled(docs: DataFrame, size: Column) -> DataFrame:
    """doc_id, size, text_crc32 and a coordinate per dimension, all integers. A null or missing value is 0."""
    types = dict(docs.dtypes)
    top = float((1 << COARSE) - 1)
    numeric = {"size": F.log2(size.cast("double"))}
    if "doc_id" in types:
        numeric["doc_id"] = F.col("doc_id").cast("double")
    low, high = {}, {}
    for name, value in numeric.items():
        low[name], high[name] = F.min(value).alias(f"low_{name}"), F.max(value).alias(f"high_{name}")
    edges = docs.agg(*low.values(), *high.values()).first()
    crc = F.coalesce(F.crc32(F.encode("text", "UTF-8")), F.lit(0).cast("long"))
    # The row's number tells rows apart that share id and text; the caller writes the table, so it does not change.
    tie = F.pmod(F.xxhash64("doc_id", crc, F.monotonically_increasing_id()), F.lit(1 << FINE))
    out = [F.col("doc_id").alias("id"), size.alias("bytes"), crc.alias("crc"), (F.monotonically_increasing_id() % SLOT_BUCKETS).alias("nth_row")]
    for name in DIMENSIONS:
        if name in numeric:
            a, b = edges[f"low_{name}"] or 0.0, edges[f"high_{name}"] or 0.0
            unit = (numeric[name] - F.lit(a)) / F.lit((b - a) or 1.0)
        elif name in types:
            unit = F.pmod(F.xxhash64(F.col(name)), F.lit(1 << COARSE)) / F.lit(top)
            unit = F.when(F.col(name).isNotNull(), unit)
        else:
            unit = F.lit(0.0)
        coarse = F.least(F.floor(F.coalesce(unit, F.lit(0.0)) * F.lit(top)), F.lit(int(top)))
        out.append((F.shiftleft(coarse.cast("long"), FINE) + tie).alias(f"at_{name}"))
    return docs.select(*out)


def _widest(rows: DataFrame, open_nodes: list[Node]) -> dict[int, tuple[float, dict[str, tuple[int, int]]]]:
    """Bytes of each node and the range of its coordinates."""
    names = [f"at_{d}" for d in DIMENSIONS]
    found = rows.groupBy("node").agg(F.sum("bytes").alias("w"), *[F.min(n).alias(f"a_{n}") for n in names], *[F.max(n).alias(f"b_{n}") for n in names]).collect()
    return {r["node"]: (float(r["w"]), {n: (r[f"a_{n}"], r[f"b_{n}"]) for n in names}) for r in found}


def grow(rows: DataFrame, shards: int, slack: float) -> Node:
    """The tree over ``rows`` (bytes, at_*). A cut is exact to ``slack`` of a shard's bytes, or to one row."""
    root = Node(shards, 0)
    while level := [n for n in root.ends() if n.leaves > 1]:
        placed = rows.withColumn("node", root.shard()).where(F.col("node").isin([n.first for n in level]))
        facts = _widest(placed, level)
        search = {}
        for node in level:
            weight, ranges = facts.get(node.first, (0.0, {f"at_{d}": (0, 0) for d in DIMENSIONS}))
            node.dim = max(ranges, key=lambda n: (ranges[n][1] >> FINE) - (ranges[n][0] >> FINE))
            left = node.leaves // 2
            a, b = ranges[node.dim]
            search[node.first] = [a, b, weight * left / node.leaves, weight / node.leaves * slack]
            node.cut = b
        while search:
            binned = None
            for node in level:
                if node.first in search:
                    a, b, _, _ = search[node.first]
                    width = max(1, -(-(b - a + 1) // BINS))
                    inside = F.col(node.dim).between(a, b)
                    bin_of = F.when((F.col("node") == node.first) & inside, F.floor((F.col(node.dim) - F.lit(a)) / F.lit(width)).cast("int"))
                    binned = bin_of if binned is None else F.coalesce(binned, bin_of)
            sums: dict[int, dict[int, float]] = {}
            counted = placed.withColumn("bin", binned).where("bin is not null").groupBy("node", "bin").agg(F.sum("bytes").alias("w"))
            for r in counted.collect():  # at most shards x BINS rows
                sums.setdefault(r["node"], {})[r["bin"]] = float(r["w"])
            for node in level:
                if node.first not in search:
                    continue
                a, b, want, near = search[node.first]
                width, below, own = max(1, -(-(b - a + 1) // BINS)), 0.0, sums.get(node.first, {})
                at = a - 1
                for k in sorted(own):
                    if below + own[k] > want:
                        break
                    below += own[k]
                    at = min(b, a + (k + 1) * width - 1)
                else:
                    k = None
                if k is None or width == 1 or min(want - below, below + own[k] - want) <= near:
                    over = 0.0 if k is None else below + own[k] - want
                    node.cut = min(b, a + (k + 1) * width - 1) if k is not None and over < want - below else at
                    del search[node.first]
                else:
                    search[node.first] = [a + k * width, min(b, a + (k + 1) * width - 1), want - below, near]
        for node in level:
            left = node.leaves // 2
            node.kids = [Node(left, node.first), Node(node.leaves - left, node.first + left)]
    return root


def shard_documents(docs: DataFrame, shards: int | None = 24, slack: float = 0.002, target_bytes: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null).

    ``size`` is the bytes of the text in UTF-8 plus 8. Shards get near equal bytes, as the cuts are exact to
    ``slack`` of a shard or one row; with ``target_bytes`` there are as many as leaves of at most so many bytes need.
    ``slot`` numbers the rows of a shard from 0 without gaps.

    The law is about bytes alone: rows with equal texts, a group that may hold a third of all bytes, are spread like any
    others, and so are rows that share a doc_id or have none. Null text has no bytes; null metadata sits at the low end
    of its dimension; missing lang or source columns count as null. An empty table gives an empty result. Extra columns
    are ignored."""
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(8)).cast("long")
    rows = cut(_scaled(docs, size), "shard-rows")
    if target_bytes is not None:
        shards = max(1, -(-(rows.agg(F.sum("bytes")).first()[0] or 0) // target_bytes))
    placed = rows.select("id", "bytes", "crc", "nth_row", grow(rows, shards, slack).shard().cast("int").alias("shard"))
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("id", "crc", "nth_row"), F.lit(SLOT_BUCKETS)).cast("int"))
    counts = placed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "bucket").orderBy("id", "crc")
    slots = placed.withColumn("nth", F.row_number().over(within)).join(F.broadcast(offsets), ["shard", "bucket"])  # shards x SLOT_BUCKETS rows
    return slots.select(
        F.col("id").alias("doc_id"), F.col("bytes").alias("size"), F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"),
        "shard", (F.col("start") + F.col("nth") - 1).cast("long").alias("slot"), F.lit(None).cast(T.IntegerType()).alias("grown_shard"),
    )
