"""A Merkle manifest of a table of documents.

Every row is a leaf; the leaves of a language make a tree with a fanout, the roots of the languages another. Rows get their
place in the language by ``ordinals.numbered``, which deals them by ranges, so one language may hold any share of the rows.
Then Spark groups aligned blocks of fanout^LEVELS places: a block has its digests in one contiguous numpy matrix of 64 hex bytes
a row, rows of which are reshaped by the fanout and hashed level by level. Block roots are the leaves of the next
round, until every language has one. Proofs come down again: a block gets the siblings above it, works out its own by
index arithmetic and hands both on. Nothing larger than a block is ever in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordinals import numbered
from .common import ascii_lower, cut

FANOUT, LEVELS = 8, 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
HEX = 64


def leaf_digest(*values: Column) -> Column:
    """SHA-256 over the values in order: `-` for null, else the number of UTF-8 bytes, a colon and the value."""
    parts = []
    for v in values:
        text = v.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def tampered(doc_id: Column) -> Column:
    """Whether 3 divides the CRC-32 of the decimal doc_id (false for null)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0, F.lit(False))


def _hash(data: bytes) -> bytes:
    return hashlib.sha256(data).hexdigest().encode()


def fold(digests: np.ndarray, fanout: int, levels: int) -> list[np.ndarray]:
    """The matrix ``digests`` (n x 64 bytes) and ``levels`` above it: the rows of each are the hashes of ``fanout`` consecutive rows
    below; the last run may have fewer, even one."""
    out = [digests]
    for _ in range(levels):
        below = out[-1]
        whole = len(below) // fanout
        runs = below[: whole * fanout].reshape(whole, fanout * HEX)
        made = [_hash(run.tobytes()) for run in runs]
        if whole * fanout < len(below):
            made.append(_hash(below[whole * fanout :].tobytes()))
        out.append(np.frombuffer(b"".join(made), np.uint8).reshape(-1, HEX))
    return out


def height(n: int, fanout: int, most: int) -> int:
    """Levels that a tree over ``n`` leaves has, at most ``most``."""
    h = 0
    while n > 1 and h < most:
        n, h = -(-n // fanout), h + 1
    return h


def siblings(levels: list[np.ndarray], place: int, fanout: int) -> list[tuple[bytes, bytes]]:
    """For each level but the last what stands left and right of the node above ``place`` within its run."""
    out = []
    for level in levels[:-1]:
        first = place - place % fanout
        run = level[first : first + fanout]
        at = place - first
        out.append((run[:at].tobytes(), run[at + 1 :].tobytes()))
        place //= fanout
    return out


def refold(digest: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    """The root that a leaf ``digest`` has with the given siblings."""
    for left, right in path:
        digest = _hash(left + digest + right)
    return digest


def _grouped(rows: DataFrame, function: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """``function`` over each (tree, block) of ``rows``, whose digests come in order of their places."""
    _ship(rows)
    return rows.groupBy("tree", "block").applyInArrow(function, schema)


def _ship(df: DataFrame) -> None:
    """Python workers also look for this package where the driver has it."""
    paths, root = df.sparkSession.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if root not in paths.get("PYTHONPATH", "").split(":"):
        paths["PYTHONPATH"] = ":".join(filter(None, [paths.get("PYTHONPATH"), root]))


def _matrix(table: pa.Table) -> np.ndarray:
    """The digests of a table as rows of 64 bytes, sorted by place."""
    column = table.sort_by("place")["digest"].cast(pa.binary(HEX)).combine_chunks()
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, HEX)


def _blocks(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """(tree, place, n, digest): the roots of the blocks of ``nodes``, which are the same columns. A tree with one block ends
    where one node is left, others have all levels in every block."""
    per = fanout**levels

    def run(table: pa.Table) -> pa.Table:
        n = table["n"][0].as_py()
        own = fold(_matrix(table), fanout, height(n, fanout, levels))
        return pa.table({
            "tree": table["tree"].slice(0, 1), "place": pa.array([table["block"][0].as_py()], pa.int64()), "n": pa.array([-(-n // per)], pa.int64()),
            "digest": pa.array([own[-1].tobytes().decode()], pa.string()),
        })

    return _grouped(nodes.withColumn("block", F.floor(F.col("place") / per).cast("long")), run, "tree string, place long, n long, digest string")


_ABOVE = "array<struct<l:string,r:string>>"
_PATHS = pa.list_(pa.struct([("l", pa.string()), ("r", pa.string())]))


def _paths(nodes: DataFrame, above: DataFrame, fanout: int, levels: int) -> DataFrame:
    """(tree, place, path): the siblings of every node of ``nodes`` up to the root; ``above`` (tree, place, path) has those of the
    roots of its blocks."""
    per = fanout**levels

    def run(key: tuple, table: pa.Table, upper: pa.Table) -> pa.Table:
        matrix = _matrix(table)
        n, block = table["n"][0].as_py(), table["block"][0].as_py()
        own = fold(matrix, fanout, height(n, fanout, levels))
        rest = upper["path"][0].as_py()
        places = np.arange(len(matrix))
        paths = [[{"l": a.decode(), "r": b.decode()} for a, b in siblings(own, int(i), fanout)] + rest for i in places]
        return pa.table({"tree": pa.array([table["tree"][0].as_py()] * len(matrix), pa.string()), "place": pa.array(places + block * per, pa.int64()), "path": pa.array(paths, _PATHS)})

    _ship(nodes)
    below = nodes.withColumn("block", F.floor(F.col("place") / per).cast("long")).groupBy("tree", "block")
    return below.cogroup(above.withColumnRenamed("place", "block").groupBy("tree", "block")).applyInArrow(run, f"tree string, place long, path {_ABOVE}")


def _tree(nodes: DataFrame, fanout: int, levels: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The rounds of nodes (the given ones first) and the roots (tree, digest)."""
    rounds = [nodes]
    while True:
        top = cut(_blocks(rounds[-1], fanout, levels), f"merkle-{name}")
        if top.where("n > 1").isEmpty():
            return rounds, top.select("tree", "digest")
        rounds.append(top)


def manifest(docs: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """One row per row of ``docs``: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A leaf is ``leaf_digest`` of doc_id, source, lang, n_chars and text; per lang leaves ascend by doc_id, and subroots by lang, null
    before all others (a null lang is a tree of its own). proof_sha256 is the hash of the leaf's siblings, level by level up to the
    root. ``folded_root`` comes from the original siblings and the leaf of the row as it is after tampering: where ``tampered``
    holds, A-Z of the text are lower-cased. ``verified`` says whether it equals root.

    ``fanout`` is at least 2; ``levels`` is how many levels one task folds and changes no result. Rows that share a doc_id stand by
    their leaf digest, null ids first; rows that are equal in all five fields have equal leaves, so their order does not matter.
    An empty table gives an empty result; other columns are ignored, whatever their names."""
    c = {name: F.col(name) for name in FIELDS}
    changed = leaf_digest(c["doc_id"], c["source"], c["lang"], c["n_chars"], ascii_lower(c["text"]))
    leaves = docs.select(
        F.concat(F.lit("="), c["lang"].cast("string")).alias("tree"), c["doc_id"].cast("long").alias("doc_id"), leaf_digest(*c.values()).alias("digest"), F.when(tampered(c["doc_id"]), changed).alias("changed")
    )
    leaves = leaves.withColumn("tree", F.coalesce("tree", F.lit("")))  # "" is null; a lang has = before it, so that it sorts behind
    placed = numbered(leaves, ["tree"], ["doc_id", "digest"], "place", "merkle-places").withColumn("place", F.col("place") - 1)
    sizes = placed.groupBy("tree").agg(F.count(F.lit(1)).alias("n"))
    placed = cut(placed.join(sizes, "tree"), "merkle-leaves")

    rounds, subroots = _tree(placed.select("tree", "place", "n", "digest"), fanout, levels, "nodes")
    # The tree over the languages: one tree whose leaves are the subroots. Spark compares strings by their UTF-8 bytes.
    upper = numbered(subroots.withColumnRenamed("tree", "lang_key"), [], ["lang_key"], "place", "merkle-langs")
    count = upper.agg(F.count(F.lit(1)).alias("n"))
    upper = cut(upper.crossJoin(F.broadcast(count)).select("lang_key", F.lit("").alias("tree"), (F.col("place") - 1).alias("place"), "n", "digest"), "merkle-subroots")
    tops, roots = _tree(upper.select("tree", "place", "n", "digest"), fanout, levels, "tops")

    above = roots.select("tree", F.lit(0).cast("long").alias("place"), F.array().cast(_ABOVE).alias("path"))
    for nodes in reversed(tops):
        above = cut(_paths(nodes, above, fanout, levels), "merkle-paths")
    above = upper.select("lang_key", "place").join(above.drop("tree"), "place").select(F.col("lang_key").alias("tree"), F.lit(0).cast("long").alias("place"), "path")
    for nodes in reversed(rounds[1:]):
        above = cut(_paths(nodes, above, fanout, levels), "merkle-paths")

    answer = _answers(placed, above, fanout, levels)
    ends = upper.select(F.col("lang_key").alias("tree"), F.col("digest").alias("subroot")).crossJoin(F.broadcast(roots.select(F.col("digest").alias("root"))))
    out = answer.join(ends, "tree")
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


def _answers(placed: DataFrame, above: DataFrame, fanout: int, levels: int) -> DataFrame:
    """(tree, doc_id, leaf, proof_sha256, folded): what each leaf's siblings say; ``folded`` is hashed up from every leaf, as it is after
    tampering where that changes it. Paths are made and used leaf by leaf inside a block, so proofs are never stored."""
    per = fanout**levels

    def run(key: tuple, table: pa.Table, upper: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        own = fold(_matrix(table), fanout, height(table["n"][0].as_py(), fanout, levels))
        rest = [(p["l"].encode(), p["r"].encode()) for p in upper["path"][0].as_py()]
        tail = b"".join(a + b for a, b in rest)
        proofs, folded = [], []
        for i, (digest, changed) in enumerate(zip(table["digest"].to_pylist(), table["changed"].to_pylist())):
            path = siblings(own, i, fanout)
            proofs.append(hashlib.sha256(b"".join(a + b for a, b in path) + tail).hexdigest())
            folded.append(refold((digest if changed is None else changed).encode(), path + rest).decode())
        return pa.table({"tree": table["tree"], "doc_id": table["doc_id"], "leaf": table["digest"], "proof_sha256": pa.array(proofs, pa.string()), "folded": pa.array(folded, pa.string())})

    _ship(placed)
    below = placed.withColumn("block", F.floor(F.col("place") / per).cast("long")).groupBy("tree", "block")
    upper = above.withColumnRenamed("place", "block").groupBy("tree", "block")
    return below.cogroup(upper).applyInArrow(run, "tree string, doc_id long, leaf string, proof_sha256 string, folded string")
