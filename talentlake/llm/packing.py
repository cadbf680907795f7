"""Best-fit packing with certified bin counts.

Documents become pieces of at most ``capacity`` tokens. Full pieces are sequences of their own. The others are dealt by a
hash to groups of some GROUP pieces; each group is packed by best-fit decreasing, and dual-feasible functions give a
lower bound for the sequences that its pieces need. A group that meets its bound is certified. Groups with a gap put the
pieces of their sequences that are not full into a pool, as do the certified ones with their emptiest sequence (each
rounds up once); the pool is dealt anew and packed again. A round that does not save sequences is not taken, and is the
last, as is the last of ``rounds``; each piece says whether its group met its bound. No task sees more than a group; the
driver sees counts.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import cut, map_text
from .transducer import byte_alphabet

GROUP = 8192
ROUNDS = 4


class Encoder:
    """Ids of a tokenizers file. Where its merges are numbered as their tokens (as in public byte-level files) the same
    ids come from the faster tiktoken; its rare failures (a run of white space that exhausts its pattern engine), texts of
    over a million characters and other files go to the tokenizers library, which gives the same ids."""

    def __init__(self, path: str):
        self.slow, self.fast = Tokenizer.from_file(path), None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
            return
        vocab, letters = model["vocab"], byte_alphabet()
        merged = [p.replace(" ", "") if isinstance(p, str) else "".join(p) for p in model["merges"]]
        if [vocab[t] for t in merged] != list(range(len(vocab) - len(merged), len(vocab))):
            return
        ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items()}
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        #: Fixed value: the byte-level pre-tokenizer's pattern.
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        self.fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self.special = set(special)

    def encode(self, text: str) -> np.ndarray:
        if self.fast is not None and len(text) < 1_000_000:
            try:
                return self.fast.encode_to_numpy(text, allowed_special=self.special)
            except BaseException as e:  # noqa: BLE001  its panics are no Exceptions
                if isinstance(e, KeyboardInterrupt | SystemExit | GeneratorExit | MemoryError):
                    raise
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces_of(docs: DataFrame, path: str, capacity: int, end_id: int, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every piece. Only documents longer than ``capacity`` are cut;
    then the first piece takes what is left over, so that all others are full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            rows, parts, crcs = [], [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                ids = np.append(coder.encode(text), end_id).astype("<u4")
                start, length, piece = 0, len(ids) % capacity or min(capacity, len(ids)), 0
                while start < len(ids):
                    part = ids[start : start + length]
                    rows.append((k, piece, start, length))
                    crcs.append(zlib.crc32(part.tobytes()))
                    if with_ids:
                        parts.append(part)
                    start, length, piece = start + length, capacity, piece + 1
            at = np.array(rows, np.int64).reshape(-1, 4)
            cols = {
                "doc_id": batch.column("doc_id").take(pa.array(at[:, 0])), "piece": pa.array(at[:, 1].astype(np.int32)), "start": pa.array(at[:, 2]),
                "length": pa.array(at[:, 3]), "ids_crc32": pa.array(np.array(crcs, np.int64)),
            }
            if with_ids:
                cols["ids"] = pa.array(parts, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(cols)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return map_text(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")), run, schema)


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Bins that ``sizes`` need at least: the best of the volume bound and two families of dual-feasible functions."""
    counts = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1)
    best = -(-int((counts * size).sum()) // capacity)
    weight, total = np.append(0, np.cumsum(counts * size)), np.append(0, np.cumsum(counts))
    for k in range(1, capacity // 2 + 1):
        # Over capacity - k: a bin each. From k to capacity - k: their volume. Below k: nothing.
        big = int(total[-1] - total[capacity - k + 1])
        best = max(best, big - (-int(weight[capacity - k + 1] - weight[k]) // capacity))
    for k in range(2, 21):
        # Rounding: x counts as floor((k + 1) x / capacity) of k, unless (k + 1) x is a multiple of the capacity.
        scaled = (k + 1) * size
        value = np.where(scaled % capacity == 0, scaled * k, (scaled // capacity) * capacity * (k + 1))
        best = max(best, -(-int((counts * value).sum()) // (capacity * k * (k + 1))))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(bin, offset) of each size, taken from the largest down, and the room left in each bin."""
    bins, offsets, room = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = 0  # bit r: some bin has just r left
    for i in np.argsort(-sizes, kind="stable").tolist():
        n = int(sizes[i])
        fits = open_rooms >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                open_rooms &= ~(1 << r)
        else:
            b, r = len(room), capacity
            room.append(capacity)
        bins[i], offsets[i] = b, capacity - r
        room[b] = r - n
        if r > n:
            by_room[r - n].append(b)
            open_rooms |= 1 << (r - n)
    return bins, offsets, room


def _pack(items: DataFrame, capacity: int, round_: int, groups: int) -> DataFrame:
    """Items dealt to ``groups`` and packed: sequence_id, offset, certified, and pool (its sequence may be packed anew).

    Items are read from a written table, so a row's number is the same when a task runs again; it keeps rows with one id,
    or none, from meeting in one group."""

    def one(table: pa.Table) -> pa.Table:
        by = [("length", "descending"), ("ids_crc32", "ascending"), ("start", "ascending"), ("piece", "ascending"), ("doc_id", "ascending")]
        table = table.sort_by(by)
        sizes = table.column("length").to_numpy()
        bins, offsets, room = best_fit_decreasing(sizes, capacity)
        room, gap = np.array(room), len(room) > lower_bound(sizes, capacity)
        pool = (room > 0) if gap else (np.arange(len(room)) == int(room.argmax())) & (room > 0)
        ids = (np.int64(round_) << 56) + (np.int64(table.column("grp")[0].as_py()) << 24) + bins
        new = {"sequence_id": ids, "offset": offsets, "certified": np.full(len(bins), not gap), "pool": pool[bins]}
        for name, values in new.items():
            table = table.append_column(name, pa.array(values))
        return table

    dealt = items.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece", "start", F.monotonically_increasing_id(), F.lit(round_)), F.lit(groups)).cast("int"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, grp int, sequence_id long, offset long, certified boolean, pool boolean"
    return dealt.groupBy("grp").applyInArrow(one, schema)


def _sequences(packed: DataFrame) -> tuple[int, int, int]:
    """Sequences, those in the pool, and the pieces in the pool."""
    per = packed.groupBy("sequence_id").agg(F.max("pool").alias("pool"), F.count(F.lit(1)).alias("n"))
    pool = F.col("pool").cast("long")
    row = per.agg(F.count(F.lit(1)).alias("all"), F.coalesce(F.sum(pool), F.lit(0)).alias("pool"), F.coalesce(F.sum(pool * F.col("n")), F.lit(0)).alias("rows")).first()
    return row["all"], row["pool"], row["rows"]


def pack_pieces(pieces: DataFrame, capacity: int = 1024, group: int = GROUP, rounds: int = ROUNDS) -> DataFrame:
    """``pieces`` (doc_id, piece, start, length, ids_crc32; a written table) with sequence_id, offset and certified: whether
    the group that the piece was packed with needs no fewer sequences. Groups are packed at most ``rounds`` times."""
    columns = [*pieces.columns, "sequence_id", "offset", "certified"]
    full = pieces.where(F.col("length") >= capacity)
    out = full.withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long"), "certified": F.lit(True)}).select(*columns)
    items = pieces.where(F.col("length") < capacity)
    current, round_ = cut(_pack(items, capacity, 1, max(1, -(-items.count() // group))), "packing-round"), 1
    _, pool, rows = _sequences(current)
    while pool > 1 and round_ < rounds:
        round_ += 1
        again = cut(_pack(current.where("pool").select(*pieces.columns), capacity, round_, -(-rows // group)), "packing-round")
        used, next_pool, rows = _sequences(again)
        if used >= pool:
            break
        out = out.unionByName(current.where("not pool").select(*columns))
        current, pool = again, next_pool
    return out.unionByName(current.select(*columns))


def pack_documents(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """All documents packed into sequences of at most ``capacity`` tokens: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset, certified (see ``pack_pieces``), one row per piece.

    A document is its ids and ``end_id``; null text counts as empty and so is one token. Special strings in a text are
    special tokens, as the tokenizers library has it by default. Rows with one doc_id are separate documents; a null
    doc_id stays null. An empty table gives an empty result; extra columns are ignored."""
    return pack_pieces(cut(pieces_of(docs, path, capacity, end_id), "packing-pieces"), capacity)


def sequences(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (array), doc_ids and lengths in place order.

    Repeated rows stand in it as often as they are there, null ids as null; an empty table gives an empty result."""
    pieces = cut(pieces_of(docs, path, capacity, end_id, with_ids=True), "packing-ids")
    placed = pack_pieces(pieces.drop("ids"), capacity)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    on = [placed[k].eqNullSafe(pieces[k]) for k in key]
    held = placed.join(pieces.dropDuplicates(key), on).select("sequence_id", F.struct("offset", placed["doc_id"], placed["length"], "ids").alias("p"))
    lists = held.groupBy("sequence_id").agg(F.array_sort(F.collect_list("p")).alias("ps"))  # at most ``capacity`` pieces
    return lists.select("sequence_id", F.flatten("ps.ids").alias("ids"), F.col("ps.doc_id").alias("doc_ids"), F.col("ps.length").alias("lengths"))
