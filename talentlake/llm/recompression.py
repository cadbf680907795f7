"""Substring dedup by recompression.

Words are named by 64-bit fingerprints. A level of recompression first names the inside of long runs of one
symbol and then names pairs: every symbol falls into a left or right class by a hash of its name, and a left
symbol followed by a right one becomes one symbol. A name depends on nothing but what it stands for, so the parse of a
passage is the same wherever it occurs, but for a few symbols at its edges.

What a window of WINDOW words can know of the parse is tracked exactly: for each start (and each end) the first
(last) symbol boundary that the words inside settle, level by level. The anchor of a window is the widest of the settled
symbols of the highest level that has any, so equal windows have equal anchors, and neighbouring windows mostly share one.
Then, on Spark:

1. documents with equal word sequences are settled as a whole: all but the first lose what windows cover, which is
   everything,
2. rounds: after each of the levels in ``rounds`` the symbols that are anchors are counted over all documents. A window whose
   anchor occurs once has no equal and goes; the documents that keep a window go into the next round, if there is one,
3. a fingerprint of all words proposes for each window with a shared anchor the earliest equal one,
4. words are compared over all that is proposed. Names and fingerprints that collide cost time only.

Every exchange of rounds and fingerprints holds a few bytes per anchor or window; only documents with a shared anchor are read again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name, map_text, release

WINDOW = 20
#: The levels of recompression after which the symbols of all documents are counted.
ROUNDS = (4,)
#: Bytes whose words are named at once; a longer word is named by itself.
STRETCH = 1 << 17
U = np.uint64

_BASE = xxhash.xxh64_intdigest(b"base") | 1
_LETTERS = np.array([xxhash.xxh64_intdigest(bytes([i])) for i in range(256)], U)
_POWERS, _INVERSES = (np.cumprod(np.append(U(1), np.full(2 * STRETCH, b, U))) for b in (_BASE, pow(_BASE, -1, 2**64)))


def mix(a: np.ndarray, b: np.ndarray | int, salt: int) -> np.ndarray:
    """A fingerprint of the ordered pair (a, b)."""
    x = a * U(0x9E3779B97F4A7C15) + U(salt * 0xD6E8FEB86659FD93 % 2**64)
    x ^= x >> U(32)
    x = (x + (b if isinstance(b, np.ndarray) else U(b))) * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(29)
    x *= U(0x94D049BB133111EB)
    return x ^ (x >> U(32))


def spans(names: np.ndarray, width: int, salt: int) -> np.ndarray:
    """Fingerprints of the ``width`` names from each place on, by doubling; the last ones lack words and mean nothing."""
    out, size, done, power = None, 1, 0, names
    while True:
        if width & size:
            part = power[done:]
            out = power if out is None else mix(out[: len(part)], part, salt + 64 + size) if len(part) else out[:0]
            done += size
        size *= 2
        if size > width:
            return out
        power = mix(power[: max(0, len(power) - size // 2)], power[size // 2 :], salt + size)


class Words(NamedTuple):
    """The words of some texts: each text's joined by one space, all of these joined likewise, where in that each word begins and ends,
    the words' names, and the offset of each text among them."""

    lines: list[bytes]
    line: bytes
    begins: np.ndarray
    ends: np.ndarray
    names: np.ndarray
    offsets: np.ndarray


def word_names(line: bytes, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A fingerprint of each word of ``line``: a polynomial in its letters, a difference of running sums. It depends on the word alone."""
    letters, sizes = np.frombuffer(line, np.uint8), ends - begins
    names = np.empty(len(begins), U)
    cuts = np.searchsorted(begins, np.arange(0, len(letters) + STRETCH, STRETCH))
    for a, b in zip(cuts[:-1], cuts[1:]):
        if a < b:
            low = begins[a]
            first, last = begins[a:b] - low, np.minimum(ends[a:b] - low, 2 * STRETCH)
            sums = np.zeros(last[-1] + 1, U)
            np.cumsum(_LETTERS[letters[low : low + last[-1]]] * _POWERS[: last[-1]], out=sums[1:])
            names[a:b] = mix((sums[last] - sums[first]) * _INVERSES[first], sizes[a:b].astype(U), 5000)
    for i in np.flatnonzero(sizes > STRETCH):
        names[i] = xxhash.xxh64_intdigest(line[begins[i] : ends[i]])
    return names


def split_words(texts: list[bytes | None], bits: int = 64) -> Words:
    """The words of each text and their names of so many bits."""
    lines = [b" ".join(t.split()) if t else b"" for t in texts]
    line = b" ".join(filter(None, lines))
    spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 0x20)
    begins, ends = np.append(0, spaces + 1)[: len(line)], np.append(spaces, len(line))[: len(line)]
    offsets = np.zeros(len(lines) + 1, np.int64)
    np.cumsum([t.count(b" ") + 1 if t else 0 for t in lines], out=offsets[1:])
    names = word_names(line, begins, ends)
    return Words(lines, line, begins, ends, names >> U(64 - bits) if bits < 64 else names, offsets)


def window_starts(offsets: np.ndarray) -> np.ndarray:
    """The places where a window of WINDOW words of one text starts."""
    ok = np.zeros(int(offsets[-1]), bool)
    for a, b in zip(offsets[:-1], offsets[1:]):
        if b - a >= WINDOW:
            ok[a : b - WINDOW + 1] = True
    return np.flatnonzero(ok)


def least(rank: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The place of the least of ``rank[first]`` to ``rank[last]``, the leftmost of equals, for each pair of bounds."""
    out = np.empty(len(first), np.int64)
    power = np.log2(last - first + 1).astype(np.int64)
    table = np.arange(len(rank))  # at i, in turn: the least of one, two, four ... ranks from i on
    for k in range(int(power.max(initial=0)) + 1):
        now = np.flatnonzero(power == k)
        a, b = table[first[now]], table[last[now] - (1 << k) + 1]
        out[now] = np.where(rank[a] <= rank[b], a, b)
        a, b = table[: -(1 << k)], table[1 << k :]
        table = np.append(np.where(rank[a] <= rank[b], a, b), table[-(1 << k) :])
    return out


def anchors(names: np.ndarray, offsets: np.ndarray, starts: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """The anchor of the window at each of ``starts`` after so many levels: its place among ``names`` and its symbol."""
    n = len(names)
    place_of, symbol_of = np.zeros(len(starts), np.int64), np.zeros(len(starts), U)
    sym, at = names, np.arange(n, dtype=np.int64)
    first = np.zeros(n + 1, bool)
    first[offsets[offsets < n]] = True
    first[n] = True
    left, right = starts.copy(), starts + WINDOW
    live = np.arange(len(starts))

    def settle(sym: np.ndarray, at: np.ndarray, left: np.ndarray, right: np.ndarray, windows: np.ndarray) -> None:
        if len(windows):
            width = np.minimum(np.diff(np.append(at, n)), 255).astype(U)
            best = least(((U(255) - width) << U(56)) | (mix(sym, 0, 4000) >> U(8)), left, right - 1)
            place_of[windows], symbol_of[windows] = at[best], sym[best]

    for level in range(levels):
        before = sym, at, left, right, live
        # Runs: between its first and last symbol a run of four or more becomes one symbol.
        m = len(sym)
        begins = np.ones(m, bool)
        begins[1:] = (sym[1:] != sym[:-1]) | first[1:m]
        head = np.flatnonzero(begins)
        size = np.diff(np.append(head, m))
        run_of = np.cumsum(begins) - 1
        left_run, right_run = run_of[left], run_of[right - 1]
        several = right - left >= 2
        left = head[left_run] + size[left_run] - 1
        right = head[right_run] + 1
        keep = several & (left < right)
        live, left, right = live[keep], left[keep], right[keep]
        inner = np.zeros(m, bool)
        long = size >= 4
        if long.any():
            inner = long[run_of]
            inner[head] = False
            inner[head + size - 1] = False
            opens = inner & ~np.append(False, inner[:-1])
            sym = sym.copy()
            sym[opens] = mix(sym[opens], size[run_of[opens]].astype(U), 1000 + level)
            stays = ~inner | opens
            place = np.cumsum(stays) - 1
            left, right = place[left], place[right - 1] + 1
            sym, at, first = sym[stays], at[stays], np.append(first[:m][stays], True)
            m = len(sym)
        # Pairs: a left symbol and the right symbol after it become one.
        is_left = (mix(sym, 0, 2000 + level) >> U(63)).astype(bool)
        joins = np.zeros(m, bool)
        joins[:-1] = is_left[:-1] & ~is_left[1:] & ~first[1:m]
        left = left + ~is_left[left]
        right = right - is_left[right - 1]
        keep = left < right
        live, left, right = live[keep], left[keep], right[keep]
        j = np.flatnonzero(joins)
        sym = sym.copy()
        sym[j] = mix(sym[j], sym[j + 1], 3000 + level)
        stays = np.ones(m, bool)
        stays[j + 1] = False
        place = np.cumsum(stays) - 1
        left, right = place[left], place[right - 1] + 1
        sym, at, first = sym[stays], at[stays], np.append(first[:m][stays], True)
        # Windows without a settled symbol at this level have their anchor at the one before.
        gone = np.ones(len(starts), bool)
        gone[live] = False
        gone = gone[before[4]]
        settle(*before[:2], *(x[gone] for x in before[2:]))
    settle(sym, at, left, right, live)
    return place_of, symbol_of.view(np.int64)


#: Stands for a null doc_id: smaller than any other.
NO_ID = -(2**63)


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else [], kind))


def _keep_known(batch: pa.RecordBatch, starts: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """Those of ``starts`` whose anchor is one of the symbols that the documents list under ``keys``. A document lists every shared symbol
    of its own, so one list of them all does."""
    known = np.unique(batch.column("keys").flatten().to_numpy())
    if not len(known):
        return starts[:0]
    return starts[known[np.minimum(np.searchsorted(known, symbols), len(known) - 1)] == symbols]


def _round(levels: int, earlier: int | None, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task of a round: the anchors of each document's windows after ``levels``, those at several places twice. A later
    round looks only at windows whose anchor after ``earlier`` levels was shared; the first one describes the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = split_words(batch.column("text").cast(pa.binary()).to_pylist(), bits)
            names, offsets = words.names, words.offsets
            starts = window_starts(offsets)
            if earlier is not None:
                starts = _keep_known(batch, starts, anchors(names, offsets, starts, earlier)[1])
            places, symbols = anchors(names, offsets, starts, levels)
            places, some = np.unique(places, return_index=True)
            edges = np.searchsorted(places, offsets)
            found = []
            for a, b in zip(edges[:-1], edges[1:]):
                keys, times = np.unique(symbols[some[a:b]], return_counts=True)
                found.append(np.repeat(keys, np.minimum(times, 2)))
            columns = {"id": batch.column("id"), "rev": batch.column("rev"), "keys": _lists(found, pa.int64())}
            if earlier is None:
                columns |= {"n_words": pa.array(np.diff(offsets)), "words_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in words.lines])}
            yield pa.RecordBatch.from_pydict(columns)

    return run


def _windows(levels: int, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The windows with a shared anchor: id, rev, start, a fingerprint of all its words, and whether an
    earlier one of the same block has the same words. Only the others need comparing with other blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = split_words(batch.column("text").cast(pa.binary()).to_pylist(), bits)
            names, offsets = words.names, words.offsets
            starts = window_starts(offsets)
            starts = _keep_known(batch, starts, anchors(names, offsets, starts, levels)[1])
            doc = np.searchsorted(offsets, starts, "right") - 1
            start = (starts - offsets[doc]).astype(np.int32)
            print_ = spans(names, WINDOW, 100)[starts]
            own_ids, own_revs = batch.column("id").to_numpy(), batch.column("rev").to_numpy()
            # Equal rows (a document that is there twice) have equal places, so that neither is later.
            by_place = np.lexsort((own_revs, own_ids))
            fresh = (np.diff(own_ids[by_place]) != 0) | (np.diff(own_revs[by_place]) != 0)
            rank = np.empty(len(by_place), np.int64)
            rank[by_place] = np.append(0, np.cumsum(fresh))
            place = (rank[doc] << 32) + start
            order = np.lexsort((place, print_))
            heads = np.append(True, print_[order[1:]] != print_[order[:-1]])[: len(order)]
            head = order[np.maximum.accumulate(np.where(heads, np.arange(len(order)), 0))]
            again = np.flatnonzero(place[order] != place[head])
            order, head = order[again], head[again]
            begin, from_ = words.begins[starts[order]], words.begins[starts[head]]
            size = words.ends[starts[order] + WINDOW - 1] - begin
            line = words.line
            same = [line[a : a + n] == line[b : b + n] for a, b, n in zip(begin.tolist(), from_.tolist(), size.tolist())]
            # The byte after the earlier window is checked too: its last word must end there.
            later = np.zeros(len(starts), bool)
            later[order] = np.array(same, bool) & (words.ends[starts[head] + WINDOW - 1] - from_ == size)
            ids, revs = own_ids[doc], own_revs[doc]
            yield pa.RecordBatch.from_arrays([
                pa.array(ids), pa.array(revs), pa.array(start), pa.array(print_.view(np.int64)), pa.array(later),
            ], ["id", "rev", "start", "print", "later"])

    return run


def _cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each document's later windows so many that every other one lies within two that point to the same passage: of a
    run of neighbours that point to neighbours each WINDOW-th and the last."""
    for batch in batches:
        for k, (rev, id_) in enumerate(zip(batch.column("rev").to_pylist(), batch.column("id").to_pylist())):
            rows = batch.column("later")[k].values
            start, eid, erev, estart = (rows.field(c).to_numpy() for c in ("start", "eid", "erev", "estart"))
            order = np.argsort(start, kind="stable")
            start, eid, erev, estart = start[order], eid[order], erev[order], estart[order]
            fresh = np.ones(len(start), bool)
            fresh[1:] = (np.diff(start) != 1) | (np.diff(estart) != 1) | (eid[1:] != eid[:-1]) | (erev[1:] != erev[:-1])
            begin = np.maximum.accumulate(np.where(fresh, np.arange(len(start)), 0))
            pick = ((np.arange(len(start)) - begin) % WINDOW == 0) | np.append(fresh[1:], True)
            n = int(pick.sum())
            yield pa.RecordBatch.from_arrays([
                pa.array([id_] * n, pa.int64()), pa.array([rev] * n, pa.int32()), pa.array(start[pick]), pa.array(eid[pick]), pa.array(erev[pick]), pa.array(estart[pick]),
            ], ["id", "rev", "start", "eid", "erev", "estart"])


def _window_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of the windows at the given places, some thousand windows at a time, each with what comes with its place."""
    for batch in batches:
        extra = [c for c in batch.schema.names if c not in ("text", "places")]
        for k, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
            words, own = text.split(), batch.column("places")[k].values
            for i in range(0, len(own), 5000):
                part = own.slice(i, 5000)
                texts = pa.array([b" ".join(words[s : s + WINDOW]) for s in part.field("start").to_pylist()], pa.binary()).cast(pa.string())
                same = [pa.array([batch.column(c)[k].as_py()] * len(part), batch.column(c).type) for c in extra]
                yield pa.RecordBatch.from_arrays([*same, *part.flatten(), texts], [*extra, *[f.name for f in part.type], "words"])


def strip(words: list[bytes], starts: list[int] | None) -> list[bytes]:
    """``words`` without those covered by a window at one of ``starts``."""
    change = np.zeros(len(words) + 1, np.int64)
    at = np.asarray(starts or [], np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + WINDOW, -1)
    return [w for w, covered in zip(words, np.cumsum(change[:-1])) if not covered]


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = [strip(t.split(), s) for t, s in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("starts").to_pylist())]
        texts = [b" ".join(k) for k in kept]
        yield pa.RecordBatch.from_arrays([
            batch.column("id"), batch.column("rev"), pa.array([len(k) for k in kept], pa.int64()),
            pa.array([hashlib.sha256(t).hexdigest() for t in texts]), pa.array(texts, pa.binary()).cast(pa.string()),
        ], ["id", "rev", "n_kept", "kept_sha256", "kept_text"])


def _keyed(docs: DataFrame) -> DataFrame:
    """id, rev, text: rev tells rows apart that share an id but not the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.hash(text).alias("rev"), text.alias("text"))


def _shared(table: DataFrame, name: str) -> DataFrame:
    """id, rev, keys: of the symbols that the documents list, those that occur more than once in all of them."""
    found = table.select("id", "rev", F.explode("keys").alias("key"))
    again = cut(found.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), f"{name}-again")
    keys = found.join(again.hint("shuffle_hash"), "key", "left_semi").groupBy("id", "rev").agg(F.collect_set("key").alias("keys"))
    return cut(keys, f"{name}-keys")


def _words_of(texts: DataFrame, places: DataFrame, *labels: str) -> DataFrame:
    """The words of the windows at ``places`` (id, rev, start and labels)."""
    kinds = dict(places.dtypes)
    lists = places.groupBy("id", "rev").agg(F.collect_set(F.struct("start", *labels)).alias("places"))
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("id", "rev", "start", *labels)) + ", words string"
    return map_text(texts.join(lists.hint("shuffle_hash"), ["id", "rev"]), _window_words, schema)


def _later(windows: DataFrame, texts: DataFrame) -> DataFrame:
    """id, rev, start of the ``windows`` (id, rev, start, print) that an earlier one equals word for word.

    Fingerprints propose the earliest place of each window, and words are compared at windows that cover all proposed. If any
    two differ, some names or fingerprints collide, and all windows with a shared fingerprint are grouped by their words."""
    # A block sends each window once, so the rows of the commonest one are as many as blocks, here and where words decide.
    dealt = windows.repartition("print")
    place = F.struct("id", "rev", "start")
    first = dealt.groupBy("print").agg(F.min(place).alias("earliest"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    pairs = dealt.join(first.hint("shuffle_hash"), "print").where(place > F.col("earliest"))
    pointer = F.struct("start", F.col("earliest.id").alias("eid"), F.col("earliest.rev").alias("erev"), F.col("earliest.start").alias("estart"))
    proposed = cut(pairs.groupBy("id", "rev").agg(F.collect_list(pointer).alias("later")), "passages-proposed")
    cover = cut(proposed.mapInArrow(_cover, "id long, rev int, start int, eid long, erev int, estart int"), "passages-cover")
    sources = cover.select(F.col("eid").alias("id"), F.col("erev").alias("rev"), F.col("estart").alias("start"), "eid", "erev", "estart").distinct()
    words = _words_of(texts, cover.unionByName(sources), "eid", "erev", "estart")
    compared = words.groupBy("eid", "erev", "estart").agg(F.min("words").alias("low"), F.max("words").alias("high"))
    if compared.where("low <> high").isEmpty():
        release(cover)
        return proposed.select("id", "rev", F.explode("later.start").alias("start"))
    shared = windows.join(first.select("print").hint("shuffle_hash"), "print", "left_semi").select("id", "rev", "start")
    words = cut(_words_of(texts, shared), "passages-words")
    release(cover, proposed)
    earliest = words.groupBy("words").agg(F.min(place).alias("earliest"))
    return words.join(earliest, "words").where(place > F.col("earliest")).select("id", "rev", "start")


def repeated_passages(docs: DataFrame, name_bits: int = 64, rounds: tuple[int, ...] = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(profile, cleaned). profile has a row per document: id, rev, n_words, words_sha256, copy (its whole word
    sequence is that of an earlier document). cleaned has a row for each document that is no copy and loses words:
    id, rev, n_kept, kept_sha256, kept_text. Names of fewer bits give the same result (tests)."""
    known = _keyed(docs)
    table = cut(map_text(known, _round(rounds[0], None, name_bits), "id long, rev int, keys array<long>, n_words long, words_sha256 string"), "passages-table")
    first = table.groupBy("words_sha256").agg(F.min("id").alias("first_id"))
    profile = table.select("id", "rev", "n_words", "words_sha256").join(first, "words_sha256")
    profile = cut(profile.select("id", "rev", "n_words", "words_sha256", (F.col("id") > F.col("first_id")).alias("copy")), "passages-profile")
    single = table.join(profile.where("copy").select("id", "rev"), ["id", "rev"], "left_anti")
    keys = _shared(single, "passages-1")
    release(table)
    some = cut(known.join(keys.hint("shuffle_hash"), ["id", "rev"]), "passages-candidates-1")
    for k, (earlier, levels) in enumerate(zip(rounds, rounds[1:]), 2):
        table = cut(map_text(some, _round(levels, earlier, name_bits), "id long, rev int, keys array<long>"), f"passages-{k}-table")
        keys = _shared(table, f"passages-{k}")
        fewer = cut(some.drop("keys").join(keys.hint("shuffle_hash"), ["id", "rev"]), f"passages-candidates-{k}")
        release(table, some)
        some = fewer
    windows = cut(map_text(some, _windows(rounds[-1], name_bits), "id long, rev int, start int, print long, later boolean"), "passages-windows")
    texts = some.select("id", "rev", "text")
    later = _later(windows.where("not later").drop("later"), texts)
    later = later.unionByName(windows.where("later").select("id", "rev", "start"))
    starts = cut(later.groupBy("id", "rev").agg(F.collect_list("start").alias("starts")), "passages-starts")
    release(windows)
    cleaned = map_text(texts.join(starts.hint("shuffle_hash"), ["id", "rev"]), _cleaned, "id long, rev int, n_kept long, kept_sha256 string, kept_text string")
    return profile, cleaned.dropDuplicates(["id", "rev"])


EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def passage_report(docs: DataFrame, name_bits: int = 64, rounds: tuple[int, ...] = ROUNDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space).

    Null text has no words. A null doc_id comes before all others. Rows that repeat doc_id and text count as one
    document, so neither removes the other, and both get its row; rows that share a doc_id but not the text are
    ordered by a hash of the text. Documents of under WINDOW words lose nothing. An empty table gives an empty
    result; extra columns are ignored."""
    profile, cleaned = repeated_passages(docs, name_bits, rounds)
    rows = profile.join(cleaned.drop("kept_text"), ["id", "rev"], "left")
    gone = F.col("copy") & (F.col("n_words") >= WINDOW)
    kept = F.when(gone, 0).otherwise(F.coalesce(F.col("n_kept"), F.col("n_words")))
    sha = F.when(gone, EMPTY_SHA).otherwise(F.coalesce(F.col("kept_sha256"), F.col("words_sha256")))
    return rows.select(F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "n_words", (F.col("n_words") - kept).cast("long").alias("n_removed"), sha.alias("kept_sha256"))


def drop_passages(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns, each text without the words that ``passage_report`` removes.

    A text that loses nothing stays as it is; others are their kept words joined by one space. Documents of which
    nothing is left stay, with an empty text, as do null texts."""
    profile, cleaned = repeated_passages(docs)
    gone = profile.where(F.col("copy") & (F.col("n_words") >= WINDOW)).select("id", "rev", F.lit("").alias("kept_text"))
    changed = cleaned.select("id", "rev", "kept_text").unionByName(gone.distinct())
    id_, rev, new = free_name(docs, "passage_id", "passage_rev", "passage_text")
    changed = changed.select(F.col("id").alias(id_), F.col("rev").alias(rev), F.col("kept_text").alias(new))
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.withColumn(id_, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).withColumn(rev, F.hash(text))
    out = keyed.join(changed, [id_, rev], "left").withColumn("text", F.coalesce(F.col(new), F.col("text")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
