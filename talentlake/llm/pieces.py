"""SentencePiece encoding and decoding with the N best segmentations.

A text is a lattice: its characters and, between them, every piece of the vocabulary that spells what lies there, with the
piece's score; a character without a piece is an unknown one and becomes its bytes. Forward Viterbi gives the best score of
each prefix. That is an exact heuristic for A-star from the end of the text to its start, so complete segmentations come
out best first.

No piece reaches over a place where a word begins, so the lattice falls into segments, and a document's score is the sum
over them. Each distinct segment is solved once: Viterbi runs over many side by side, forwards for the best segmentation
and backwards for what its second best loses. Only the segments of a document that lose least can differ from the best in
its N best; those are searched by A-star, and the sums of their lists are merged best first. A segment of over LONG characters
(a text without spaces) is not laid out whole: its edges are made block by block where Viterbi or the search needs them.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from operator import itemgetter

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_text

MARK = "▁"
SEGMENT = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
UNKNOWN_PENALTY = 10.0
KNOWN_SEGMENTS = 400_000
LONG, BLOCK = 20_000, 4096
TRIE_BITS = 18
NO_EDGE, UNKNOWN = -2, -1


class Pieces:
    """The vocabulary of a model file whose normalizer leaves text as it is."""

    def __init__(self, path: str):
        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.vocab_size()
        self.text = [m.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        self.score = np.array([m.get_score(i) for i in range(n)])
        self.ids = {self.text[i]: i for i in plain}
        self.unknown_score = float(self.score[plain].min()) - UNKNOWN_PENALTY
        self.unk = m.unk_id()
        self.byte = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.has_bytes = all(m.is_byte(i) for i in self.byte)
        self.plain = [t.encode() for t in self.text]
        for b, i in enumerate(self.byte):
            if self.has_bytes:
                self.plain[i] = bytes([b])
        inside = [t for t in self.ids if MARK in t.lstrip(MARK)]
        if inside or m.normalize("Ａ") != MARK + "Ａ":
            raise ValueError("pieces that reach over words, or a normalizer, are not supported")
        # A trie over code points: (node, code point) -> node, as sorted keys.
        child: dict[int, int] = {}
        piece = [-1]
        for t, i in self.ids.items():
            node = 0
            for c in t:
                node = child.setdefault(node << 21 | ord(c), len(piece))
                if node == len(piece):
                    piece.append(-1)
            piece[node] = i
        self.longest = max(map(len, self.ids))
        self.trie_piece = np.array(piece)
        self.keys, self.to = np.full(1 << TRIE_BITS, -1, np.int64), np.zeros(1 << TRIE_BITS, np.int64)
        if len(child) * 2 > 1 << TRIE_BITS:
            raise ValueError("the vocabulary is too large")
        for k, slot in zip(child, self._slots(np.array(list(child), np.int64)).tolist()):
            while self.keys[slot] >= 0:
                slot = (slot + 1) & ((1 << TRIE_BITS) - 1)
            self.keys[slot], self.to[slot] = k, child[k]

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.int64(-7046029254386353131) >> np.int64(64 - TRIE_BITS)) & np.int64((1 << TRIE_BITS) - 1)

    def step(self, node: np.ndarray, points: np.ndarray) -> np.ndarray:
        """The trie nodes reached, -1 where there is none."""
        keys = node << 21 | points
        slots = self._slots(keys)
        held = self.keys[slots]
        seek = np.flatnonzero((held != keys) & (held >= 0))
        while len(seek):
            slots[seek] = (slots[seek] + 1) & ((1 << TRIE_BITS) - 1)
            held[seek] = self.keys[slots[seek]]
            seek = seek[(held[seek] != keys[seek]) & (held[seek] >= 0)]
        return np.where(held == keys, self.to[slots], -1)

    def prepare(self, text: str) -> str:
        """The text over which the lattice stands: spaces are marks, and one stands before the text."""
        return MARK + text.replace(" ", MARK) if text else ""

    def spelled(self, edge: int, char: str) -> list[int]:
        """The ids that an edge stands for; UNKNOWN is the character ``char``."""
        if edge >= 0:
            return [edge]
        return [self.byte[b] for b in char.encode()] if self.has_bytes else [self.unk]

    def decode(self, ids: np.ndarray | list[int]) -> str:
        """The text of ids: bytes are joined, marks become spaces, and the mark before the text goes."""
        return self.shown(b"".join(map(self.plain.__getitem__, ids)))

    def shown(self, spelled: bytes) -> str:
        text = spelled.decode(errors="replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


@lru_cache(2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


class Lattice:
    """The lattices of many segments, one after another. Places are numbered through, with one more at each segment's end;
    row p of ``ids`` and ``scores`` has the edges that end at p, by their length less one."""

    def __init__(self, model: Pieces, segments: list[str], solve: bool = True):
        self.model, self.segments = model, segments
        points = np.frombuffer("".join(s + "\0" for s in segments).encode("utf-32-le"), np.uint32).astype(np.int64)
        sizes = np.fromiter(map(len, segments), np.int64, len(segments))
        self.first = np.cumsum(sizes + 1) - sizes - 1
        self.last = self.first + sizes
        n = len(points)
        inside = np.ones(n, bool)
        inside[self.last] = False
        self.ids = np.full((n, model.longest), NO_EDGE, np.int32)
        begin = np.flatnonzero(inside)
        node = np.zeros(len(begin), np.int64)
        for length in range(1, model.longest + 1):
            node = model.step(node, points[begin + length - 1])
            ok = (node >= 0) & inside[begin + length - 1]
            begin, node = begin[ok], node[ok]
            piece = model.trie_piece[node]
            hit = piece >= 0
            self.ids[begin[hit] + length, length - 1] = piece[hit]
        ends = np.flatnonzero(inside) + 1
        lone = ends[self.ids[ends, 0] == NO_EDGE]
        self.ids[lone, 0] = UNKNOWN
        self.scores = np.where(self.ids >= 0, model.score[self.ids], -np.inf)
        self.scores[lone, 0] = model.unknown_score
        if solve:
            self._solve(n, np.repeat(np.arange(len(segments)), sizes + 1))

    def _solve(self, n: int, owner: np.ndarray) -> None:
        back = np.arange(1, self.model.longest + 1)
        column, places = back - 1, np.arange(n)

        def sweep(depth: np.ndarray, start: np.ndarray, candidates) -> tuple[np.ndarray, np.ndarray]:
            best, by = np.full(n, -np.inf), np.zeros(n, np.int32)
            best[start] = 0.0
            order = np.argsort(depth, kind="stable")
            cuts = np.searchsorted(depth[order], np.arange(1, int(depth.max(initial=0)) + 2))
            for t, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:]), 1):
                at = order[lo:hi]
                value = candidates(best, at, min(t, self.model.longest))  # no edge is longer than the way back
                by[at] = value.argmax(axis=1)
                best[at] = value[np.arange(len(at)), by[at]]
            return best, by

        self.forward, by = sweep(places - self.first[owner], self.first, lambda best, at, k: best[at[:, None] - back[:k]] + self.scores[at, :k])

        def onward(best: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
            to = at[:, None] + back[:k]
            return best[to] + self.scores[to, column[:k]]

        backward, _ = sweep(self.last[owner] - places, self.last, onward)
        # The best path of each segment, from its end, all side by side.
        through = self.forward[np.maximum(places[:, None] - back, 0)] + self.scores + backward[:, None]
        steps, now, of = [], self.last, np.arange(len(self.last))
        while len(now):
            left = now > self.first[of]
            now, of = now[left], of[left]
            steps.append(now)
            through[now, by[now]] = -np.inf
            now = now - 1 - by[now]
        self.best = self.forward[self.last]
        self.path = np.sort(np.concatenate(steps))
        self.path_ids, self.path_owner = self.ids[self.path, by[self.path]], owner[self.path]
        self.loss = self.best - np.maximum.reduceat(through.max(axis=1), self.first)

    def best_ids(self) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the best paths, one after another; how many of each segment)."""
        ids, owner = self.path_ids, self.path_owner
        lone = np.flatnonzero(ids == UNKNOWN)
        if len(lone):
            spelled = [self.model.spelled(UNKNOWN, self.segments[o][p]) for o, p in zip(owner[lone].tolist(), (self.path[lone] - 1 - self.first[owner[lone]]).tolist())]
            counts = np.ones(len(ids), np.int64)
            counts[lone] = list(map(len, spelled))
            ids, owner = np.repeat(ids, counts), np.repeat(owner, counts)
            ids[ids == UNKNOWN] = [i for out in spelled for i in out]
        return ids, np.bincount(owner, minlength=len(self.segments))

    def n_best(self, k: int, n: int) -> list[tuple[float, list[int]]]:
        """The ``n`` best segmentations of segment ``k``, as (score, ids), best first."""
        rows = slice(int(self.first[k]), int(self.last[k]) + 1)
        ids, scores = self.ids[rows].tolist(), self.scores[rows].tolist()
        return a_star(self.model, self.segments[k], self.forward[rows].tolist(), lambda place: (ids[place], scores[place]), n)


def a_star(model: Pieces, text: str, forward: list[float] | np.ndarray, edges, n: int) -> list[tuple[float, list[int]]]:
    """The ``n`` best segmentations of ``text``, as (score, ids), best first, from its end to its start; ``edges`` gives the ids
    and scores of what ends at a place, ``forward`` the best score of each prefix.

    Of equal paths the one nearest to the start goes on first, so ties do not widen the search; and as at most ``n`` of the
    best paths run through any one way to a place, a place is left for good when it has been taken up ``n`` times. Of the
    ways on from a place the next one waits in the queue until the one before it is taken."""
    size, count, found, taken = len(text), 0, [], {}
    queue = [(-float(forward[size]), size, 0, 0.0, None, None, 0)]  # a path that comes to a place, and the ways beside its last edge
    while queue and len(found) < n:
        _, place, _, done, chain, ways, nth = heapq.heappop(queue)
        if ways is not None and nth + 1 < len(ways[2]):
            before, rest, ordered = ways
            value, target, edge, score = ordered[nth + 1]
            count += 1
            heapq.heappush(queue, (-(before + value), target, count, before + score, (edge, target, rest), ways, nth + 1))
        if place == 0:
            out = []
            while chain is not None:
                edge, at, chain = chain
                out.append(model.spelled(edge, text[at]))
            found.append((done, [i for part in out for i in part]))
            continue
        times = taken[place] = taken.get(place, 0) + 1
        if times > n:
            continue
        ids, scores = edges(place)
        most = min(place, model.longest)
        on = [(float(forward[place - k - 1]) + scores[k], place - k - 1, ids[k], scores[k]) for k in range(most) if ids[k] != NO_EDGE]
        on.sort(key=lambda way: (-way[0], way[1]))
        value, target, edge, score = on[0]
        count += 1
        heapq.heappush(queue, (-(done + value), target, count, done + score, (edge, target, chain), (done, chain, on), 0))
    return found


class LongLattice:
    """The lattice of one long segment, of which a few blocks are laid out at a time."""

    def __init__(self, model: Pieces, segment: str):
        self.model, self.segment = model, segment
        self.block = lru_cache(8)(self._block)
        self.forward = np.full(len(segment) + 1, -np.inf)
        self.forward[0] = 0.0
        best = [0.0]  # of the last places, the nearest one last
        for start in range(0, len(segment), BLOCK):
            ids, scores = self.block(start // BLOCK)
            values = []
            for row in scores:
                now = max(map(float.__add__, reversed(best), row))
                values.append(now)
                best.append(now)
                if len(best) > 4 * model.longest:
                    del best[: -model.longest]
            self.forward[start + 1 : start + 1 + len(values)] = values

    def _block(self, k: int) -> tuple[list[list[int]], list[list[float]]]:
        """Ids and scores of the edges that end at the places k * BLOCK + 1 to (k + 1) * BLOCK."""
        most, low = self.model.longest, k * BLOCK
        back = min(low, most)
        part = Lattice(self.model, [self.segment[low - back : low + BLOCK]], solve=False)
        rows = slice(back + 1, min(back + BLOCK, len(part.segments[0])) + 1)
        return part.ids[rows].tolist(), part.scores[rows].tolist()

    def edges(self, place: int) -> tuple[list[int], list[float]]:
        ids, scores = self.block((place - 1) // BLOCK)
        return ids[(place - 1) % BLOCK], scores[(place - 1) % BLOCK]

    def n_best(self, n: int) -> list[tuple[float, list[int]]]:
        return a_star(self.model, self.segment, self.forward, self.edges, n)


class Segments(dict):
    """Segment -> number, with the solution of each: best ids and their bytes, best score, loss of the second best."""

    def __init__(self, model: Pieces):
        self.model = model
        self._empty()

    def _empty(self) -> None:
        self.clear()
        self.ids, self.starts = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.best, self.loss = np.zeros(0), np.zeros(0)
        self.bytes: list[bytes] = []
        self.lists: dict[tuple[str, int], list[tuple[float, np.ndarray, bytes]]] = {}

    def learn(self, segments: set[str], n: int = 2) -> None:
        new = list(segments.difference(self))
        if new and len(self) > KNOWN_SEGMENTS:
            self._empty()
            new = list(segments)
        if not new:
            return
        solved = []
        for part in blocks(new):  # the tables of a part go when it is solved
            if len(part[0]) > LONG:
                found = LongLattice(self.model, part[0]).n_best(max(n, 2))
                self._keep(part[0], max(n, 2), found)
                (best, ids), *second = found
                loss = best - second[0][0] if second else np.inf
                solved.append((np.array(ids, np.int32), np.array([len(ids)]), np.array([best]), np.array([loss])))
                continue
            lattice = Lattice(self.model, part)
            solved.append((*lattice.best_ids(), lattice.best, lattice.loss))
        ids, counts, best, loss = (np.concatenate(x) for x in zip(*solved))
        self.update(zip(new, range(len(self), len(self) + len(new))))
        ends = np.cumsum(counts)
        spelled = list(map(self.model.plain.__getitem__, ids.tolist()))
        self.bytes += [b"".join(spelled[a:b]) for a, b in zip((ends - counts).tolist(), ends.tolist())]
        self.ids = np.concatenate([self.ids, ids])
        self.starts = np.concatenate([self.starts, self.starts[-1] + ends])
        self.best, self.loss = np.concatenate([self.best, best]), np.concatenate([self.loss, loss])

    def search(self, segments: set[str], n: int) -> None:
        """The ``n`` best of each of ``segments``, if they are not known yet."""
        for part in blocks([s for s in segments if (s, n) not in self.lists]):
            long = len(part[0]) > LONG
            lattice = LongLattice(self.model, part[0]) if long else Lattice(self.model, part)
            for k, segment in enumerate(part):
                found = lattice.n_best(n) if long else lattice.n_best(k, n)
                self._keep(segment, n, found)

    def _keep(self, segment: str, n: int, found: list[tuple[float, list[int]]]) -> None:
        self.lists[segment, n] = [(score, np.array(ids, np.int32), b"".join(map(self.model.plain.__getitem__, ids))) for score, ids in found]


def blocks(segments: list[str], places: int = 200_000) -> Iterator[list[str]]:
    """``segments`` in parts of at most ``places`` characters; one of over LONG is a part of its own."""
    part, held = [], 0
    for s in segments:
        if part and (len(s) > LONG or held + len(s) + 1 > places):
            yield part
            part, held = [], 0
        part.append(s)
        held += places if len(s) > LONG else len(s) + 1
    if part:
        yield part


def encode_documents(known: Segments, texts: list[str], n: int) -> Iterator[list[tuple[float, np.ndarray, str]]]:
    """The ``n`` best segmentations of each text, as (score, ids, decoded text)."""
    split = [SEGMENT.findall(known.model.prepare(t)) for t in texts]
    known.learn(set().union(*split), n)
    places, chosen = [], []
    for segments in split:
        at = np.array(_picked(known, segments), np.int64)
        loss = known.loss[at]
        few = np.argpartition(loss, n - 1)[: n - 1] if len(loss) >= n else np.arange(len(loss))
        places.append(at)
        chosen.append(sorted(k for k in few.tolist() if n > 1 and np.isfinite(loss[k])))
    known.search({ss[k] for ss, ks in zip(split, chosen) for k in ks}, n)
    for segments, at, ks in zip(split, places, chosen):
        yield _document_n_best(known, segments, at, ks, n)


def _picked(source: dict | list, keys: list) -> list:
    """What ``source`` has under each of ``keys``, in one call."""
    return list(itemgetter(*keys)(source)) if len(keys) > 1 else [source[k] for k in keys]


def _document_n_best(known: Segments, segments: list[str], at: np.ndarray, chosen: list[int], n: int) -> list[tuple[float, np.ndarray, str]]:
    sizes = known.starts[at + 1] - known.starts[at]
    ends = np.cumsum(sizes)
    ids = known.ids[np.repeat(known.starts[at] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]
    spelled = _picked(known.bytes, at.tolist())
    total = float(known.best[at].sum())
    ways: list[tuple[float, tuple]] = [(0.0, ())]
    for k in chosen:
        options = known.lists[segments[k], n]
        top = options[0][0]
        sums = [(lost + top - option[0], swaps if i == 0 else (*swaps, (k, i))) for lost, swaps in ways for i, option in enumerate(options)]
        ways = heapq.nsmallest(n, sums)
    out = []
    for lost, swaps in ways:
        parts, start, text = [], 0, spelled
        for k, i in swaps:
            _, other, other_text = known.lists[segments[k], n][i]
            parts += [ids[start : ends[k] - sizes[k]], other]
            start = ends[k]
            text = text.copy() if text is spelled else text
            text[k] = other_text
        out.append((total - lost, np.concatenate([*parts, ids[start:]]) if parts else ids, known.model.shown(b"".join(text))))
    return out


def encode_n_best(docs: DataFrame, path: str, n: int = 4) -> DataFrame:
    """Up to ``n`` rows per row of ``docs``: doc_id, rank (from 0), score, ids, decoded (the text of the ids).

    ``path`` is a SentencePiece model; scores add up over pieces. Equal scores come in an order that the text decides. Null
    counts as the empty text, whose one segmentation has no ids. A text with fewer segmentations gives fewer rows. Decoding
    gives back the text, except that the mark character itself reads as a space. Equal rows get equal results; an empty
    table gives an empty result; extra columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _known(path)
        for batch in batches:
            rows, ranks, scores, ids, texts = [], [], [], [], []
            for k, found in enumerate(encode_documents(known, batch.column("text").to_pylist(), n)):
                for rank, (score, these, text) in enumerate(found):
                    rows.append(k)
                    ranks.append(rank)
                    scores.append(score)
                    ids.append(these)
                    texts.append(text)
            flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32))
            bounds = pa.array(np.append(0, np.cumsum([len(i) for i in ids])).astype(np.int32))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(ranks, pa.int32()), pa.array(scores, pa.float64()),
                pa.ListArray.from_arrays(bounds, flat), pa.array(texts, pa.string()),
            ], ["doc_id", "rank", "score", "ids", "decoded"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return map_text(source, run, "doc_id long, rank int, score double, ids array<int>, decoded string")


@lru_cache(2)
def _known(path: str) -> Segments:
    return Segments(pieces(path))


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``encoded`` with `text`, the text of its ids; null ids give null."""
    fields = [c for c in encoded.columns if c.lower() != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            texts = [None if i is None else model.decode(i) for i in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in fields), pa.array(texts, pa.string())], [*fields, "text"])

    source = encoded.select(*[F.col(f"`{c}`") for c in fields])
    return source.mapInArrow(run, source.withColumn("text", F.lit("")).schema)


def n_best_report(docs: DataFrame, path: str, n: int = 4) -> DataFrame:
    """The digest of ``encode_n_best``, from the same pass: doc_id, rank, score, n_pieces, ids_crc32 (little-endian 32-bit
    ids), decoded_crc32 (UTF-8)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _known(path)
        for batch in batches:
            rows = [
                (k, rank, score, len(ids), zlib.crc32(ids.astype("<i4").tobytes()), zlib.crc32(text.encode()))
                for k, found in enumerate(encode_documents(known, batch.column("text").to_pylist(), n))
                for rank, (score, ids, text) in enumerate(found)
            ]
            at, rank, score, size, ids_crc, text_crc = zip(*rows)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").take(pa.array(at)), pa.array(rank, pa.int32()), pa.array(score, pa.float64()), pa.array(size, pa.int64()),
                pa.array(ids_crc, pa.int64()), pa.array(text_crc, pa.int64()),
            ], ["doc_id", "rank", "score", "n_pieces", "ids_crc32", "decoded_crc32"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return map_text(source, run, "doc_id long, rank int, score double, n_pieces long, ids_crc32 long, decoded_crc32 long")
