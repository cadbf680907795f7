"""Token counts by a compiled finite-state tokenizer.

Within one pre-token, byte-pair encoding is a finite-state function of its bytes: the encoding of a prefix is settled
by its last token, which is the one vocabulary suffix whose predecessor's last token stands beside it unmerged. A state
keeps, for every vocabulary prefix that the bytes read may still continue, the last token before it and how many tokens
that was behind the present count. Reading a byte emits the change of the token count, so that the emissions of a
pre-token add up to its tokens. States are determinized when first needed and kept in a transition table that all later
blocks of the worker use; a table that has grown too large is begun anew with the states that are still in use, also in
the middle of a text.

A block of texts is one stream of bytes in which marks say where pre-tokens begin. It is cut into chunks, which run side
by side (NumPy lanes). The state map of a chunk with a mark is constant, as it passes the start there; that of a chunk inside
a long pre-token is not. A scan composes the maps: first all are evaluated at the start state, then in rounds each at what
the chunk before it hands on, all chunks at once, and again only where that has changed. A tokenizer forgets where it began
after a few tokens, so the exits of the first evaluation are mostly right already and two or three rounds settle any number of
chunks; the last round, in which nothing changes, proves the result whatever the text.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_text

CHUNK = 256
MOST_STATES = 150_000
#: Fixed values of the byte-level pre-tokenizer: contractions that are pre-tokens, and what Unicode calls white space.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
LETTER, NUMBER, OTHER, SPACE = 1, 2, 3, 4
#: The letters and numbers that Unicode 16 added, which the tokenizers library knows and Python's tables may not.
UNICODE_16 = {
    LETTER: [
        (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85),
        (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7),
        (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C),
        (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
    ],
    NUMBER: [
        (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9),
        (0x1E5F1, 0x1E5FA),
    ],
}
NEVER = 1 << 60


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of every code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    for kind, ranges in UNICODE_16.items():
        for a, b in ranges:
            table[a : b + 1] = kind
    table[WHITE] = SPACE
    return table


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merges and special strings of a tokenizers file with a byte-level BPE model."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_alphabet()
        self.ids = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items()}
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        size = max(self.ids.values()) + 1
        self.left, self.right, self.birth = [-1] * size, [-1] * size, [-1] * size
        self.rank: dict[tuple[int, int], int] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = (bytes(letters[c] for c in t) for t in (pair.split(" ") if isinstance(pair, str) else pair))
            x, y, t = self.ids[a], self.ids[b], self.ids[a + b]
            self.rank.setdefault((x, y), r)
            if self.birth[t] < 0:
                self.left[t], self.right[t], self.birth[t] = x, y, r
        # The trie of tokens that their own bytes really encode to.
        self.child: dict[int, int] = {}
        self.token, self.inner = [-1], [False]
        for word, t in sorted(self.ids.items()):
            if self._forms(t):
                node = 0
                for b in word:
                    self.inner[node] = True
                    node = self.child.setdefault(node << 8 | b, len(self.token))
                    if node == len(self.token):
                        self.token.append(-1)
                        self.inner.append(False)
                self.token[node] = t

    def _meets(self, i: int, j: int, i_until: int, j_until: int) -> bool:
        """Whether a merge joins what stands on the two sides of a border, followed back in time: ``i`` and ``j`` touch
        it until they are taken into larger tokens at i_until and j_until. Equal merges run from the left."""
        rank, birth = self.rank, self.birth
        while True:
            r = rank.get((i, j))
            if r is not None and r < i_until and r <= j_until:
                return True
            if birth[i] > birth[j]:
                i_until, i = birth[i], self.right[i]
            elif birth[j] >= 0:
                j_until, j = birth[j], self.left[j]
            else:
                return False

    def apart(self, a: int, b: int) -> bool:
        """Whether the tokens ``a`` and ``b`` stay two when they stand side by side."""
        return not self._meets(a, b, NEVER, NEVER)

    def _forms(self, t: int) -> bool:
        """Whether the bytes of ``t`` encode to it."""
        if self.birth[t] < 0:
            return len(self._bytes_of(t)) == 1
        return self._forms(self.left[t]) and self._forms(self.right[t]) and not self._meets(self.left[t], self.right[t], self.birth[t], self.birth[t] - 1)

    @lru_cache(1)  # noqa: B019
    def _words(self) -> dict[int, bytes]:
        return {i: w for w, i in self.ids.items()}

    def _bytes_of(self, t: int) -> bytes:
        return self._words()[t]


class Transducer:
    """The lazily determinized machine: transitions (state, byte) -> (state, change of the count)."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.reset()

    def reset(self) -> None:
        start = ((0, -1, 0),)
        self.states, self.number = [start], {start: 0}
        self.most, self.held = MOST_STATES, []
        self.beside: dict[tuple[int, int], bool] = {}
        self.bits, self.used = 20, 0
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.to = np.zeros(1 << self.bits, np.int32)
        self.emit = np.zeros(1 << self.bits, np.int16)

    def _step(self, state: int, byte: int) -> tuple[int, int]:
        v = self.vocabulary
        alive, last, change = [], -1, 0
        for node, before, behind in self.states[state]:
            child = v.child.get(node << 8 | byte)
            if child is None:
                continue
            t = v.token[child]
            if t >= 0 and last < 0:
                pair = (before, t)
                free = before < 0 or self.beside.get(pair)
                if free is None:
                    free = self.beside[pair] = v.apart(before, t)
                if free:
                    last, change = t, behind + 1
            if v.inner[child]:
                alive.append((child, before, behind))
        if last < 0:
            raise ValueError("the vocabulary has no token for a byte")
        state_ = (*((n, b, k - change) for n, b, k in alive), (0, last, 0))
        number = self.number.setdefault(state_, len(self.states))
        if number == len(self.states):
            self.states.append(state_)
        return number, change

    def compact(self, *held: np.ndarray) -> None:
        """Begin the table anew with the states in ``held`` (numbers, none below 0), which are renumbered in place."""
        used = np.unique(np.concatenate([[0], *(h[h >= 0] for h in held)]))
        kept, arrays = [self.states[k] for k in used.tolist()], self.held
        self.reset()
        self.states, self.number, self.held = kept, {s: i for i, s in enumerate(kept)}, arrays
        self.most = max(MOST_STATES, 2 * len(kept))
        for h in held:
            h[h >= 0] = np.searchsorted(used, h[h >= 0])

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.int64(-7046029254386353131)) >> np.int64(64 - self.bits)) & np.int64((1 << self.bits) - 1)

    def _insert(self, keys: np.ndarray, to: np.ndarray, emit: np.ndarray) -> None:
        mask = (1 << self.bits) - 1
        for k, s, t, e in zip(keys.tolist(), self._slots(keys).tolist(), to.tolist(), emit.tolist()):
            while self.keys[s] >= 0:
                s = (s + 1) & mask
            self.keys[s], self.to[s], self.emit[s] = k, t, e
        self.used += len(keys)

    def _learn(self, keys: np.ndarray) -> None:
        new = np.unique(keys)
        if (self.used + len(new)) * 2 > len(self.keys):
            old = self.keys >= 0
            was = self.keys[old], self.to[old], self.emit[old]
            while (self.used + len(new)) * 2 > 1 << self.bits:
                self.bits += 1
            self.used = 0
            self.keys = np.full(1 << self.bits, -1, np.int64)
            self.to, self.emit = np.zeros(1 << self.bits, np.int32), np.zeros(1 << self.bits, np.int16)
            self._insert(*was)
        found = [self._step(k >> 8, k & 255) for k in new.tolist()]
        self._insert(new, np.array([t for t, _ in found], np.int32), np.array([e for _, e in found], np.int16))

    def advance(self, states: np.ndarray, read: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states and the emissions of all lanes."""
        keys = states.astype(np.int64) << 8 | read
        while True:
            slots = self._slots(keys)
            held = self.keys[slots]
            seek = np.flatnonzero(held != keys)
            missing = []
            while len(seek):
                missing.append(seek[held[seek] < 0])
                seek = seek[held[seek] >= 0]
                slots[seek] = (slots[seek] + 1) & ((1 << self.bits) - 1)
                held[seek] = self.keys[slots[seek]]
                seek = seek[held[seek] != keys[seek]]
            miss = np.concatenate(missing) if missing else []
            if not len(miss):
                return self.to[slots], self.emit[slots]
            self._learn(keys[miss])

    def run(self, stream: np.ndarray, marks: np.ndarray, begin: np.ndarray, length: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(exit states, counts) of lanes that read ``length`` bytes from ``begin`` on; a mark goes to the start first."""
        order = np.argsort(-length, kind="stable")
        begin, length, now = begin[order], length[order], states[order].astype(np.int32)
        counts = np.zeros(len(begin), np.int64)
        live = np.searchsorted(-length, -np.arange(1, int(length[0]) + 1), "right") if len(length) else []
        for t, k in enumerate(live):
            at = begin[:k] + t
            to, emit = self.advance(np.where(marks[at], 0, now[:k]), stream[at])
            now[:k] = to
            counts[:k] += emit
            if len(self.states) > self.most:
                self.compact(now, *self.held)
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return now[back], counts[back]

    def _at(self, stream: np.ndarray, marks: np.ndarray, begin: np.ndarray, end: np.ndarray, chunks: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``run`` of what lies between ``begin`` and ``end`` of some chunks."""
        return self.run(stream, marks, begin[chunks], end[chunks] - begin[chunks], states)

    def count(self, stream: np.ndarray, marks: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Tokens of every text; text i is stream[bounds[i]:bounds[i + 1]]."""
        size = np.diff(bounds)
        chunks = -(-size // CHUNK)
        owner = np.repeat(np.arange(len(size)), chunks)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
        begin = bounds[owner] + nth * CHUNK
        end = np.minimum(begin + CHUNK, bounds[owner + 1])
        marked = np.append(np.flatnonzero(marks), len(stream))
        first = np.minimum(marked[np.searchsorted(marked, begin)], end)
        body = np.flatnonzero(first < end)
        # Exits, and the entries that the heads (what stands before the first mark) have been evaluated at.
        exits, entries = np.full(len(owner), -1, np.int32), np.full(len(owner), -1, np.int32)
        self.held = [exits, entries]
        counts, in_head = np.zeros(len(owner), np.int64), np.zeros(len(owner), np.int64)
        exits[body], counts[body] = self._at(stream, marks, first, end, body, np.zeros(len(body), np.int32))
        heads = np.flatnonzero(first > begin)
        whole = heads[first[heads] == end[heads]]
        exits[whole], _ = self._at(stream, marks, begin, end, whole, np.zeros(len(whole), np.int32))
        while len(now := heads[entries[heads] != exits[heads - 1]]):
            entries[now] = exits[now - 1]
            out, in_head[now] = self._at(stream, marks, begin, first, now, entries[now])
            passes = first[now] == end[now]
            exits[now[passes]] = out[passes]
        self.held = []
        counts += in_head
        return np.bincount(owner, counts, len(size)).astype(np.int64)


def marked_stream(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, marks where pre-tokens begin, bounds of the texts) for texts encoded one by one."""
    joined = "".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    n = len(points)
    edges = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=edges[1:])
    begins, ends = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    begins[edges[:-1]] = True
    ends[edges[1:]] = True  # before this place a text ends
    kind = classes()[points]
    white = kind == SPACE
    before = np.append(np.uint8(0), kind[:-1])
    plain_space = np.append(False, points[:-1] == 0x20)
    starts = np.where(white, before != SPACE, (before != kind) & ~plain_space) | begins[:n]
    # The last of several white characters before a word stands for itself, or with the word if it is a space.
    last = white[:-1] & ~white[1:] & ~ends[1:n] if n > 1 else np.zeros(0, bool)
    starts[:-1] |= last
    for text in CONTRACTIONS:
        size = len(text)
        if n >= size:
            hit = starts[: n - size + 1] & (points[: n - size + 1] == 0x27)
            for k in range(1, size):
                hit &= (points[k : n - size + 1 + k] == ord(text[k])) & ~begins[k : n - size + 1 + k]
            at = np.flatnonzero(hit)
            starts[at + 1] = False
            starts[at[at + size < n] + size] = True
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    offset = np.zeros(n + 1, np.int64)
    np.cumsum(width, out=offset[1:])
    stream = np.frombuffer(joined.encode(), np.uint8)
    marks = np.zeros(len(stream), bool)
    marks[offset[:-1][starts]] = True
    return stream, marks, offset[edges]


@lru_cache(2)
def compiled(path: str) -> Transducer:
    return Transducer(Vocabulary(path))


def count_tokens(texts: list[str | None], path: str) -> np.ndarray:
    """Tokens of each text as the tokenizers library counts them by default: special strings are one token."""
    machine = compiled(path)
    counts = np.zeros(len(texts), np.int64)
    parts, owner = [], []
    for i, text in enumerate(texts):
        pieces = [text or ""]
        for special in machine.vocabulary.special:
            split = [p.split(special) for p in pieces]
            counts[i] += sum(len(s) - 1 for s in split)
            pieces = [p for s in split for p in s]
        parts += (kept := [p for p in pieces if p])
        owner += [i] * len(kept)
    if parts:
        np.add.at(counts, owner, machine.count(*marked_stream(parts)))
    return counts


def token_report(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes (UTF-8), n_tokens, over_limit.

    ``path`` is a tokenizers file with a byte-level BPE model. Null counts as the empty text, which has no tokens. Long
    texts are read whole. Equal rows get equal results; an empty table gives an empty result; extra columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = count_tokens(batch.column("text").to_pylist(), path)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts), pa.array(counts > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    text = F.coalesce(F.col("text"), F.lit(""))
    return map_text(docs.select("doc_id", text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes")), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
