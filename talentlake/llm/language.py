"""Language identification of spans.

A word is a run of letters (and numerals that are no digits). The script of its first letter narrows the languages it may be in to those that used that
script in training. Its score in each of them is a naive-Bayes sum over hashed character n-grams, and Viterbi with a
penalty for each switch of language labels the words of a document, which makes spans. A document's language is the
one with the most letters.

Training sees at most about TRAIN_ROWS documents of each language (drawn by a hash of the id), so the model has a
bounded size: languages x BUCKETS counts, which is what is broadcast.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_text

BUCKETS = 1 << 16
TRAIN_ROWS = 10_000
SWITCH = 12.0
#: A word speaks at most this much against a language, so that one odd word does not make a span.
MOST_AGAINST = 8.0
NGRAMS = (1, 2, 3, 4)
KNOWN_WORDS = 200_000
WORD = re.compile(r"[^\W\d_]+")
#: First code points of blocks and their script; a block ends where the next begins.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0900, "indic"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, "other"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "other"),
    (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0xFF21, "latin"),
    (0xFF66, "kana"), (0xFFA0, "other"), (0x20000, "han"), (0x32000, "other"),
]
_FIRST = np.array([a for a, _ in SCRIPTS])
SCRIPT_NAMES = sorted({n for _, n in SCRIPTS})
_NUMBER = np.array([SCRIPT_NAMES.index(n) for _, n in SCRIPTS])


@dataclass
class Model:
    """langs, log probabilities [BUCKETS, langs], and which language uses which script [scripts, langs]."""

    langs: list[str]
    logs: np.ndarray
    allowed: np.ndarray


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets of all n-grams, word of each, script of each word); words get a mark at either end."""
    points = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    owner = np.repeat(np.arange(len(words)), sizes)
    scripts = _NUMBER[np.searchsorted(_FIRST, points[np.cumsum(sizes) - sizes + 1], "right") - 1]
    found, of = [], []
    value = np.zeros(len(points), np.uint64)
    for n in range(1, max(NGRAMS) + 1):
        value = value[: len(points) - n + 1] * np.uint64(0x100000001B3) + points[n - 1 :]
        same = owner[n - 1 :] == owner[: len(points) - n + 1]
        if n in NGRAMS:
            mixed = (value[same] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            found.append((mixed >> np.uint64(48)).astype(np.int64) & (BUCKETS - 1))
            of.append(owner[: len(points) - n + 1][same])
    return np.concatenate(found), np.concatenate(of), scripts


def word_scores(words: list[str], model: Model) -> np.ndarray:
    """Scores [words, langs]: 0 for the best language, down to -MOST_AGAINST for the others."""
    buckets, owner, scripts = _grams(words)
    order = np.argsort(owner, kind="stable")
    starts = np.searchsorted(owner[order], np.arange(len(words)))
    total = np.add.reduceat(model.logs[buckets[order]], starts, axis=0)
    open_ = model.allowed[scripts]
    open_ = open_ | ~open_.any(axis=1, keepdims=True)  # a script never seen narrows nothing
    total = np.where(open_, total, -np.inf)
    return np.maximum(total - total.max(axis=1, keepdims=True), -MOST_AGAINST).astype(np.float32)


def viterbi(scores: np.ndarray, bounds: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best language of every word; document i has the words bounds[i]:bounds[i + 1]. Documents run side by side."""
    size = np.diff(bounds)
    order = np.argsort(-size, kind="stable")
    begin, size = bounds[:-1][order], size[order]
    stay = np.ones(scores.shape, bool)
    leader = np.zeros(len(scores), np.int32)
    value = np.zeros((len(size), scores.shape[1]), np.float32)
    longest = int(size[0]) if len(size) else 0
    live = np.searchsorted(-size, -np.arange(1, longest + 1), "right")
    for t in range(longest):
        k, at = live[t], begin[: live[t]] + t
        v = value[:k]
        if t:
            lead = v.argmax(axis=1)
            moved = v[np.arange(k), lead][:, None] - np.float32(switch)
            leader[at], stay[at] = lead, v >= moved
            v = np.maximum(v, moved)
        value[:k] = v + scores[at]
    labels = np.zeros(len(scores), np.int32)
    now = value.argmax(axis=1)
    for t in range(longest - 1, -1, -1):
        k, at = live[t], begin[: live[t]] + t
        labels[at] = now[:k]
        now[:k] = np.where(stay[at, now[:k]], now[:k], leader[at])
    return labels


class Words(dict):
    """Word -> row of a growing matrix of scores."""

    def __init__(self, model: Model):
        self.model, self.scores = model, np.zeros((0, len(model.langs)), np.float32)

    def scores_of(self, words: list[str]) -> np.ndarray:
        new = list(set(words).difference(self))
        if new:
            if len(self) > KNOWN_WORDS:
                self.clear()
                self.scores, new = self.scores[:0], list(set(words))
            self.update(zip(new, range(len(self.scores), len(self.scores) + len(new))))
            self.scores = np.concatenate([self.scores, word_scores(new, self.model)])
        return self.scores[np.fromiter(map(self.__getitem__, words), np.int64, len(words))]


def _learnable() -> Column:
    return F.col("text").isNotNull() & F.col("lang").isNotNull()


def train(docs: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """A model of the non-null lang of ``docs`` (doc_id, text, lang); about ``rows`` documents of each at most."""
    known = docs.where(_learnable()).select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per language
    langs = sorted(counts)
    if not langs:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((len(SCRIPT_NAMES), 0), bool))
    share = F.create_map(*[x for lang in langs for x in (F.lit(lang), F.lit(min(1.0, rows / counts[lang])))])
    drawn = known.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((len(langs), BUCKETS + len(SCRIPT_NAMES)), np.int64)
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                words = WORD.findall(text.lower())
                if words:
                    buckets, _, scripts = _grams(words)
                    table[langs.index(lang)] += np.bincount(np.append(buckets, BUCKETS + scripts), minlength=table.shape[1])
        at, bucket = np.nonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(table[at, bucket])], ["at", "bucket", "n"])

    sums = map_text(drawn, run, "at int, bucket int, n long").groupBy("at", "bucket").agg(F.sum("n").alias("n")).toArrow()  # languages x BUCKETS at most
    table = np.zeros((len(langs), BUCKETS + len(SCRIPT_NAMES)))
    table[sums.column("at").to_numpy(), sums.column("bucket").to_numpy()] = sums.column("n").to_numpy()
    grams, scripts = table[:, :BUCKETS] + 0.1, table[:, BUCKETS:]
    allowed = scripts >= np.maximum(1, 0.001 * scripts.sum(axis=1, keepdims=True))
    return Model(langs, np.ascontiguousarray(np.log(grams / grams.sum(axis=1, keepdims=True)).T.astype(np.float32)), allowed.T)


def label_spans(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, spans for every row of ``docs``; a span is (lang, first word, words).

    ``score`` is the share of letters in words of lang_pred. A text that is null or has no letter, and every text if the
    model knows no language, is `und` with score 0 and no spans."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int32()), ("words", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        names = np.array([*m.langs, "und"], object)
        known = Words(m)
        for batch in batches:
            per = [WORD.findall(t.lower()) if t and m.langs and any(map(str.isalpha, t)) else [] for t in batch.column("text").to_pylist()]
            bounds = np.append(0, np.cumsum([len(w) for w in per])).astype(np.int64)
            words = [w for ws in per for w in ws]
            n = len(per)
            if words:
                labels = viterbi(known.scores_of(words), bounds)
            else:
                labels = np.zeros(0, np.int32)
            letters = np.zeros((n, len(m.langs) + 1))
            doc = np.repeat(np.arange(n), np.diff(bounds))
            np.add.at(letters, (doc, labels), np.fromiter(map(len, words), np.float64, len(words)))
            sums, best = letters.sum(axis=1), letters.argmax(axis=1)
            best[sums == 0] = len(m.langs)
            score = np.where(sums > 0, letters[np.arange(n), best] / np.maximum(sums, 1), 0.0)
            opens = np.ones(len(words), bool)
            opens[1:] = (labels[1:] != labels[:-1]) | (doc[1:] != doc[:-1])
            at = np.flatnonzero(opens)
            values = pa.StructArray.from_arrays([
                pa.array(names[labels[at]], pa.string()), pa.array((at - bounds[doc[at]]).astype(np.int32)), pa.array(np.diff(np.append(at, len(words))).astype(np.int32)),
            ], ["lang", "first", "words"])
            edges = np.append(0, np.cumsum(np.bincount(doc[at], minlength=n))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(names[best], pa.string()), pa.array(score), pa.ListArray.from_arrays(pa.array(edges), values).cast(span),
            ], ["doc_id", "lang_pred", "score", "spans"])

    return map_text(docs.select("doc_id", "text"), run, "doc_id long, lang_pred string, score double, spans array<struct<lang:string,first:int,words:int>>")


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text leaves 2 when divided by 4."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def language_report(docs: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score; learned from documents that are not held out.

    A null doc_id counts as not held out. Null lang is not learned from, null text is `und`. Equal texts get equal
    predictions; an empty table gives an empty result; extra columns are ignored."""
    model = train(docs.where(~held_out(F.col("doc_id"))), rows)
    return label_spans(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
