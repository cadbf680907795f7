"""Importance resampling against a plain count in memory."""

import collections
import hashlib
import math
import re
import zlib

import pytest

from talentlake.llm import resampling
from talentlake.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, part int, block long, target boolean, weight string"


def features(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def brute(docs, target, percent=5, buckets=10_000):
    bags = [collections.Counter(zlib.crc32(f.encode()) % buckets for f in features(t)[1]) for _, t in docs]
    s, t = collections.Counter(), collections.Counter()
    for b in bags:
        s.update(b)
    for x in target:
        t.update(zlib.crc32(f.encode()) % buckets for f in features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000.0 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    rows = []
    for (doc_id, text), bag in zip(docs, bags):
        weight = sum(gain(b) * n for b, n in bag.items())
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000.0 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, sum(bag.values()), weight, score, None, len(features(text)[0])])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = k
    return sorted((str(r[:5]) for r in rows))


def docs_of(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    odd = [None, "", " .,;- ", "É é ÀB ß 漢字 ١٢", "a", "B b", "hot " * 5000, "x" * 50_000, "a\x00b\x7fc`d{e", "Words " * 19, "Words " * 20]
    return rows + [(10_000 + i, t) for i, t in enumerate(odd)] + [rows[3], rows[3], (None, "no id " * 30)]


@pytest.fixture(scope="module")
def target(spark):
    return [r.text for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()] + [None, "", "hot words"]


def frames(spark, docs, target):
    rows = [(i, t, 0, 0, True, "w") for i, t in docs]
    return spark.createDataFrame(rows, SCHEMA).repartition(5), spark.createDataFrame([(0, t) for t in target], "item_id int, text string")


def test_against_a_plain_count(spark, target):
    docs = docs_of(spark)
    got = resampling.resample(*frames(spark, docs, target)).collect()
    assert sorted(str(list(r)) for r in got) == brute(docs, target)


def test_the_postings_are_exchanged_once(spark, target):
    df = resampling.importance_weights(*frames(spark, docs_of(spark), target))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan


def test_empty_tables(spark, target):
    docs = docs_of(spark)
    none, some = frames(spark, [], target)
    assert resampling.resample(none, some).count() == 0
    got = resampling.resample(*frames(spark, docs, [])).collect()
    assert sorted(str(list(r)) for r in got) == brute(docs, [])


def test_all_draws_and_none(spark, target):
    docs = docs_of(spark)
    for percent in (0, 100):
        got = resampling.resample(*frames(spark, docs, target), percent=percent).collect()
        assert sorted(str(list(r)) for r in got) == brute(docs, target, percent)


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    text = " ".join(f"w{i % 37}" for i in range(1000)).encode()
    whole = sorted(resampling.feature_buckets(text)[1])
    monkeypatch.setattr(resampling, "PIECE", 10)
    assert sorted(resampling.feature_buckets(text)[1]) == whole


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    out = QUERIES["op11_importance_resampling"](spark, sf)
    assert out.dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    assert sorted(str(list(r)) for r in out.collect()) == brute(docs, target)
