"""The similarity links of the pipeline's near stage: what goes before whole sets are exchanged, and that nothing else goes."""

import random

import numpy as np
from pyspark.sql import functions as F

from talentlake.llm import jaccard


def sets_of(texts):
    return [frozenset(jaccard.shingles(t.encode()).tolist()) for t in texts]


def kept_ids(texts):
    """The ids that stay, by brute force."""
    sets, root = sets_of(texts), list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted({find(x) for x in range(len(texts))})


def by_chance(rng, groups, each, n=120):
    """Texts of words of their own; those of a group have a passage of 14 words in common, far too little for a link."""
    texts = []
    for g in range(groups):
        passage = [f"p{g}x{k}" for k in range(14)]
        for _ in range(each):
            words = [f"w{rng.randrange(10**9)}" for _ in range(rng.randint(n - 10, n + 10))]
            at = rng.randrange(len(words))
            texts.append(" ".join(words[:at] + passage + words[at:]))
    return texts


def test_classes_bound_what_sets_share():
    rng = np.random.default_rng(3)
    for na, nb, both in [(1, 1, 0), (1, 1, 1), (5, 9, 4), (255, 257, 200), (256, 256, 256), (300, 300, 0), (900, 1100, 880), (10, 5000, 10), (4096, 4097, 100)]:
        pool = np.unique(rng.integers(-(1 << 63), 1 << 63, na + nb + 100, dtype=np.int64))
        pool = rng.permutation(pool)
        a, b = np.sort(pool[:na]), np.sort(np.concatenate([pool[:both], pool[na : na + nb - both]]))
        most = jaccard.most_common(jaccard.classes(a), jaccard.classes(b), na, nb)
        assert both <= most <= min(na, nb)
        assert most == jaccard.most_common(jaccard.classes(b), jaccard.classes(a), nb, na)
        if both == 0 and na > 1:
            assert 9 * most < 4 * (na + nb)  # too few for a similarity of 0.8


def test_pairs_by_chance_go_before_sets_are_exchanged(spark, monkeypatch):
    """Their number grows with the square of a corpus, and each took two whole sets with it."""
    met, judged = [], jaccard._judged
    monkeypatch.setattr(jaccard, "_judged", lambda pairs, *more: met.append(pairs.count()) or judged(pairs, *more))
    rng = random.Random(4)
    texts = by_chance(rng, 100, 2)
    texts += [" ".join(t.split()[:-3]) for t in texts[:5]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    kept = sorted(r.doc_id for r in jaccard.drop_similar(docs).collect())
    assert kept == kept_ids(texts) == list(range(200))
    assert met[0] <= 5


def test_crowds_by_chance_equal_brute_force(spark, monkeypatch):
    """Crowded shards whose members are near copies, strangers, or both, with distances from the vantage point known, bounded or open."""
    monkeypatch.setattr(jaccard, "CROWD", 3)
    monkeypatch.setattr(jaccard, "OFTEN", 1 << 40)
    rng = random.Random(6)
    texts = by_chance(rng, 12, 6, 40)
    for t in texts[::5]:
        for changed in (1, 2, 3, 4):
            words = t.split()
            for at in rng.sample(range(len(words)), changed):
                words[at] = "changed"
            texts += [" ".join(words), " ".join(t.split()[: len(words) - 2 * changed])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = kept_ids(texts)
    assert sorted(r.doc_id for r in jaccard.drop_similar(docs).collect()) == want
    assert len(want) < len(texts) - 50


def test_sets_of_asked_texts_only(spark):
    texts = [f"text {i} of some words that are its own {i * i}" for i in range(200)]
    rows = jaccard._numbered(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    named = rows.select(F.col("doc_id").alias("key"), F.struct(F.lit(False).alias("no_id"), "doc_id", "rev").alias("least"))
    found = jaccard._sets_of(named.where("key in (3, 150)").select("key"), named, rows, 5)
    assert {r.key: frozenset(np.frombuffer(r.shingles, np.int64).tolist()) for r in found.collect()} == {k: sets_of([texts[k]])[0] for k in (3, 150)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan and "bucket" in plan
