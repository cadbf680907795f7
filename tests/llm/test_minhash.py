"""MinHash near-dedup against all pairs of full sets."""

import itertools
import random
import re

import numpy as np
import pytest

from talentlake.llm import minhash
from talentlake.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, node long, n int, key long, root long, least string"


def full_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute(rows):
    sets = [full_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    pairs = {p for ids in holders.values() for p in itertools.combinations(ids, 2)}
    for i, j in pairs:
        if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
            up[root(j)] = root(i)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        r = root(i)
        least[r] = min(least.get(r, (True, 0)), (doc_id is None, doc_id or 0))
    out = []
    for i, (doc_id, _) in enumerate(rows):
        no_id, component = least[root(i)]
        component = None if no_id else component
        out.append((doc_id, len(sets[i]), component, doc_id == component))
    return sorted(map(str, out))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 0, 0, 0, 0, "x") for i, t in rows], SCHEMA).repartition(6)


def answers(df):
    return sorted(str(tuple(r)) for r in df.collect())


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.random():.6f}"
    return words


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(500)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.randint(5, 400))] for _ in range(60)]
    texts = [" ".join(b) for b in bases]
    for b in bases:  # copies at all distances around the threshold
        texts += [" ".join(edited(rng, b, k)) for k in range(0, 9)]
    hot = [rng.choice(vocabulary) for _ in range(100)]
    texts += [" ".join(edited(rng, hot, rng.randint(0, 3))) for _ in range(150)]  # a dense group
    texts += [" ".join(hot[:60] + [rng.choice(vocabulary) for _ in range(60)]) for _ in range(60)]  # a common passage
    chain = [rng.choice(vocabulary) for _ in range(120)]
    for _ in range(12):  # each like the one before only
        chain = edited(rng, chain, 1)
        texts.append(" ".join(chain))
    texts += [None, "", "  \n", "A b", "a B", "a b c d", "a b c d e", "É x y z w v", "é x y z w v", "same " * 300, "SAME " * 301, "x" * 20_000]
    rows = list(enumerate(texts))
    return rows + [rows[3], rows[3], (None, texts[4]), (None, "null ids alone here in this one"), (7, "another text under a taken id of some words")]


def test_against_all_pairs(spark, rows):
    assert answers(minhash.near_duplicates(frame(spark, rows))) == brute(rows)


def test_small_and_empty_tables(spark):
    assert minhash.near_duplicates(frame(spark, [])).count() == 0
    for rows in ([(1, None), (2, "")], [(5, "one two")], [(5, "one two"), (4, "One TWO"), (3, "one three")]):
        assert answers(minhash.near_duplicates(frame(spark, rows))) == brute(rows)


def test_every_pair_within_the_distance_shares_a_key(spark):
    """Pigeonhole: any two signatures that differ in 15 places meet under some key, whichever places these are."""
    rng = np.random.default_rng(4)
    out = []
    for i in range(300):
        a = rng.integers(0, 1 << 16, 32, np.uint64)
        b = a.copy()
        wrong = rng.choice(32, minhash.DISTANCE, replace=False)
        b[wrong] ^= np.uint64(1 + i % 7)
        for j, s in enumerate((a, b)):
            chunks = [int(np.array([sum(int(s[4 * k + p]) << 16 * p for p in range(4))], np.uint64).view(np.int64)[0]) for k in range(8)]
            out.append((i, j, *chunks))
    df = spark.createDataFrame(out, "pair long, side int, " + ", ".join(f"s{k} long" for k in range(8)))
    keyed = df.select("pair", "side", *[f"s{k}" for k in range(8)], minhash._keys().alias("keys"))
    a, b = keyed.where("side = 0"), keyed.where("side = 1")
    named = lambda d, p: d.select("pair", *[d[c].alias(p + c) for c in ("keys", *(f"s{k}" for k in range(8)))])
    both = named(a, "a_").join(named(b, "b_"), "pair").selectExpr("*", "arrays_overlap(a_keys, b_keys) as met").withColumn("d", minhash._distance("a_", "b_"))
    assert both.where("met and d = 15").count() == 300


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(6)
    far = []
    for _ in range(400):
        common = rng.integers(0, 1 << 63, 170, np.uint64)
        a, b = (np.unique(np.concatenate([common, rng.integers(0, 1 << 63, 15, np.uint64)])) for _ in range(2))
        sa, sb = minhash.signatures([a, b]).view(np.uint16).reshape(2, -1)
        far.append(int((sa != sb).sum()))
    assert abs(np.mean(far) - 32 * 0.15) < 0.4 and max(far) <= minhash.DISTANCE


def test_dense_group_is_not_compared_pair_by_pair(spark, monkeypatch):
    """Pairs that are compared grow with the group, not with its square; those in no group are compared with all of it."""
    rng = random.Random(2)
    base = [f"w{i}" for i in range(120)]
    seen = []
    compared = minhash._compared
    monkeypatch.setattr(minhash, "_compared", lambda pairs, *a: (seen.append(pairs.count()), compared(pairs, *a))[1])
    counts = []
    for n in (300, 900):
        rows = [(i, " ".join(edited(rng, base, i % 2))) for i in range(n)]
        rows += [(n + i, " ".join(edited(rng, base, 5))) for i in range(3)]
        seen.clear()
        got = minhash.near_duplicates(frame(spark, rows))
        if n == 300:
            assert answers(got) == brute(rows)
        assert got.where("kept").count() <= 4
        counts.append(sum(seen))
    assert counts[1] < 5 * counts[0] and counts[1] < 900 * 30


def test_pairs_below_the_threshold_are_told_by_classes(spark, monkeypatch):
    """Texts that are all alike, none of them enough: classes of shingles rule out nearly all pairs before sets are compared."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    combinations = sorted({tuple(sorted(rng.sample(range(5, 120, 5), 4))) for _ in range(200)})
    rows = [(i, " ".join(f"e{k}" if k in places else w for k, w in enumerate(base))) for i, places in enumerate(combinations)]
    seen = []
    compared = minhash._compared
    monkeypatch.setattr(minhash, "_compared", lambda pairs, *a: (seen.append(pairs.count()), compared(pairs, *a))[1])
    assert answers(minhash.near_duplicates(frame(spark, rows))) == brute(rows)
    assert sum(seen) < len(rows) ** 2 // 40


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    out = QUERIES["op12_minhash_near_dedup"](spark, sf)
    assert out.dtypes == [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint"), ("kept", "boolean")]
    assert answers(out) == brute(rows)
