"""Cases that once failed or did not end: null and repeated ids, ties, long texts, hostile pages, crowds of near copies."""

import collections
import random
import time

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from talentlake.llm import common, html_text, jaccard, packing, pieces, sharding, simhash, transducer

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_packing_keeps_large_ids_beside_null(spark):
    ids = [2**60 + k for k in range(20)] + [None]
    rows = [(i, f"text number {k} of some words") for k, i in enumerate(ids)]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), BYTE_BPE).collect()
    assert collections.Counter(r["doc_id"] for r in got) == collections.Counter(ids)
    assert all(r["certified"] for r in got)


def test_packing_deals_rows_with_one_id(spark):
    items = spark.createDataFrame([(None, 0, 0, 3, 7)] * 400, "doc_id long, piece int, start long, length long, ids_crc32 long")
    sizes = packing._pack(items, 1024, 1, 8).groupBy("grp").count().collect()
    assert len(sizes) == 8 and max(r["count"] for r in sizes) < 120


def test_packing_rounds_are_a_parameter(spark):
    rng = random.Random(4)
    items = [(k, 0, 0, rng.choice([341, 342, 400, 513]), k) for k in range(300)]
    items = common.cut(spark.createDataFrame(items, "doc_id long, piece int, start long, length long, ids_crc32 long").repartition(3), "test-items")
    bins = [packing.pack_pieces(items, 1024, group=20, rounds=n).select("sequence_id").distinct().count() for n in (1, 4)]
    assert bins[1] <= bins[0]


def test_sharding_spreads_repeated_ids(spark):
    rows = spark.createDataFrame([(None if k % 2 else 7, "same text") for k in range(2400)], "doc_id long, text string").repartition(4)
    got = sharding.shard_documents(rows, shards=24).groupBy("shard").count().collect()
    assert len(got) == 24 and max(r["count"] for r in got) - min(r["count"] for r in got) <= 2


def test_sharding_by_target_bytes(spark):
    rows = spark.createDataFrame([(k, "x" * 92) for k in range(200)], "doc_id long, text string")
    got = sharding.shard_documents(rows, target_bytes=2000).groupBy("shard").sum("size").collect()
    assert len(got) == 10 and all(r[1] == 2000 for r in got)


def test_no_machine_local_folder_on_a_cluster():
    class Conf:
        def get(self, name, default=None):
            return {"spark.master": "spark://host:7077"}.get(name, default)

    with pytest.raises(ValueError):
        common.shared_dir(type("Session", (), {"conf": Conf()})())


def test_space_runs_end():
    start = time.perf_counter()
    text = "a" + " " * 2000 + "b"
    found = next(iter(pieces.encode_documents(pieces.Segments(pieces.pieces(PIECE_MODEL)), [text], 4)))
    assert [t for _, _, t in found] == [text] * 4 and [s for s, _, _ in found] == sorted((s for s, _, _ in found), reverse=True)
    assert time.perf_counter() - start < 20


def test_long_segments_equal_whole_lattices(monkeypatch):
    model, rng = pieces.pieces(PIECE_MODEL), random.Random(1)
    texts = ["".join(rng.choice("abe nt一éthe ing ") for _ in range(rng.randint(1, 120))) for _ in range(40)]
    whole = list(pieces.encode_documents(pieces.Segments(model), texts, 4))
    monkeypatch.setattr(pieces, "LONG", 3)
    monkeypatch.setattr(pieces, "BLOCK", 5)
    blocks = list(pieces.encode_documents(pieces.Segments(model), texts, 4))
    for text, a, b in zip(texts, whole, blocks):
        assert np.allclose([s for s, _, _ in a], [s for s, _, _ in b]) and all(t == text for _, _, t in b)


@pytest.mark.parametrize("part", ["<p t='x ", '<a b="', "<div>", "<a ", "<table><tr><td>x", "<tr><td colspan=1000 rowspan=65534>x", "<ul><li>x", "x<b></b>"])
def test_hostile_pages_take_linear_time(part):
    def seconds(n):
        page = "<table>" + part * (n // len(part))
        start = time.perf_counter()
        html_text.extract(page)
        return time.perf_counter() - start

    seconds(1000)
    assert seconds(200_000) < 10


def test_spans_and_alignment():
    page = "<table><tr><td>a<td colspan=2>b<td>c<tr><td rowspan=2>dd<td>e<td>f<td>g<tr><td>h<td>i<td>j</table>"
    assert html_text.extract(page).split("\n") == ["a   b     c", "dd  e  f  g", "    h  i  j"]
    assert len(html_text.extract("<table>" + "<tr><td colspan=1000>x<td>y" * 2000)) < 40_000


def test_unclosed_quotes_stay_text():
    assert html_text.extract('one <b t="x two') == 'one <b t="x two'
    assert html_text.extract("<p title=don't>shown</p><p>it's more</p>") == "shown\n\nit's more"


def test_pages_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "<p>x", "old"), (2, None, "old")], "page_id long, html string, text string")
    assert {tuple(r) for r in html_text.page_text(df).collect()} == {(1, "x"), (2, "")}


def test_long_pretokens_with_a_small_table(monkeypatch):
    library, rng = Tokenizer.from_file(BYTE_BPE), random.Random(3)
    texts = ["a" * 20_000, "ab" * 9_000, "".join(rng.choice("abcdefghijklmnop") for _ in range(12_000)), " " * 5000 + "x", "é" * 3000]
    want = [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert transducer.count_tokens(texts, BYTE_BPE).tolist() == want
    monkeypatch.setattr(transducer, "MOST_STATES", 2000)
    transducer.compiled.cache_clear()
    assert transducer.count_tokens(texts, BYTE_BPE).tolist() == want
    assert len(transducer.compiled(BYTE_BPE).states) < 6000
    transducer.compiled.cache_clear()


def near_copies(rng, words, text, edits):
    out = text.split()
    for at in rng.sample(range(len(out)), edits):
        out[at] = rng.choice(words)
    return " ".join(out)


def test_similarity_mode_finds_planted_near_copies(spark, monkeypatch):
    """A crowd of near copies and pairs of them go but for one each; clean texts stay; all as brute force has it."""
    rng = random.Random(8)
    words = [f"w{k}" for k in range(900)]
    base = [" ".join(rng.choice(words) for _ in range(200)) for _ in range(25)]
    texts = base + [near_copies(rng, words, t, 3) for t in base[:15]] + [near_copies(rng, words, base[20], 2) for _ in range(60)] + [None, "", "a b"]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(jaccard, "CROWD", 8)
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(docs, shingle=5, similarity=(4, 5)).collect()}
    sets = [frozenset(jaccard.shingles((t or "").encode()).tolist()) for t in texts]
    root = list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(texts)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert kept == {k for k in range(len(texts)) if find(k) == k}
    assert set(range(25)) <= kept and not set(range(25, 40)) & kept


def test_similarity_comes_to_the_links_of_fingerprints(spark):
    """Texts whose fingerprints are close are one document, whatever their similarity; similar ones with distant fingerprints too."""
    rng = random.Random(5)
    words = [f"w{k}" for k in range(500)]
    base = [" ".join(rng.choice(words) for _ in range(120)) for _ in range(12)]
    texts = base + [near_copies(rng, words, t, 7) for t in base[:6] for _ in range(8)] + [near_copies(rng, words, t, 2) for t in base[6:9]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    bits = [simhash.fingerprint(t.encode(), 3) for t in texts]
    sets = [frozenset(jaccard.shingles(t.encode()).tolist()) for t in texts]
    kinds = {(a, b): ((bits[a] ^ bits[b]).bit_count() <= 8, 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])) for a in range(len(texts)) for b in range(a)}
    assert (True, False) in kinds.values() and (False, True) in kinds.values()
    root = list(range(len(texts)))
    for _ in texts:
        for (a, b), linked in kinds.items():
            if any(linked):
                root[a] = root[b] = min(root[a], root[b])
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(docs, reach=8, similarity=(4, 5), set_shingle=5).collect()}
    assert kept == {k for k in range(len(texts)) if root[k] == k}
