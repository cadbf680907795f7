"""The training-text operators against brute force, the libraries and the odd cases."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from talentlake.llm import components, exact_dedup, html_text, jaccard, language, packing, pieces, quality, recompression, sharding, simhash, transducer
from talentlake.llm.queries import BYTE_BPE, PIECE_MODEL

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id int, key string, fp string"


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def odd_rows():
    """Nulls, empty and long texts, ties, repeated rows, clashing columns."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(12, 120))) for _ in range(40)]
    texts = [None, "", "   \n\t", "É é", "a", "A", "a b", "one two three", "ÀB", "àB", "x " * 200, "the same word " * 30, "ab " * 3000, "y" * 5000]
    texts += base + [base[3], base[3].upper(), f"{base[4]} {passage}", f"{passage} {base[5]}", f"start {passage} mid {passage}", " ".join(words * 20)]
    texts += ["hot text with more than nine words in it for the rules"] * 40
    rows = [(i, t, [None, "en", "fr"][i % 3], None if i % 5 == 0 else "s", 1, i, "k", "f") for i, t in enumerate(texts)]
    return rows + [rows[20], rows[20], (None, "null id text of some ten words to be kept by the rules", "en", "s", 1, 0, "k", "f"), (21, "another text under a taken id", "en", "s", 1, 0, "k", "f")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="module")
def unique(odd):
    """The odd rows with one row for each doc_id."""
    return odd.where("doc_id is not null and not (doc_id = 21 and text = 'another text under a taken id')").distinct()


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


# Exact dedup


def exact_truth(rows):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[lower(r[1] or "")].append(r[0])
    return sorted((r[0] if r[0] is not None else -1, max((i for i in groups[lower(r[1] or "")] if i is not None), default=-1), len(groups[lower(r[1] or "")])) for r in rows)


@pytest.mark.parametrize("digest_chars", [64, 1])
def test_exact_classes(odd, digest_chars):
    """One digest character makes nearly every class collide; whole texts decide."""
    got = exact_dedup.duplicate_classes(odd, digest_chars).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.keep_id if r.keep_id is not None else -1, r.group_size) for r in got) == exact_truth(odd_rows())
    assert {r.text_sha256 for r in got} == {hashlib.sha256(lower(r[1] or "").encode()).hexdigest() for r in odd_rows()}


def test_exact_keeps_one_row_of_each(odd, empty):
    kept = exact_dedup.drop_duplicates(odd)
    assert kept.columns == odd.columns
    assert collections.Counter(lower(r.text or "") for r in kept.collect()) == {lower(r[1] or ""): 1 for r in odd_rows()}
    assert exact_dedup.duplicate_classes(empty).count() == exact_dedup.drop_duplicates(empty).count() == 0


# Quality rules


def quality_truth(text):
    words = WORD.findall(text or "")
    n, seen, dup = len(words), set(), 0
    grams = collections.Counter(tuple(words[k : k + 5]) for k in range(n - 4))
    covered = {k + j for k in range(n - 4) if grams[tuple(words[k : k + 5])] > 1 for j in range(5)}
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered), n < 10 or 100 * len(covered) > 20 * n


def test_quality_counts(odd, docs, empty):
    for df in (odd, docs):
        got = quality.quality_report(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
        want = sorted(str((r.doc_id, *quality_truth(r.text))) for r in df.collect())
        assert sorted(str(tuple(r)[:-1]) for r in got) == want
        assert not any(r.kept and r.base_failed for r in got)
    assert quality.quality_report(empty).count() == 0


def test_quality_fences_are_those_of_exact_quantiles(spark, monkeypatch):
    """In groups that a sketch holds whole, verdicts equal fences from sorted rates; small groups use their language, small languages all."""
    monkeypatch.setattr(quality, "LEAST_ROWS", 20)
    rng = random.Random(11)
    words = [f"word{i}" for i in range(400)]
    rows = []
    for lang, source, n in (("en", "a", 60), ("en", "b", 25), ("en", None, 4), (None, "a", 30), ("fr", "c", 7), ("fr", "a", 5)):
        for _ in range(n):
            text = [rng.choice(words) + rng.choice(["", "", "", "", "#", "%$"]) for _ in range(rng.randint(8, 40))]
            if rng.random() < 0.2:
                text = [w.upper() if rng.random() < 0.6 else w for w in text] + ["|||||"] * rng.randint(0, 9)
            if rng.random() < 0.1:
                text = [w * rng.randint(1, 4) for w in text]
            rows.append((len(rows), " ".join(text) + rng.choice(["", "\nline\nline\nline"]), lang, source))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    got = {r.doc_id: r for r in quality.quality_report(df).collect()}
    of_lang, of_both = collections.defaultdict(list), collections.defaultdict(list)
    for i, _, lang, source in rows:
        of_lang[lang].append(i)
        of_both[lang, source].append(i)
    seen = collections.Counter()
    for i, _, lang, source in rows:
        group = of_both[lang, source] if len(of_both[lang, source]) >= 20 else of_lang[lang] if len(of_lang[lang]) >= 20 else list(got)
        want = not got[i].base_failed
        for rate, slack in quality.RATES.items():
            values = sorted(got[g][rate] for g in group)
            low, high = (values[-(-len(values) * q // 100) - 1] for q in (25, 75))
            want = want and got[i][rate] <= high + quality.SPREAD * (high - low) + slack
        assert got[i].kept == want, i
        seen[want] += 1
    assert seen[True] > 50 and seen[False] > 5


def test_quality_keeps_rows_whole(odd):
    kept = quality.keep_good(odd)
    assert kept.columns == odd.columns
    assert kept.count() == quality.quality_report(odd).where("kept").count()


def test_quality_separates_labels(spark, docs):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    both = quality.quality_report(docs).join(labels, "doc_id").where("not base_failed").collect()
    assert all(r.kept == (r.quality == 1) for r in both)


# SimHash


def simhash_truth(rows, shingle=3, reach=3):
    fps = []
    for r in rows:
        words = WORD.findall(lower(r[1] or ""))
        grams = [" ".join(words[k : k + shingle]) for k in range(len(words) - shingle + 1)] or ([" ".join(words)] if words else [])
        import xxhash

        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= reach:
                root[find(a)] = find(b)
    least = collections.defaultdict(list)
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[find(k)].append(r[0])
    return sorted(str((r[0], f"{fps[k]:016x}", min(least[find(k)], default=None))) for k, r in enumerate(rows))


def test_simhash(odd, docs, empty):
    for df in (odd, docs):
        rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
        assert sorted(str(tuple(r)) for r in simhash.near_duplicates(df).collect()) == simhash_truth(rows)
    assert simhash.near_duplicates(empty).count() == simhash.drop_near_duplicates(empty).count() == 0


def test_simhash_keeps_one_of_each(odd):
    classes = simhash.near_duplicates(odd)
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} == {r.component_id for r in classes.collect()}


def test_vantage_links_are_exact(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    flips = np.array([np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, 3, replace=False).astype(np.uint64)) for _ in range(1500)])
    points = np.unique(np.concatenate([base, base[:1500] ^ flips, base[0] ^ (np.uint64(1) << np.arange(64, dtype=np.uint64))]))
    edges = simhash.near_links(spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "fp long"), shards=8)
    got = {r.node: r.root for r in components.components(edges).collect()}
    close = np.bitwise_count(points[:, None] ^ points[None]) <= 3
    label = np.arange(len(points))
    while True:
        new = np.array([label[row].min() for row in close])
        if (new == label).all():
            break
        label = new
    ours = np.array([got.get(int(p), int(p)) for p in points.view(np.int64)])
    assert len(set(zip(ours, label))) == len(set(ours)) == len(set(label))


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(500)] + [(1000, 1001), (7, 7)], "a long, b long")
    roots = collections.defaultdict(set)
    for r in components.components(edges).collect():
        roots[r.root].add(r.node)
    assert sorted(map(len, roots.values())) == [2, 501]


# Substring dedup


def passages_truth(rows):
    seen, out = {}, {}
    for i, t in sorted(rows):
        words, gone = WORD.findall(t or ""), set()
        for k in range(len(words) - 19):
            w = tuple(words[k : k + 20])
            if w in seen:
                gone |= set(range(k, k + 20))
            seen.setdefault(w, (i, k))
        out[i] = (len(words), len(gone), hashlib.sha256(" ".join(w for k, w in enumerate(words) if k not in gone).encode()).hexdigest())
    return out


def test_passages(spark, odd, unique, docs, empty):
    rng = random.Random(2)
    few = [(i, " ".join(rng.choice("a b c".split()) for _ in range(rng.randint(0, 90)))) for i in range(60)]
    few += [(100, "a " * 300), (101, "a b " * 100), (102, "b a " * 90), (103, None)]
    for df in (spark.createDataFrame(few, "doc_id long, text string"), unique, docs):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in recompression.passage_report(df).collect()}
        assert got == passages_truth([(r.doc_id, r.text) for r in df.collect()])
    assert recompression.passage_report(odd).count() == odd.count()
    assert recompression.passage_report(empty).count() == 0


@pytest.mark.parametrize(("bits", "rounds"), [(3, (2,)), (64, (2, 4))])
def test_passages_with_colliding_names_and_more_rounds(spark, bits, rounds):
    rng = random.Random(3)
    passage = [f"p{k}" for k in range(70)]
    rows = [(i, " ".join(f"w{rng.randrange(200)}" for _ in range(rng.randint(0, 60)))) for i in range(40)]
    rows += [(50 + i, f"{rows[i][1]} {' '.join(passage[i : 45 + i])} {rows[i + 1][1]}") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in recompression.passage_report(df, name_bits=bits, rounds=rounds).collect()}
    assert got == passages_truth(rows)
    assert sum(r[1] for r in got.values()) > 100


def test_anchors_depend_on_the_window_alone():
    rng = np.random.default_rng(5)
    for kinds in (2, 5, 1000):
        passage = rng.integers(0, kinds, 60).astype(np.uint64)
        found = []
        for before in (0, 3, 17):
            names = np.concatenate([rng.integers(0, kinds, before).astype(np.uint64), passage, rng.integers(0, kinds, 9).astype(np.uint64)])
            offsets = np.array([0, len(names)])
            for levels in (0, 2, 4):
                places, symbols = recompression.anchors(names, offsets, before + np.arange(41), levels)
                found.append((levels, tuple(places - before), tuple(symbols)))
        assert len(set(found)) == 3


def test_word_names_depend_on_the_word_alone(monkeypatch):
    monkeypatch.setattr(recompression, "STRETCH", 256)
    rng = random.Random(6)
    known = ["a", "b", "ab", "ba", "aa", "aab", "\xe9", "x" * 255, "x" * 256, "x" * 257, "y" * 700, "\x00", "\x00\x00"] + [f"w{i}" for i in range(300)]
    texts = [" \n".join(rng.choice(known) for _ in range(rng.randint(0, 50))).encode() for _ in range(200)] + [None, b"", b" \t", " ".join(known).encode()]
    words = recompression.split_words(texts)
    every = [w for t in texts for w in (t or b"").split()]
    assert np.diff(words.offsets).tolist() == [len((t or b"").split()) for t in texts]
    assert [words.line[a:b] for a, b in zip(words.begins, words.ends)] == every
    named = set(zip(every, words.names.tolist()))
    assert len(named) == len({w for w, _ in named}) == len({n for _, n in named}) == len(known)


def test_equal_windows_of_a_block_are_found_under_colliding_names():
    """Bytes are compared inside a block, so that a collision of names hides no equal window."""
    passage = " ".join(f"p{i}" for i in range(40))
    batch = pa.RecordBatch.from_pydict({"id": pa.array([1, 2, 2]), "rev": pa.array([0, 0, 0], pa.int32()), "text": [f"s {passage}", f"{passage} e", f"{passage} e"]})
    keys = next(recompression._round(4, None, 3)(iter([batch]))).column("keys")
    found = pa.Table.from_batches(recompression._windows(4, 3)(iter([batch.append_column("keys", keys)]))).to_pylist()
    assert {(r["id"], r["start"]) for r in found if r["later"]} == {(2, i) for i in range(21)}


def test_drop_passages(odd):
    out = recompression.drop_passages(odd)
    assert out.columns == odd.columns
    assert out.count() == odd.count()
    by_id = {r.doc_id: r.kept_sha256 for r in recompression.passage_report(odd.where("doc_id > 21")).collect()}
    for r in recompression.drop_passages(odd.where("doc_id > 21")).collect():
        assert hashlib.sha256(" ".join(WORD.findall(r.text or "")).encode()).hexdigest() == by_id[r.doc_id]


# Sharding


def test_shards(odd, docs, empty):
    for df, shards in ((docs, 24), (odd, 5)):
        rows = sharding.shard_documents(df, shards).collect()
        assert len(rows) == df.count()
        slots = collections.defaultdict(list)
        for r in rows:
            slots[r.shard].append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert all(0 <= k < shards for k in slots)
    sizes = collections.Counter()
    for r in sharding.shard_documents(docs, 4).collect():
        sizes[r.shard] += r.size
    assert max(sizes.values()) - min(sizes.values()) <= 2 * 20_000
    truth = {(r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in odd_rows()}
    assert {(r.doc_id, r["size"], r.text_crc32) for r in sharding.shard_documents(odd, 5).collect()} == truth
    assert sharding.shard_documents(empty).count() == 0


# Tokens and packing


def test_token_counts_equal_the_library():
    tk = Tokenizer.from_file(BYTE_BPE)
    rng = random.Random(3)
    parts = ["a", "the", " ", "  ", "\n", "'", "'s", "'ll", "12", "é", "中", "😀", "!", "..", "\t", " ", " ", "<|endoftext|>", "²", "\x1c", "\x85", "ZZ", "̀", "ing", " of"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    texts += ["".join(chr(rng.choice([rng.randint(1, 0x2FF), rng.randint(0x300, 0xD7FF), rng.randint(0xE000, 0x1FFFF)])) for _ in range(30)) for _ in range(1000)]
    texts += ["", "a" * 3000, "ab" * 3000, " " * 3000 + "x", " " * 3000, "the" * 1000, "x" + "\n" * 999]
    want = [len(e.ids) for e in tk.encode_batch(texts, add_special_tokens=False)]
    assert transducer.count_tokens(texts, BYTE_BPE).tolist() == want


def test_token_report(odd, empty):
    tk = Tokenizer.from_file(BYTE_BPE)
    want = sorted(str((r[0], len((r[1] or "").encode()), n := len(tk.encode(r[1] or "", add_special_tokens=False).ids), n > 1024)) for r in odd_rows())
    assert sorted(str(tuple(r)) for r in transducer.token_report(odd, BYTE_BPE).collect()) == want
    assert transducer.token_report(empty, BYTE_BPE).count() == 0


def test_transducer_is_rebuilt(monkeypatch):
    monkeypatch.setattr(transducer, "MOST_STATES", 50)
    machine = transducer.compiled.__wrapped__(BYTE_BPE)  # one of its own, whatever other tests have filled the shared one with
    texts = ["some words to make states of", "others"]
    monkeypatch.setattr(transducer, "compiled", lambda path: machine)
    a, b = (transducer.count_tokens(texts, BYTE_BPE) for _ in range(2))
    assert (a == b).all()
    assert len(machine.states) < 200


def test_packing(odd, unique, docs, empty):
    tk = Tokenizer.from_file(BYTE_BPE)
    for df in (unique, docs):
        rows = packing.pack_documents(df, BYTE_BPE).collect()
        by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
        for r in rows:
            by_doc[r.doc_id].append(r)
            by_sequence[r.sequence_id].append((r.offset, r.length))
        for r in df.collect():
            ids = np.array([*tk.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
            own, at = sorted(by_doc[r.doc_id], key=lambda p: p.piece), 0
            for k, p in enumerate(own):
                assert (p.piece, p.start) == (k, at)
                assert k == 0 or p.length == 1024
                assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
                at += p.length
            assert at == len(ids)
            assert len(own) == -(-len(ids) // 1024)
        for places in by_sequence.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= 1024
        bound = packing.lower_bound(np.array([r.length for r in rows]), 1024)
        assert bound <= len(by_sequence) <= bound + 1
    assert packing.pack_documents(empty, BYTE_BPE).count() == 0
    assert packing.pack_documents(odd, BYTE_BPE).count() >= odd.count()


def test_bounds_hold():
    rng = np.random.default_rng(0)
    for _ in range(50):
        sizes = rng.integers(1, 101, rng.integers(1, 60))
        bins, offsets, room = packing.best_fit_decreasing(sizes, 100)
        assert packing.lower_bound(sizes, 100) <= len(room)
        assert all(sizes[bins == b].sum() + room[b] == 100 for b in range(len(room)))
    assert packing.lower_bound(np.array([60] * 7), 100) == 7
    assert packing.lower_bound(np.array([34] * 6), 100) == 3


def test_sequences_hold_the_ids(docs):
    rows = packing.sequences(docs, BYTE_BPE).collect()
    assert all(len(r.ids) == sum(r.lengths) <= 1024 for r in rows)
    assert sum(len(r.ids) for r in rows) == sum(r.length for r in packing.pack_documents(docs, BYTE_BPE).collect())


# Pieces


def all_segmentations(model, text):
    s, out = model.prepare(text), []

    def walk(i, score, ids):
        if i == len(s):
            out.append((score, ids))
            return
        if s[i] not in model.ids:
            walk(i + 1, score + model.unknown_score, ids + model.spelled(pieces.UNKNOWN, s[i]))
        for n in range(1, model.longest + 1):
            if i + n <= len(s) and (p := model.ids.get(s[i : i + n])) is not None:
                walk(i + n, score + model.score[p], [*ids, p])

    walk(0, 0.0, [])
    return sorted(out, key=lambda x: -x[0])


def test_n_best_equals_brute_force():
    model, rng = pieces.pieces(PIECE_MODEL), random.Random(4)
    for _ in range(150):
        text = "".join(rng.choice("abte h in \n é中😀the") for _ in range(rng.randint(0, 11)))
        got, want = next(iter(pieces.encode_documents(pieces.Segments(model), [text], 4))), all_segmentations(model, text)
        assert [round(s, 3) for s, _, _ in got] == [round(s, 3) for s, _ in want[:4]]
        for score, ids, shown in got:
            assert (score, ids.tolist()) in want
            assert shown == text == model.decode(ids.tolist()) == model.model.decode(ids.tolist())


def test_pieces_round_trip(odd, docs, empty):
    for df in (odd, docs):
        rows = pieces.encode_n_best(df, PIECE_MODEL, 3).select("doc_id", "rank", "decoded").collect()
        texts = collections.defaultdict(set)
        for r in df.collect():
            texts[r.doc_id].add(r.text or "")
        assert all(r.decoded in texts[r.doc_id] for r in rows)
        assert sum(r["rank"] == 0 for r in rows) == df.count()
    decoded = pieces.decode(pieces.encode_n_best(docs, PIECE_MODEL, 1), PIECE_MODEL).select("doc_id", "text")
    assert decoded.exceptAll(docs.select("doc_id", "text")).isEmpty()
    assert pieces.n_best_report(empty, PIECE_MODEL).count() == 0


# Language


def test_held_out_accuracy(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    both = language.language_report(df).join(df.select("doc_id", "lang", "n_chars"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in both) / len(both) >= 0.98
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in both)


def test_spans_of_mixed_text(spark, docs):
    model = language.train(docs)
    en, fr = (docs.where(f"lang = '{x}' and n_chars > 800").first().text.split() for x in ("en", "fr"))
    mixed = " ".join(en[:50] + fr[:50])
    rows = language.label_spans(spark.createDataFrame([(1, mixed), (2, None), (3, "12 !? ²"), (4, "")], "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [s.lang for s in rows[0].spans] == ["en", "fr"]
    assert all((r.lang_pred, r.score, r.spans) == ("und", 0.0, []) for r in rows[1:])


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(2)
    scores = rng.normal(size=(9, 3)).astype(np.float32) * 3
    import itertools

    for a, b in ((0, 5), (5, 9)):
        def total(path, a=a):
            return sum(scores[a + i, p] for i, p in enumerate(path)) - 2.0 * sum(x != y for x, y in itertools.pairwise(path))

        want = max(itertools.product(range(3), repeat=b - a), key=total)
        got = language.viterbi(scores, np.array([0, 5, 9]), 2.0)[a:b]
        assert abs(total(want) - total(got)) < 1e-4


def test_language_of_odd_rows(spark, odd, empty):
    got = language.language_report(odd).collect()
    assert len(got) == odd.count()
    assert all(0 <= r.score <= 1 for r in got)
    assert language.language_report(empty).count() == 0
    nothing = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert language.language_report(nothing).first().lang_pred == "und"


# HTML


@pytest.mark.parametrize(("html", "want"), [
    ("<p>a<p>b", "a\n\nb"), ("<ul><li>a<li>b<ol start=3><li>c</ol></ul>x", "- a\n- b\n  3. c\n\nx"), ("a <!-- b --> c<br>d", "a c\nd"),
    ("<table><tr><th>N<th>Q<tr><td>long<td>1</table>", "N     Q\nlong  1"), ("<pre> a\n  b</pre>", " a\n  b"), ("x<script>y</script><style>z</style><p hidden>h", "x"),
    ("<div style='display:none'>a</div><div>b</div>", "b"), ("<head><title>t</title></head>b &amp; c", "b & c"), (None, ""), ("", ""), ("a < b", "a < b"),
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"), ("<h1>T</h1>x<hr>y", "T\n\nx\n---\ny"), ("<b><i>x</b>y</i>z", "xyz"),
])
def test_rendering(html, want):
    assert html_text.extract(html) == want


@pytest.mark.parametrize(("html", "want"), [
    ("<head><title>t</title><body>Some text<br>more", "Some text\nmore"), ("<head><title>t</title>bare text", "bare text"), ("<head>a<br>b", "a\nb"),
    ("<p title=don't>shown text</p><p>it's more</p>", "shown text\n\nit's more"), ("<p title='a>b' lang=\"c>d\">y", "y"), ("<p a=b'c title = \"e>f\">z", "z"),
    ("<a href=>q</a>", "q"), ("<p 'a>b</p>it's", "b\n\nit's"), ("<body>a<head>b", "ab"),
])
def test_open_heads_and_stray_quotes(html, want):
    assert html_text.extract(html) == want


def test_deep_pages_do_not_recurse():
    assert html_text.extract("<div>" * 50_000 + "x").strip() == "x"


def test_all_visible_words_are_there(spark):
    from html.parser import HTMLParser

    class Words(HTMLParser):
        def __init__(self):
            super().__init__()
            self.out, self.skip = [], 0

        def handle_starttag(self, tag, attrs):
            self.skip += tag in ("script", "style", "title")
            self.out += [" "] * (tag in html_text.BLOCK or tag == "br")

        def handle_endtag(self, tag):
            self.skip -= tag in ("script", "style", "title")
            self.out += [" "] * (tag in html_text.BLOCK)

        def handle_data(self, data):
            if not self.skip:
                self.out.append(data)

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    texts = {r.page_id: r.text for r in html_text.page_text(pages).collect()}
    for r in pages.collect():
        parser = Words()
        parser.feed(r.html)
        parser.close()
        assert "".join(parser.out).split() == [w for w in texts[r.page_id].split() if w != "-"]
    assert html_text.page_text(pages.limit(0)).count() == 0


# Near-dedup of the pipeline


def jaccard_kept(rows):
    """The ids that stay, by brute force over sets of 5-word shingles."""
    sets = []
    for _, t in rows:
        words = WORD.findall(lower(t or ""))
        sets.append({" ".join(words[k : k + 5]) for k in range(len(words) - 4)} or {" ".join(words)})
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted(least.values())


def test_near_stage_equals_brute_force(spark, unique, docs):
    import corpus_pipeline

    rng = random.Random(9)
    words = [f"w{i}" for i in range(5000)]
    rows = []
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.randint(6, 250))]
        rows.append(" ".join(base))
        for changed in (1, 2, 4, 5, 8):
            copy = list(base)
            for at in rng.sample(range(len(copy)), min(changed, len(copy))):
                copy[at] = "changed"
            rows.append(" ".join(copy if changed % 2 else copy[: len(copy) * 9 // 10]))
    made = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(5)
    for df in (made, unique, docs):
        want = jaccard_kept([tuple(r) for r in df.select("doc_id", "text").collect()])
        kept = corpus_pipeline.near_duplicates(spark, df, "")
        assert kept.columns == df.columns
        assert sorted(r.doc_id for r in kept.collect()) == want


# The pipeline


def test_pipeline(spark, odd):
    import corpus_pipeline

    docs = odd.drop("id", "key", "fp")
    columns, names = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        names.append(name)
        if name != "packing":
            assert docs.columns == columns
            assert docs.count() <= before.count()
    assert len(names) == 5
    assert docs.count() > 0
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.drop("id", "key", "fp").limit(0), "").count() == 0


def test_stages_leave_nothing_once_written(spark, odd, tmp_path):
    """What a stage has held goes when the next one starts on its written rows, and stays as long as something reads it."""
    import corpus_pipeline
    from talentlake.llm import common

    docs = odd.drop("id", "key", "fp")
    start = set(common.held_tables())
    kept = corpus_pipeline.quality_rules(spark, docs, "")
    held = set(common.held_tables()) - start
    unwritten = corpus_pipeline.exact_duplicates(spark, kept, "")
    n = unwritten.count()
    kept.write.parquet(f"{tmp_path}/kept")
    assert held & set(common.held_tables())
    again = corpus_pipeline.exact_duplicates(spark, spark.read.parquet(f"{tmp_path}/kept"), "")
    assert not held & set(common.held_tables())
    assert again.count() == n


def test_queries_are_registered():
    import __spark_entry__

    names = [n for n in __spark_entry__.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 14))
    assert "pipeline" in __spark_entry__.queries()
    assert public_tokenizers.path("byte_bpe_50k.json") == BYTE_BPE
