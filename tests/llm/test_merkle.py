"""The Merkle manifest against a plain tree in memory, and the registered query against its twin."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest

from talentlake.llm import merkle
from talentlake.llm.queries import ORACLES, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, place long, n int, digest string"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def climb(digests, fanout=8):
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i : i + fanout])) for i in range(0, len(levels[-1]), fanout)])
    return levels


def path_of(levels, place, fanout=8):
    out = []
    for level in levels[:-1]:
        first = place // fanout * fanout
        run = level[first : first + fanout]
        out.append(("".join(run[: place - first]), "".join(run[place - first + 1 :])))
        place //= fanout
    return out


def brute(rows, fanout=8):
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append(r)
    order = sorted(trees, key=lambda k: (k is not None, (k or "").encode()))
    built = {k: climb([d for _, d in sorted(((r[0] is not None, r[0] or 0), leaf(r[0], r[3], r[2], r[4], r[1])) for r in trees[k])], fanout) for k in order}
    top = climb([built[k][-1][0] for k in order], fanout)
    out = []
    for k in order:
        ranked = sorted(trees[k], key=lambda r: ((r[0] is not None, r[0] or 0), leaf(r[0], r[3], r[2], r[4], r[1])))
        for i, r in enumerate(ranked):
            path = path_of(built[k], i, fanout) + path_of(top, order.index(k), fanout)
            own = leaf(r[0], r[3], r[2], r[4], r[1])
            cur = own
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                cur = leaf(r[0], r[3], r[2], r[4], r[1] and re.sub("[A-Z]", lambda m: m[0].lower(), r[1]))
            for a, b in path:
                cur = h(a + cur + b)
            out.append((r[0], own, built[k][-1][0], top[-1][0], h("".join(a + b for a, b in path)), cur, cur == top[-1][0]))
    return sorted(map(str, out))


def rows_of(n_hot=700):
    langs = ["en"] * n_hot + ["de"] * 65 + ["é"] * 8 + [None] * 9 + ["fr"] + ["=", "", "zz"] + [f"l{i}" for i in range(12)]
    rows = [(3 * i, [None, "", "Some Text", "no capitals", "É é\x00 Long " * 50][i % 5], lang, None if i % 7 == 0 else f"s{i}", None if i % 4 == 0 else i, "t", 1, 2, "d") for i, lang in enumerate(langs)]
    return rows + [rows[5], rows[5], (rows[5][0], "Other Text", "en", "s", 1, "t", 1, 2, "d"), (None, "No Id", "en", "s", 1, "t", 1, 2, "d")]


@pytest.mark.parametrize(("fanout", "levels"), [(8, 4), (8, 1), (8, 2), (3, 2), (2, 3)])
def test_against_a_plain_tree(spark, fanout, levels):
    rows = rows_of()
    got = merkle.manifest(spark.createDataFrame(rows, SCHEMA).repartition(6), fanout, levels).collect()
    assert sorted(str(tuple(r)) for r in got) == brute(rows, fanout)


def test_small_and_empty_tables(spark):
    for rows in ([], [(1, None, None, None, None, "", 0, 0, "")], [(i, "A", "en", None, i, "", 0, 0, "") for i in range(8)], [(i, "A", "en", None, i, "", 0, 0, "") for i in range(9)]):
        got = merkle.manifest(spark.createDataFrame(rows, SCHEMA)).collect()
        assert sorted(str(tuple(r)) for r in got) == (brute(rows) if rows else [])


def test_any_change_is_seen(spark):
    rows = rows_of(40)
    roots = set()
    for change in (lambda r: r, lambda r: (r[0], (r[1] or "") + " ", *r[2:]), lambda r: (*r[:3], "other", *r[4:]), lambda r: (*r[:4], 10**9, *r[5:])):
        changed = [change(r) if i == 20 else r for i, r in enumerate(rows)]
        roots |= {r.root for r in merkle.manifest(spark.createDataFrame(changed, SCHEMA)).select("root").distinct().collect()}
    assert len(roots) == 4


def test_a_very_long_text_is_one_leaf(spark):
    rows = [(0, "Long " * 400_000, "en", "s", 1, "", 0, 0, ""), (3, "short", "en", "s", 1, "", 0, 0, "")]
    assert sorted(str(tuple(r)) for r in merkle.manifest(spark.createDataFrame(rows, SCHEMA)).collect()) == brute(rows)


def test_fold_keeps_runs_in_order():
    digests = [h(str(i)) for i in range(70)]
    matrix = np.frombuffer("".join(digests).encode(), np.uint8).reshape(-1, 64)
    assert [[bytes(d).decode() for d in level] for level in merkle.fold(matrix, 8, 3)] == climb(digests)


def test_unchanged_leaves_are_folded_too(spark):
    """The root of every row is hashed up from its leaf: where siblings do not belong to it, an untampered row says so as well."""
    leaves = [h("a"), h("b")]
    placed = spark.createDataFrame([("=en", i, 2, d, None, i) for i, d in enumerate(leaves)], "tree string, place long, n long, digest string, changed string, doc_id long")
    above = spark.createDataFrame([("=en", 0, [("x", "y")])], f"tree string, place long, path {merkle._ABOVE}")
    got = {r.folded for r in merkle._answers(placed, above, 8, 4).collect()}
    assert got == {h("x" + h("".join(leaves)) + "y")}


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_twin(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf{sf}/documents.parquet'")
    theirs = con.sql(ORACLES["op13_merkle_manifest"])
    ours = QUERIES["op13_merkle_manifest"](spark, f"/root/testdata/sf{sf}").select(*theirs.columns)
    assert sorted(map(tuple, ours.collect())) == sorted(theirs.fetchall())
