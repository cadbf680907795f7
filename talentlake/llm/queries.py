"""The registered queries of this subpackage: thin wrappers that apply an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, html_text, language, merkle, minhash, packing, pieces, quality, recompression, resampling, sharding, simhash, transducer


BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), BYTE_BPE, capacity=1024, end_id=2)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_classes(_table(spark, sf_dir, "documents"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"), shards=24)


def op5_piece_n_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.n_best_report(_table(spark, sf_dir, "documents"), PIECE_MODEL, n=4)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_report(_table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompression.passage_report(_table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(_table(spark, sf_dir, "documents"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.page_text(_table(spark, sf_dir, "pages"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transducer.token_report(_table(spark, sf_dir, "documents"), BYTE_BPE, limit=1024)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), percent=5, least_words=20, seed=42)


def op12_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), size=5, least=(85, 100))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_kd_sharding": op4_kd_sharding,
    "op5_piece_n_best": op5_piece_n_best,
    "op6_language_id": op6_language_id,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_quality_rules": op8_quality_rules,
    "op9_html_text": op9_html_text,
    "op10_token_counts": op10_token_counts,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_minhash_near_dedup": op12_minhash_near_dedup,
    "op13_merkle_manifest": op13_merkle_manifest,
}

_FIELD = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
_FIELDS = "{0}, {1}, {2}, {3}".format(*(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars")))
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: CRC-32 of a text of ASCII characters, bit by bit: each character comes with seven steps (-1) that only shift.
_CRC = """xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split({0}, ''), lambda c: list_prepend(ascii(c)::BIGINT, [-1::BIGINT, -1, -1, -1, -1, -1, -1])))),
               lambda acc, x: xor(xor(acc, greatest(x, 0)) >> 1, CASE WHEN xor(acc, greatest(x, 0)) & 1 = 1 THEN 3988292384::BIGINT ELSE 0 END)))"""

ORACLES: dict[str, str] = {
    "op13_merkle_manifest": f"""
        WITH RECURSIVE d AS (
            SELECT coalesce('=' || lang, '') AS tree, doc_id, sha256(concat({_FIELDS}, {_FIELD.format("text")})) AS digest,
                   CASE WHEN {_CRC.format("doc_id::VARCHAR")} % 3 = 0 THEN sha256(concat({_FIELDS}, {_FIELD.format(_LOWER)})) END AS changed FROM documents),
        leaves AS (
            SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id, digest) - 1 AS place, count(*) OVER (PARTITION BY tree) AS n FROM d),
        nodes AS (
            SELECT tree, 0 AS lvl, place, n, digest FROM leaves
            UNION ALL
            SELECT tree, lvl + 1, place // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY place)) FROM nodes WHERE n > 1 GROUP BY ALL),
        langs AS (
            SELECT tree, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS n FROM nodes WHERE n = 1),
        tops AS (
            SELECT 0 AS lvl, place, n, subroot AS digest FROM langs
            UNION ALL
            SELECT lvl + 1, place // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY place)) FROM tops WHERE n > 1 GROUP BY ALL),
        spot AS (SELECT tree, doc_id, place AS leaf, lvl, place // (8 ** lvl)::BIGINT AS place FROM leaves, (SELECT unnest(range(16)) AS lvl)),
        lang_spot AS (SELECT tree, lvl, place // (8 ** lvl)::BIGINT AS place FROM langs, (SELECT unnest(range(16)) AS lvl)),
        lower_path AS (
            SELECT a.tree, a.leaf, a.lvl, coalesce(string_agg(s.digest, '' ORDER BY s.place) FILTER (WHERE s.place < a.place), '') AS l,
                   coalesce(string_agg(s.digest, '' ORDER BY s.place) FILTER (WHERE s.place > a.place), '') AS r
            FROM spot a JOIN nodes s ON s.tree = a.tree AND s.lvl = a.lvl AND s.place // 8 = a.place // 8 WHERE s.n > 1 GROUP BY ALL),
        upper_path AS (
            SELECT a.tree, a.lvl, coalesce(string_agg(s.digest, '' ORDER BY s.place) FILTER (WHERE s.place < a.place), '') AS l,
                   coalesce(string_agg(s.digest, '' ORDER BY s.place) FILTER (WHERE s.place > a.place), '') AS r
            FROM lang_spot a JOIN tops s ON s.lvl = a.lvl AND s.place // 8 = a.place // 8 WHERE s.n > 1 GROUP BY ALL),
        steps AS (
            SELECT tree, leaf, lvl, l, r FROM lower_path
            UNION ALL SELECT tree, place, 100 + lvl, l, r FROM leaves JOIN upper_path USING (tree)),
        path AS (SELECT tree, leaf, string_agg(l || r, '' ORDER BY lvl) AS proof, list(l || '|' || r ORDER BY lvl) AS steps FROM steps GROUP BY ALL),
        folded AS (
            SELECT v.*, coalesce(proof, '') AS proof,
                   list_reduce(list_prepend(coalesce(changed, digest), coalesce(steps, [])), lambda acc, x: sha256(split_part(x, '|', 1) || acc || split_part(x, '|', 2))) AS folded_root
            FROM leaves v LEFT JOIN path p ON p.tree = v.tree AND p.leaf = v.place)
        SELECT doc_id, f.digest AS leaf, subroot, t.digest AS root, sha256(proof) AS proof_sha256, folded_root, folded_root = t.digest AS verified
        FROM folded f JOIN langs USING (tree) JOIN tops t ON t.n = 1
    """,
    "op7_substring_dedup": r"""
        WITH w AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        starts AS (
            SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS s FROM w WHERE len(ws) >= 20),
        marked AS (
            SELECT doc_id, s, row_number() OVER (PARTITION BY array_to_string(ws[s:s + 19], ' ') ORDER BY doc_id, s) AS nth
            FROM starts),
        gone AS (
            SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS k FROM marked WHERE nth > 1),
        words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS k FROM w)
        SELECT w.doc_id, len(ws)::BIGINT AS n_words, count(gone.k)::BIGINT AS n_removed,
               sha256(coalesce(string_agg(word, ' ' ORDER BY words.k) FILTER (WHERE gone.k IS NULL), '')) AS kept_sha256
        FROM w LEFT JOIN words USING (doc_id) LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.k = words.k
        GROUP BY w.doc_id, len(ws)
    """,
    "op2_exact_dedup": """
        WITH d AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
            FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY norm)
    """,
}
