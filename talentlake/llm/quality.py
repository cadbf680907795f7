"""Quality rules with adaptive thresholds, in DataFrame functions only.

Each document gets counts and, from them, a few rates. A KLL sketch per (lang, source) describes how a rate is
distributed there; sketches merge, so those of a language and of everything come from the same pass. A
document fails a rule if its rate lies beyond the upper quartile of its group by ``SPREAD`` times the distance
between the quartiles plus a slack, which keeps groups without any spread from rejecting ordinary documents.
Groups of under ``LEAST_ROWS`` documents use the thresholds of their language, small languages those of all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, SPACES, cut, free_name

LEAST_ROWS = 200
SPREAD = 6.0
#: Rate -> slack beyond the fence, in the rate's own unit; half of the lines repeated is ordinary in a text of a few lines.
RATES = {"symbols_per_word": 0.25, "shouting": 0.15, "dup_line_share": 0.5, "word_length": 4.0, "stutter": 0.2}
WINDOW = 5


def with_counts(docs: DataFrame, text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """``docs`` and the counts of its texts, under names that do not clash; the names by count."""
    keys = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", *RATES]
    temps = ["q_words", "q_hashes", "q_sorted", "q_starts", "q_lines", "q_caps"]
    names = dict(zip(keys + temps, free_name(docs, *keys, *temps), strict=True))
    col = {k: F.col(v) for k, v in names.items()}
    whole = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.btrim(whole, F.lit(SPACES))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_CLASS + "+"))
    out = docs.withColumns({
        names["q_words"]: words,
        names["n_symbols"]: F.regexp_count(whole, F.lit("[#*$%&|<>]")).cast("long"),
        names["q_caps"]: F.regexp_count(whole, F.lit(r"[\p{Lu}!]")).cast("long"),
        names["q_lines"]: F.filter(F.split(whole, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != ""),
    })
    w, last = col["q_words"], F.size(col["q_words"]) - WINDOW
    window_hash = lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)])
    out = out.withColumns({
        names["n_words"]: F.size(w).cast("long"),
        names["word_chars"]: F.length(F.array_join(w, "")).cast("long"),
        names["n_dup_lines"]: (F.size(col["q_lines"]) - F.size(F.array_distinct(col["q_lines"]))).cast("long"),
        names["dup_line_share"]: 1.0 - F.coalesce(F.try_divide(F.size(F.array_distinct(col["q_lines"])), F.size(col["q_lines"])), F.lit(1.0)),
        names["q_hashes"]: F.when(last >= 1, F.transform(F.sequence(F.lit(0), last), window_hash)),
    })
    # Equal windows have equal hashes; only texts with equal hashes compare the windows themselves.
    repeats = F.size(F.array_distinct(col["q_hashes"])) < F.size(col["q_hashes"])
    windows = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(F.array_join(F.slice(w, i + 1, WINDOW), " ").alias("g"), i.alias("at")))
    out = out.withColumn(names["q_sorted"], F.when(repeats, F.array_sort(windows)))
    s = col["q_sorted"]
    twice = F.filter(s, lambda x, i: (F.get(s, i - 1)["g"] == x["g"]) | (F.get(s, i + 1)["g"] == x["g"]))
    out = out.withColumn(names["q_starts"], F.array_sort(F.transform(twice, lambda x: x["at"])))
    starts = col["q_starts"]
    covered = F.transform(starts, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, i + 1), p + WINDOW) - p))
    out = out.withColumn(names["n_repeat_words"], F.coalesce(F.aggregate(covered, F.lit(0), lambda a, b: a + b), F.lit(0)).cast("long"))
    out = out.withColumns({
        names["base_failed"]: (col["n_words"] < 10) | (100 * col["n_repeat_words"] > 20 * col["n_words"]),
        names["symbols_per_word"]: F.coalesce(F.try_divide(col["n_symbols"], col["n_words"]), F.lit(0.0)),
        names["shouting"]: F.coalesce(F.try_divide(col["q_caps"], col["word_chars"]), F.lit(0.0)),
        names["word_length"]: F.coalesce(F.try_divide(col["word_chars"], col["n_words"]), F.lit(0.0)),
        names["stutter"]: F.coalesce(F.try_divide(F.size(F.filter(w, lambda x, i: x == F.get(w, i - 1))), col["n_words"]), F.lit(0.0)),
    })
    return out.drop(*[names[t] for t in temps]), {k: names[k] for k in keys}


def thresholds(rates: DataFrame) -> DataFrame:
    """lang, source, fence_<rate>: the upper fence of every group of ``rates`` (lang, source, RATES)."""
    sketches = rates.groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("n"), *[F.kll_sketch_agg_double(F.col(r)).alias(r) for r in RATES]
    )
    sketches = cut(sketches, "quality-sketches")

    def merged(by: list[str], mark: str) -> DataFrame:
        return sketches.groupBy(*by).agg(F.sum("n").alias(f"n_{mark}"), *[F.kll_merge_agg_double(F.col(r)).alias(f"{r}_{mark}") for r in RATES])

    langs = merged(["lang"], "lang").withColumnRenamed("lang", "of_lang")
    both = sketches.join(langs, sketches["lang"].eqNullSafe(langs["of_lang"]), "left").drop("of_lang")
    both = both.crossJoin(F.broadcast(merged([], "all")))  # one row

    def fence(r: str, slack: float) -> Column:
        sketch = F.when(F.col("n") >= LEAST_ROWS, F.col(r)).when(F.col("n_lang") >= LEAST_ROWS, F.col(f"{r}_lang")).otherwise(F.col(f"{r}_all"))
        low, high = (F.kll_sketch_get_quantile_double(sketch, F.lit(q)) for q in (0.25, 0.75))
        return (high + SPREAD * (high - low) + F.lit(slack)).alias(f"fence_{r}")

    return both.select("lang", "source", *[fence(r, slack) for r, slack in RATES.items()])


def _judged(docs: DataFrame, carry: list[str]) -> tuple[DataFrame, dict[str, str], list[str]]:
    counted, names = with_counts(docs)
    lang, source, verdict = free_name(counted, "q_lang", "q_source", "q_kept")
    counted = counted.withColumns({
        lang: F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string"),
        source: F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string"),
    })
    rows = cut(counted.select(*carry, lang, source, *names.values()), "quality-counts")
    limits = thresholds(rows.select(F.col(lang).alias("lang"), F.col(source).alias("source"), *[F.col(names[r]).alias(r) for r in RATES]))
    at = dict(zip(["lang", "source", *[f"fence_{r}" for r in RATES]], free_name(rows, *[f"t_{c}" for c in limits.columns]), strict=True))
    limits = cut(limits.select(*[F.col(c).alias(n) for c, n in at.items()]), "quality-limits")  # so that Spark knows its size
    rows = rows.join(limits, rows[lang].eqNullSafe(limits[at["lang"]]) & rows[source].eqNullSafe(limits[at["source"]]), "left")
    good = ~F.col(names["base_failed"])
    for r in RATES:
        good = good & (F.col(names[r]) <= F.col(at[f"fence_{r}"]))
    return rows.withColumn(verdict, good), names, [lang, source, verdict]


def quality_report(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, the counts, base_failed, kept and the rates that decided.

    Words are runs of anything but ASCII white space. Null text counts as a text without words, which fails
    the base rule (under ten words). Null lang or source, or a missing column, forms a group of its own. Equal
    rows get equal verdicts; an empty table gives an empty result; extra columns are ignored."""
    rows, names, (_, _, verdict) = _judged(docs.select("doc_id", "text", *[c for c in ("lang", "source") if c in docs.columns]), ["doc_id"])
    report = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return rows.select("doc_id", *[F.col(names[c]).alias(c) for c in report], F.col(verdict).alias("kept"), *[F.col(names[r]).alias(r) for r in RATES])


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``quality_report`` keeps, with all their columns and no others.

    Texts are measured once and written with their counts; the thresholds read the narrow columns only, and no
    text is exchanged."""
    own = [f"`{c}`" for c in docs.columns]
    rows, _, (_, _, verdict) = _judged(docs, own)
    return rows.where(F.col(verdict)).select(*own)
