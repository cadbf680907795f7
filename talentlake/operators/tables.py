"""Table operators: merging columns and rows, latest-wins loads, audits, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_light, clean_strict, clean_structure, first_usable, match_key, norm_empty


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """``df``, or an error that says which columns it lacks."""
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def select_existing(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*[n for n in names if n in df.columns])


def prefer_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """All columns, the named ones first."""
    first = [n for n in names if n in df.columns]
    return df.select(*first, *[c for c in df.columns if c not in first])


def with_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Missing columns added with their default."""
    return df.withColumns({k: F.lit(v) for k, v in defaults.items() if k not in df.columns})


def semantic_merge(df: DataFrame, sources: dict[str, list[str]], keep: list[str] | None = None) -> DataFrame:
    """Each output is the first usable of its source columns; sources that do not exist are skipped."""
    out = []
    for name, columns in sources.items():
        there = [F.col(c).cast("string") for c in columns if c in df.columns]
        out.append((first_usable(*there) if there else F.lit(None).cast("string")).alias(name))
    return df.select(*(keep or []), *out)


def merge_rows(df: DataFrame, key: str, order: Column, joined: list[str], first: list[str]) -> DataFrame:
    """One row per ``key`` (null keys dropped): the first usable value of the columns in ``first`` and all distinct usable
    values of those in ``joined``, in order, between bars; field_count is how many the first of ``joined`` has."""
    firsts = [F.min_by(norm_empty(F.col(c)), F.when(norm_empty(F.col(c)).isNotNull(), order)).alias(c) for c in first]
    listed = lambda c: F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(norm_empty(F.col(c)).isNotNull(), F.struct(order.alias("o"), norm_empty(F.col(c)).alias("v"))))), lambda x: x["v"]))
    merged = df.where(F.col(key).isNotNull()).groupBy(key).agg(*firsts, *[listed(c).alias(c) for c in joined])
    count = {"field_count": F.size(joined[0])} if joined else {}
    return merged.withColumns(count).withColumns({c: F.array_join(c, " | ") for c in joined})


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in ``order``: latest-wins upserts, last row per key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same keys."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` and the rows of ``new`` whose keys it does not have, one per key."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def replace_children(old: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """All rows of the parents in ``new`` are replaced by theirs."""
    return old.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new, allowMissingColumns=True)


def missing_ratio(df: DataFrame) -> DataFrame:
    """column_name, missing: the share of nulls of every column, in one pass."""
    parts = [F.struct(F.lit(c).alias("column_name"), F.coalesce(F.avg(F.col(c).isNull().cast("double")), F.lit(0.0)).alias("missing")) for c in df.columns]
    return df.agg(F.array(*parts).alias("a")).select(F.explode("a").alias("a")).select("a.*")


def duplicate_ratio(df: DataFrame, key: str) -> DataFrame:
    """The share of rows that repeat an earlier key; nulls count as one key."""
    k = F.col(key)
    distinct = F.countDistinct(k) + F.coalesce(F.max(k.isNull().cast("int")), F.lit(0))
    return df.agg(F.coalesce(F.try_divide((F.count(F.lit(1)) - distinct).cast("double"), F.count(F.lit(1))), F.lit(0.0)).alias("duplicate_ratio"))


def duplicated_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, error) for every rule that a row breaks; a rule is true where it is broken."""
    broken = F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in rules.items()]), lambda e: e.isNotNull())
    return df.select(key, F.explode(broken).alias("error"))


def describe_by(df: DataFrame, by: str, value: Column) -> DataFrame:
    """count, mean, std, min, quartiles and max of ``value`` per group."""
    q = lambda p, name: F.percentile(value, F.lit(p)).alias(name)
    return df.groupBy(by).agg(
        F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"),
        q(0.25, "p25"), q(0.5, "p50"), q(0.75, "p75"), F.max(value).alias("max"),
    )


def page(df: DataFrame, limit: int, offset: int, *order: Column) -> DataFrame:
    """A page of a listing; at most 100 rows."""
    return df.orderBy(*order).offset(offset).limit(min(limit, 100))


def clean_variants(df: DataFrame, columns: list[str]) -> DataFrame:
    """Four more columns for each text: _clean, _structured, _strict, _key. Unused ones are pruned from the plan."""
    variants = {"clean": clean_light, "structured": clean_structure, "strict": clean_strict, "key": match_key}
    return df.withColumns({f"{c}_{name}": f(F.col(c)) for c in columns for name, f in variants.items()})


def any_text(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with text in at least one of the columns."""
    return df.where(F.coalesce(*[norm_empty(F.col(c)) for c in columns]).isNotNull())


def numbers(text: str) -> list[int]:
    """A list such as "10,5,x,5" of cut-offs: its positive numbers, sorted, once each."""
    return sorted({int(p) for p in text.split(",") if p.strip().isdigit() and int(p) > 0})


KEYS = ("cv_id", "cv_key", "file_name", "source_path")


def common_key(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = KEYS) -> str:
    """The first of the usual keys that both have."""
    for k in keys:
        if k in a.columns and k in b.columns:
            return k
    raise ValueError(f"no common key among {', '.join(keys)}")


def join_truth(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """Predictions and truth by their common key, lower-cased and trimmed; other columns get _pred and _gt."""
    k = common_key(predicted, truth)
    key = F.lower(F.trim(F.col(k).cast("string"))).alias("key")
    p = predicted.select(key, *[F.col(c).alias(f"{c}_pred") for c in predicted.columns if c != k])
    return p.join(truth.select(key, *[F.col(c).alias(f"{c}_gt") for c in truth.columns if c != k]), "key")
