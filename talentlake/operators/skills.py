"""Skill records, support and role profiles."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.jobs import experience_pattern
from ..functions.skills import importance, split_segments
from ..functions.text import clean_light, match_key, plain_key, role_name
from .dictionary import occurrences


def skill_records(df: DataFrame, key: list[str], fields: dict[str, Column], vocabulary: dict[str, list[str]] | DataFrame, excerpt: int = 300) -> DataFrame:
    """key, skill, source_field, importance, excerpt: one row per skill, field and importance, with the first segment that
    names it. ``fields`` are the texts by source field; the vocabulary is a mapping or a table (name, alias) of any size."""
    texts = F.array(*[F.struct(F.lit(n).alias("source_field"), t.alias("text")) for n, t in fields.items()])
    keyed = F.transform(split_segments(clean_light(F.col("f.text"), long=True)), lambda s: F.struct(s.alias("segment"), plain_key(s).alias("seg_key")))  # in the array, as a filter behind it would work the key out twice
    parts = df.select(*key, F.explode(texts).alias("f")).select(*key, "f.source_field", F.posexplode(keyed).alias("pos", "s"))
    parts = parts.select(*key, "source_field", "pos", F.left("s.segment", F.lit(excerpt)).alias("segment"), F.col("s.seg_key").alias("seg_key")).where("seg_key <> ''")
    parts = parts.withColumn("importance", importance(F.col("seg_key"), F.col("source_field")))
    found = occurrences(parts, F.col("seg_key"), vocabulary).withColumnRenamed("name", "skill")
    return found.groupBy(*key, "skill", "source_field", "importance").agg(F.min_by("segment", "pos").alias("excerpt"))


def skill_lists(records: DataFrame, key: list[str], importance: str | None = None) -> DataFrame:
    """key, skills: the distinct skills of the records of each key, sorted; with ``importance`` only those of that importance. A
    key whose records are all of another importance has an empty list."""
    wanted = F.lit(True) if importance is None else F.col("importance") == importance
    return records.groupBy(*key).agg(F.sort_array(F.collect_set(F.when(wanted, F.col("skill")))).alias("skills"))


def lists_by_importance(records: DataFrame, key: list[str], importances: list[str]) -> DataFrame:
    """key, skills and a list for each of ``importances`` under its name, as ``skill_lists`` makes them, in one pass over the records."""
    each = {i: F.sort_array(F.collect_set(F.when(F.col("importance") == i, F.col("skill")))) for i in importances}
    return records.groupBy(*key).agg(F.sort_array(F.collect_set("skill")).alias("skills"), *[c.alias(i) for i, c in each.items()])


def role_skill_stats(records: DataFrame, role: str) -> DataFrame:
    """How many skill records each role has of each skill and importance."""
    return records.groupBy(role, "skill", "importance").agg(F.count(F.lit(1)).alias("job_count"))


def catalog_support(
    df: DataFrame, role: str, text: Column, vocabulary: dict[str, list[str]] | DataFrame, least_mentions: int = 1, least_roles: int = 1
) -> DataFrame:
    """skill, mentions (rows that name it), roles: those with enough of either. Names are found by ``dictionary.occurrences``, so the
    vocabulary may have any size."""
    rows = df.select(F.col(role), F.monotonically_increasing_id().alias("_row"), match_key(text, long=True).alias("_key"))
    found = occurrences(rows, F.col("_key"), vocabulary).select("_row", role, F.col("name").alias("skill")).distinct()
    support = found.groupBy("skill").agg(F.count(F.lit(1)).alias("mentions"), F.countDistinct(role).alias("roles"))
    return support.where((F.col("mentions") >= least_mentions) | (F.col("roles") >= least_roles))


def merge_catalogs(*catalogs: DataFrame) -> DataFrame:
    """canonical, aliases: the union of the aliases of (canonical, alias) frames, with the name itself, sorted."""
    both = catalogs[0]
    for c in catalogs[1:]:
        both = both.unionByName(c)
    both = both.unionByName(both.select("canonical", F.col("canonical").alias("alias")))
    return both.groupBy("canonical").agg(F.sort_array(F.collect_set("alias")).alias("aliases"))


def keyword_counts(df: DataFrame, role: str, text: Column, stopwords: list[str], least: int = 3) -> DataFrame:
    """role, word, n: words of ``least`` letters or more that are no stopwords and no numbers."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"([a-z0-9]{{{max(least, 1)},}})"))  # a run matches whole, a shorter one nowhere
    rows = df.select(role, F.explode(words).alias("word"))
    rows = rows.where(~F.col("word").rlike("^[0-9]+$") & ~F.col("word").isin(*stopwords))
    return rows.groupBy(role, "word").agg(F.count(F.lit(1)).alias("n"))


def top_by(counts: DataFrame, role: str, item: str, k: int) -> DataFrame:
    """The ``k`` most frequent items of each role, equal counts by name: rank from 1."""
    w = Window.partitionBy(role).orderBy(F.col("n").desc(), F.col(item))
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def next_items(counts: DataFrame, role: str, item: str, top: int, more: int) -> DataFrame:
    """The ``more`` items that follow a role's top; where a role has too few, the globally most frequent ones it has not."""
    w = Window.partitionBy(role).orderBy(F.col("n").desc(), F.col(item))
    ranked = counts.withColumn("rank", F.row_number().over(w))
    following = ranked.where(F.col("rank").between(top + 1, top + more)).select(role, item, F.lit(0).alias("from_all"), F.col("rank").alias("place"))
    total = counts.groupBy(item).agg(F.sum("n").alias("n"))
    leaders = total.orderBy(F.col("n").desc(), F.col(item)).limit(top + more + more)  # a fixed number of rows
    leaders = leaders.withColumn("place", F.row_number().over(Window.orderBy(F.col("n").desc(), F.col(item))))
    fallback = counts.select(role).distinct().crossJoin(F.broadcast(leaders.select(item, "place")))
    taken = ranked.where(F.col("rank") <= top + more).select(role, item)
    fallback = fallback.join(taken, [role, item], "left_anti").select(role, item, F.lit(1).alias("from_all"), "place")
    order = Window.partitionBy(role).orderBy("from_all", "place")
    return following.unionByName(fallback).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= more).select(role, item, "rank")


def role_items(df: DataFrame, role: Column, text: Column, experience: Column, vocabulary: dict[str, list[str]] | DataFrame, stopwords: list[str], least: int = 3) -> DataFrame:
    """(role, kind, item, n): what profiles are made of, counted kind by kind. Of every row one `job`, its `experience` pattern, its
    `keyword`s (each time they occur) and the `skill`s it names (once each)."""
    role, kind = role_name(role).alias("role"), lambda name: F.lit(name).alias("kind")
    jobs = df.select(role, experience_pattern(experience).alias("item"))
    words = keyword_counts(df.select(role, text.alias("_text")), "role", F.col("_text"), stopwords, least)
    named = occurrences(df.select(role, F.monotonically_increasing_id().alias("_row"), match_key(F.coalesce(text, F.lit("")), long=True).alias("_key")), F.col("_key"), vocabulary)
    named = named.select("role", "_row", F.col("name").alias("item")).distinct()
    count = lambda rows, name: rows.groupBy("role", "item").agg(F.count(F.lit(1)).alias("n")).select("role", kind(name), "item", "n")
    every = [count(jobs.select("role", F.lit("").alias("item")), "job"), count(jobs, "experience"), words.select("role", kind("keyword"), F.col("word").alias("item"), "n"), count(named, "skill")]
    return functools.reduce(DataFrame.unionByName, every)


def profiles(items: DataFrame, least_jobs: int = 1, top_skills: int = 8, top_keywords: int = 8, top_experience: int = 5, more: int = 4) -> DataFrame:
    """role_name, job_count, common_skills, common_keywords, common_experience_patterns, recommended_next_skills of (role, kind, item, n).

    Roles with fewer than ``least_jobs`` have no profile and are not ranked, but their skills count for the global order. Items stand
    by count, equal ones by name. The next skills follow the top ones; where there are fewer than ``more``, the globally most
    frequent ones that the role does not list follow."""
    able = items.where((F.col("kind") == "job") & (F.col("n") >= least_jobs)).select("role", F.col("n").alias("job_count"))
    ranked = items.where("kind <> 'job'").join(able.select("role"), "role")  # one row for each role; a semi join could move below the counts, which then would be made twice
    most = F.when(F.col("kind") == "skill", top_skills + more).when(F.col("kind") == "keyword", top_keywords).otherwise(top_experience)
    place = F.row_number().over(Window.partitionBy("role", "kind").orderBy(F.col("n").desc(), "item"))
    ranked = ranked.withColumn("place", place).where(F.col("place") <= max(top_skills + more, top_keywords, top_experience)).where(F.col("place") <= most)  # the first bound is a limit of the window
    of = lambda kind, low, high: F.transform(F.array_sort(F.collect_list(F.when((F.col("kind") == kind) & F.col("place").between(low, high), F.struct("place", "item")))), lambda x: x["item"])
    lists = ranked.groupBy("role").agg(
        of("skill", 1, top_skills).alias("common_skills"), of("keyword", 1, top_keywords).alias("common_keywords"), of("experience", 1, top_experience).alias("common_experience_patterns"),
        of("skill", top_skills + 1, top_skills + more).alias("following"),
    )
    leaders = items.where("kind = 'skill'").groupBy("item").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "item").limit(top_skills + 2 * more)
    leaders = leaders.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "item"))).alias("leaders"))  # one row of a fixed number of skills
    out = able.join(lists, "role", "left").crossJoin(F.broadcast(leaders))
    empty = F.array().cast("array<string>")
    has = {c: F.coalesce(c, empty) for c in ("common_skills", "common_keywords", "common_experience_patterns", "following")}
    fallback = F.filter(F.transform("leaders", lambda x: x["item"]), lambda x: ~F.array_contains(F.concat(has["common_skills"], has["following"]), x))
    return out.select(
        F.col("role").alias("role_name"), "job_count", *[has[c].alias(c) for c in ("common_skills", "common_keywords", "common_experience_patterns")],
        F.slice(F.concat(has["following"], fallback), 1, more).alias("recommended_next_skills"),
    )
