"""Titles, families and tags with vocabularies as tables (name, alias, nth), of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import titles
from ..functions.text import match_key, squeeze
from .dictionary import contained, first_contained, longest_contained, most_contained


def canonical_titles(df: DataFrame, keys: list[str], title: Column, synonyms: DataFrame, keywords: DataFrame) -> DataFrame:
    """``keys``, surface, canonical: the readable title and its role, which is that of the longest synonym in the title without
    seniority (an equal one is the longest), else of the first keyword rule, else the readable title. Aliases are compared as
    they are given: lower case, without accents. Null titles have an empty surface."""
    key = squeeze(F.regexp_replace(match_key(title), titles.SENIORITY, " "))
    rows = df.select(*keys, titles.title_surface(title).alias("surface"), key.alias("_key"))
    by_synonym = longest_contained(rows, "_key", synonyms).select("_key", F.col("name").alias("_s"))
    by_keyword = first_contained(rows, "_key", keywords).select("_key", F.col("name").alias("_k"))
    out = rows.join(by_synonym, "_key", "left").join(by_keyword, "_key", "left")
    return out.select(*keys, "surface", F.coalesce("_s", "_k", "surface").alias("canonical"))


def families(df: DataFrame, key: str, title: Column, description: Column, of_titles: DataFrame, hints: DataFrame) -> DataFrame:
    """``key``, family, source: the first family one of whose words is in the title wins over the one with the most hints in the
    description; source says which decided, or that both agree."""
    rows = df.select(key, match_key(title).alias("_title"), match_key(description, long=True).alias("_text"))
    by_title = first_contained(rows, "_title", of_titles).withColumnRenamed("name", "_t")
    by_text = most_contained(rows, key, "_text", hints).select(key, F.col("name").alias("_d"))
    out = rows.select(key, "_title").join(by_title, "_title", "left").join(by_text, key, "left")
    chosen = titles._family_source(F.coalesce("_t", F.lit("unknown")), F.coalesce("_d", F.lit("unknown")))
    return out.select(key, chosen.alias("f")).select(key, "f.family", "f.source")


def structured_tags(df: DataFrame, key: str, tags: Column, roles: DataFrame, domains: DataFrame, specialties: DataFrame) -> DataFrame:
    """``key``, parts, roles, domains, specialties, model_text, canonical_text of a tag field with parts between ; and line ends.

    A part's role is that of the longest key outside its parentheses, else inside them; roles are distinct in order of parts.
    The domain is the longest one named anywhere, specialties all that are, longest first."""
    base = df.select(key, titles.tag_parts(tags).alias("parts"), match_key(F.replace(F.coalesce(tags, F.lit("")), F.lit(";"), F.lit(" "))).alias("_all"))
    part = base.select(key, F.posexplode("parts").alias("pos", "part"))
    part = part.withColumns({"_core": match_key(titles.without_parentheses(F.col("part"))), "_in": match_key(F.array_join(titles.in_parentheses(F.col("part")), " "))})
    core = longest_contained(part, "_core", roles).select("_core", F.col("name").alias("_c"))
    inner = longest_contained(part, "_in", roles).select("_in", F.col("name").alias("_i"))
    found = part.join(core, "_core", "left").join(inner, "_in", "left").withColumn("role", F.coalesce("_c", "_i")).where("role is not null")
    found = found.groupBy(key).agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("pos", "role"))), lambda x: x["role"])).alias("roles"))
    domain = longest_contained(base, "_all", domains).select("_all", F.array("name").alias("domains"))
    special = contained(base, "_all", specialties, "alias").groupBy("_all").agg(F.array_sort(F.collect_set(F.struct((-F.length("alias")).alias("less"), "alias"))).alias("_s"))
    out = base.join(found, key, "left").join(domain, "_all", "left").join(special.select("_all", F.col("_s.alias").alias("specialties")), "_all", "left")
    empty = F.array().cast("array<string>")
    lists = {c: F.coalesce(c, empty) for c in ("roles", "domains", "specialties")}
    text = F.array_join(F.array_distinct(F.concat(*lists.values())), " | ")
    return out.select(key, "parts", *[v.alias(k) for k, v in lists.items()], F.array_join("parts", ", ").alias("model_text"), text.alias("canonical_text"))
