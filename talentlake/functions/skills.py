"""Skill mentions: one pattern per skill, guards instead of word boundaries, importance by the words around."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, match_key

# Words that say how much a skill matters, without accents.
PREFERRED = ("preferred", "nice to have", "uu tien", "loi the", "plus", "bonus")
REQUIRED = ("required", "must have", "bat buoc", "yeu cau", "can co", "thanh thao")
RANK = {"preferred": 3, "required": 2, "mentioned": 1}


def alias_pattern(aliases: list[str], compat: bool = False) -> str:
    """Any of ``aliases``, not inside a longer word; works for names such as c++, c# and .net. ``compat`` asks for word
    boundaries instead, which names that begin or end with a sign hardly ever have."""
    body = "|".join(re.escape(a) for a in sorted(aliases, key=len, reverse=True))
    if compat:
        return rf"(?U)\b(?:{body})\b"
    return rf"(?U)(?<![\w])(?:{body})(?![\w])"


def skills_in(key: Column, vocabulary: dict[str, list[str]], compat: bool = False) -> Column:
    """The skills named in a normalised text, in vocabulary order."""
    every = alias_pattern([a for aliases in vocabulary.values() for a in aliases], compat)
    each = lambda k: F.array(*[F.when(k.rlike(alias_pattern(a, compat)), F.lit(s)) for s, a in vocabulary.items()])
    found = let(key, lambda k: F.when(k.rlike(every), each(k)).otherwise(F.array().cast("array<string>")))
    return F.filter(found, lambda s: s.isNotNull())


def split_segments(text: Column) -> Column:
    """Sentences of a list-like text: line ends, bullets, dashes between spaces, semicolons."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"(?m)[\n•;]|\s-\s|^-\s"), lambda s: F.trim(s)), lambda s: s != "")


def importance(segment_key: Column, source_field: Column) -> Column:
    """preferred hints, then the requirements field, then required hints, else mentioned."""
    hit = lambda words: segment_key.rlike(rf"\b(?:{'|'.join(words)})\b")
    return F.when(hit(PREFERRED), "preferred").when(source_field == "requirements", "required").when(hit(REQUIRED), "required").otherwise("mentioned")


def mention_ratio(text: Column, words: Column) -> Column:
    """The share of ``words`` that occur in ``text``; 0 without words."""
    hits = let(match_key(text), lambda key: F.size(F.filter(words, lambda w: F.contains(key, match_key(w)))))
    return F.coalesce(F.try_divide(hits.cast("double"), F.nullif(F.size(words), F.lit(0))), F.lit(0.0))
