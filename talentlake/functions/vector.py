"""Vectors as arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalize(a: Column) -> Column:
    """Of length one; the zero vector stays zero."""
    return let(F.greatest(norm(a), F.lit(1e-12)), lambda n: F.transform(doubles(a), lambda x: x / n))


def mean_pool(vectors: Column, mask: Column) -> Column:
    """The mean of those of ``vectors`` (an array of equally long ones) whose place in ``mask`` is not 0; null if there is none."""
    seen = F.filter(F.zip_with(vectors, mask, lambda v, m: F.struct(v.alias("v"), m.alias("m"))), lambda x: x["m"] != 0)
    total = F.aggregate(F.slice(seen, F.lit(2), F.greatest(F.size(seen) - 1, F.lit(0))), doubles(F.get(seen, F.lit(0))["v"]), lambda s, x: F.zip_with(s, doubles(x["v"]), lambda a, b: a + b))
    return let(F.size(seen).cast("double"), lambda n: F.transform(total, lambda x: x / n))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-12))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1.0 - cosine(a, b)


def blend(a: Column, b: Column, weight: float = 0.55) -> Column:
    """``weight`` of a and the rest of b, as long as the shorter one."""
    n = F.least(F.size(a), F.size(b))
    return F.zip_with(F.slice(doubles(a), F.lit(1), n), F.slice(doubles(b), F.lit(1), n), lambda x, y: weight * x + (1 - weight) * y)


def percent(distance: Column) -> Column:
    """Compatibility from a distance: 0 to 100, two places."""
    return F.bround(F.least(F.greatest((1.0 - distance) * 100.0, F.lit(0.0)), F.lit(100.0)), 2)


def hash_encode(text: Column, size: int = 64) -> Column:
    """A deterministic stand-in for an encoder: words are counted into hashed places, with a hashed sign, and the vector is
    brought to length one. The same text has the same vector everywhere."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    hashed = F.transform(words, lambda w: F.struct(F.pmod(F.xxhash64(w), F.lit(size)).alias("at"), F.when(F.pmod(F.hash(w), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("sign")))
    counts = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.aggregate(F.filter(hashed, lambda h: h["at"] == k), F.lit(0.0), lambda a, h: a + h["sign"]))
    length = lambda v: F.greatest(F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, y: a + y * y)), F.lit(1e-12))
    unit = lambda s: F.transform(s["v"], lambda x: x / s["n"])
    return let(let(counts, lambda v: F.struct(v.alias("v"), length(v).alias("n"))), unit)
