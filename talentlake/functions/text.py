"""Cleaning and normalising text: functions from columns to columns, all JVM-side but ``nfc``."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Tokens that mean "no value", and glyphs that count as a dash.
EMPTY_TOKENS = (
    "nan", "none", "null", "n/a", "na", "-", "--", "---",
    "không", "không rõ", "chưa rõ", "chưa cập nhật", "đang cập nhật",
    "not specified", "unknown",
)
DASHES = "–—−•●▪►✅✔"
VIETNAMESE = "ăâêôơưđàáạảãèéẹẻẽìíịỉĩòóọỏõùúụủũỳýỵỷỹ"
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}

#: Lower-case letters with marks and what they are without; đ counts as d.
_MARKED = {
    "a": "àáâãäåăắằẳẵặấầẩẫậạảā", "e": "èéêëếềểễệẹẻẽē", "i": "ìíîïỉĩịī", "o": "òóôõöốồổỗộơớờởỡợọỏō", "u": "ùúûüưứừửữựụủũū",
    "y": "ýÿỳỵỷỹ", "c": "ç", "n": "ñ", "d": "đ",
}
_FROM = "".join(_MARKED.values())
_TO = "".join(k * len(v) for k, v in _MARKED.items())
#: What keys for comparing are made of, inside a class of a pattern.
_KEY = r"a-z0-9_/+\-#.\w"


def let(x: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``x``, with ``x`` standing in the expression once: what a rule uses many times is computed once, and
    rules can be nested without their expressions growing by the product of their uses."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def ascii_only(x: Column) -> Column:
    """Whether all characters are of one byte."""
    return F.octet_length(x) == F.length(x)


def where_any(x: Column, marks: Sequence[str], body: Callable[[Column], Column], long: bool = True) -> Column:
    """``body`` of ``x`` where that contains one of ``marks``, else ``x`` as it is: looking for a few fixed texts is far cheaper than a pattern,
    and most texts have nothing to change. Not ``long``: always ``body``, which must then leave such texts alone, as it does not nest a rule deeper."""

    def gated(t: Column) -> Column:
        met = F.contains(t, F.lit(marks[0]))
        for mark in marks[1:]:
            met = met | F.contains(t, F.lit(mark))
        if not any(map(str.isascii, marks)):
            met = ~ascii_only(t) & met
        return F.when(met, body(t)).otherwise(t)

    return let(x, gated) if long else body(x)


def norm_empty(x: Column) -> Column:
    """Trimmed text, null if it is blank or only says that there is no value."""
    usable = lambda t: (F.length(t) > 2 * max(map(len, EMPTY_TOKENS))) | ((t != "") & ~F.lower(t).isin(*EMPTY_TOKENS))  # noqa: E731  a long text is not lower-cased for that
    return let(F.trim(x), lambda t: F.when(usable(t), t))


def safe(x: Column) -> Column:
    """``norm_empty`` with the empty text for null."""
    return F.coalesce(norm_empty(x), F.lit(""))


def first_usable(*xs: Column) -> Column:
    """The first of some columns that has a value."""
    return F.coalesce(*[norm_empty(x) for x in xs])


@F.pandas_udf(StringType())
def nfc(x: pd.Series) -> pd.Series:
    """Unicode composition; needed only where the data is not composed yet."""
    return x.str.normalize("NFC")


def squeeze(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"(?U) \s+|[^\S ]\s*", " "))  # single spaces match nothing


def squeeze_lower(x: Column) -> Column:
    """Lower case, trimmed, single spaces; null is empty."""
    return squeeze(F.lower(F.coalesce(x, F.lit(""))))


def remove_html(x: Column, long: bool = False) -> Column:
    """Common entities decoded, line and paragraph ends as newlines, other tags as spaces."""

    def decoded(t: Column) -> Column:
        for entity, char in ENTITIES.items():
            t = F.replace(t, F.lit(entity), F.lit(char))
        return t

    tags = lambda t: F.regexp_replace(F.regexp_replace(t, r"(?i)<br\s*/?>|</p\s*>", "\n"), r"<[^>]+>", " ")
    return where_any(where_any(safe(x), ["&"], decoded, long), ["<"], tags)


def normalize_dash(x: Column, long: bool = False) -> Column:
    return where_any(safe(x), DASHES, lambda t: F.translate(t, DASHES, "-" * len(DASHES)), long)


def strip_marks(x: Column, long: bool = False) -> Column:
    """Lower case without accents."""
    marks = lambda t: F.translate(t, _FROM, _TO)
    return let(F.lower(x), lambda t: F.when(ascii_only(t), t).otherwise(marks(t))) if long else marks(F.lower(x))


def dedup_list(xs: Column) -> Column:
    """Elements in first-seen order, blanks dropped."""
    return F.array_distinct(F.filter(F.transform(xs, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))


def heads(pairs: Column) -> Column:
    """Of structs (k, v) the first of each key, in order, with whether it is: structs (i, k, v, first). Sorted by key and place,
    a first one is where the key changes, so a list of n costs n log n."""
    placed = F.transform(pairs, lambda p, i: F.struct(p["k"].alias("k"), i.alias("i"), p["v"].alias("v")))
    marked = lambda s: F.transform(s, lambda p, j: F.struct(p["i"].alias("i"), p["k"].alias("k"), p["v"].alias("v"), ((j == 0) | ~F.get(s, j - 1)["k"].eqNullSafe(p["k"])).alias("first")))
    return F.sort_array(let(F.sort_array(placed), marked))  # unlike array_sort it has no comparison of Spark expressions


def dedup_by(xs: Column, key) -> Column:
    """The first element of each key, in order; ``key`` makes a column from an element. Elements with a null key go."""
    pairs = F.transform(xs, lambda x: F.struct(key(x).alias("k"), x.alias("v")))
    return F.transform(F.filter(heads(pairs), lambda e: e["first"] & e["k"].isNotNull()), lambda e: e["v"])


def dedup_lines(x: Column, shortest: int = 12, long: bool = False) -> Column:
    """Stripped lines without blank ones; a line of ``shortest`` characters or more that was there before goes."""

    def deduped(t: Column) -> Column:
        lines = F.filter(F.transform(F.split(t, "\n"), lambda line: F.trim(line)), lambda line: line != "")
        pairs = F.transform(lines, lambda line: F.struct(F.regexp_replace(F.lower(line), r" \s+|[^\S ]\s*", " ").alias("k"), line.alias("v")))
        kept = F.filter(heads(pairs), lambda e: (F.length(e["k"]) < shortest) | e["first"])
        return F.array_join(F.transform(kept, lambda e: e["v"]), "\n")

    return where_any(F.trim(x), ["\n"], deduped, long)


def truncate_words(x: Column, n: int) -> Column:
    """The first ``n`` words."""
    return F.array_join(F.slice(F.split(squeeze(F.coalesce(x, F.lit(""))), " "), 1, n), " ")


def first_words(x: Column, n: int) -> Column:
    """The first ``n`` words between runs of blank, tab, line end or form feed; spaces of any kind go from both ends. Other white space
    stays, null stays null."""
    one_line = F.regexp_replace(F.regexp_replace(x, r"[ \t\n\f\r]+", " "), r"^\p{Zs}+|\p{Zs}+\z", "")
    return F.array_join(F.slice(F.split(one_line, " "), 1, n), " ")


def clean_light(x: Column, long: bool = False) -> Column:
    """Markup, dashes, zero-width characters and blank space tidied, repeated long lines dropped. ``long``, here and below, is for columns of whole
    texts: each pattern is tried only where there is something for it. The result is the same."""
    t = F.replace(normalize_dash(remove_html(x, long), long), F.lit("\\n"), F.lit("\n"))
    t = where_any(t, "​‌‍﻿", lambda t: F.regexp_replace(t, "[​‌‍﻿]", ""), long)
    t = where_any(t, ["  ", "\t", "\x0b", "\f", "\r", "\xa0"], lambda t: F.regexp_replace(t, r" [ \t\x0B\f\r ]+|[\t\x0B\f\r ][ \t\x0B\f\r ]*", " "), long)  # single spaces match nothing
    t = where_any(t, ["\n\n\n", " \n", "\n "], lambda t: F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r" +\n *|\n +", "\n"), long)
    return dedup_lines(F.trim(t), long=long)


def clean_structure(x: Column) -> Column:
    """``clean_light`` with list marks at line starts made alike."""
    return F.regexp_replace(clean_light(x), r"(?m)^[-*+] *", "- ")


def clean_strict(x: Column) -> Column:
    """Lower case, word characters and / + - # . only, on one line."""
    return squeeze(F.regexp_replace(F.lower(clean_light(x)), r"(?U)[^\w\s/+\-#.]", " "))


def clean_model(x: Column) -> Column:
    """For encoders: punctuation that carries meaning and line ends stay, repeated lines too."""
    t = F.replace(normalize_dash(remove_html(x)), F.lit("\\n"), F.lit("\n"))
    t = F.regexp_replace(t, r"(?U)[^\w\s.,;:/\-+#()%]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[ \t\x0B\f\r ]+", " "), r" *\n[ \n]*", "\n"))


def plain_key(x: Column, long: bool = False) -> Column:
    """``match_key`` of text that is clean already."""
    # Blank space and what else is no part of a key, in one pass; a single space stays. Letters and digits stand first, as \w is slow.
    return F.trim(F.regexp_replace(strip_marks(x, long), rf"(?U)[^{_KEY}](?:[^{_KEY}]+|(?<! ))", " "))


def match_key(x: Column, long: bool = False) -> Column:
    """For comparing: ``clean_light`` without accents, lower case, word characters and / + - # . only."""
    return plain_key(clean_light(x, long), long)


def language_type(x: Column) -> Column:
    """empty, vi, en, mixed or other, by the letters that occur."""

    def kind(t: Column) -> Column:
        vi, en = t.rlike(f"[{VIETNAMESE}]"), t.rlike("[a-z]")
        return F.when(t == "", "empty").when(vi & en, "mixed").when(vi, "vi").when(en, "en").otherwise("other")

    return let(F.lower(safe(x)), kind)


def alias_key(x: Column) -> Column:
    return F.replace(squeeze_lower(x), F.lit("–"), F.lit("-"))


def role_name(x: Column) -> Column:
    """Words apart at _ and -, each with a capital."""
    return F.initcap(squeeze(F.translate(F.lower(F.coalesce(x, F.lit(""))), "_-", "  ")))


def slug(x: Column) -> Column:
    """Lower-case ASCII letters and digits, everything else one underscore."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def ascii_key(x: Column) -> Column:
    """Without accents, everything but letters and digits one space."""
    return F.trim(F.regexp_replace(strip_marks(F.coalesce(x, F.lit(""))), "[^a-z0-9]+", " "))


def normalize_url(x: Column) -> Column:
    """Without query and trailing slashes."""
    return F.regexp_replace(F.split_part(F.trim(F.coalesce(x, F.lit(""))), F.lit("?"), F.lit(1)), "/+$", "")


def preview(x: Column, n: int = 220) -> Column:
    """At most ``n`` characters, the last three dots where it was cut."""
    return F.when(F.length(x) > n, F.concat(F.left(x, F.lit(n - 3)), F.lit("..."))).otherwise(x)


def excerpt(x: Column, n: int = 300) -> Column:
    return F.left(F.coalesce(x, F.lit("")), F.lit(n))


def parse_list(x: Column, separators: tuple[str, ...] = ("|", ",")) -> Column:
    """A list from a JSON list, the values of a JSON object, or separated text; blanks dropped."""
    t = F.trim(F.coalesce(x, F.lit("")))
    json = F.when(t.startswith("[") & t.endswith("]"), F.from_json(t, "array<string>"))
    values = F.when(t.startswith("{") & t.endswith("}"), F.map_values(F.from_json(t, "map<string,string>")))
    plain = F.array(t)
    for s in reversed(separators):
        plain = F.when(F.contains(t, F.lit(s)), F.split(t, f"[{s}]")).otherwise(plain)
    return F.filter(F.transform(F.coalesce(json, values, plain), lambda e: F.trim(e)), lambda e: e != "")


def clean_list(x: Column) -> Column:
    """Text split at , ; | and line ends; entries that say nothing dropped, the first of each spelling kept."""
    parts = F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), r"[,\n;|]"), lambda e: norm_empty(e)), lambda e: e.isNotNull())
    return dedup_by(parts, lambda e: F.lower(e))
