"""Rules for job ads: pay, experience, deadlines, levels, work mode, education, employment, places.

All work on ``text.match_key`` of a field, so accents and case do not matter."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean_light, dedup_by, let, match_key, squeeze, strip_marks

# The words below must be these for the same labels to come out. Those of WORK_MODES and single words of LEVELS are whole words.
WORK_MODES = {
    "hybrid": [
        "hybrid", "hybird", "hybrid working", "linh hoat", "ket hop onsite va remote", "ket hop online va offline", "ket hop truc tiep va tu xa",
    ],
    "remote": [
        "remote", "wfh", "work from home", "fully remote", "lam viec tu xa", "lam viec online", "lam online", "lam viec tai nha", "tai nha",
    ],
    "onsite": [
        "onsite", "on site", "work onsite", "work on site", "in office", "tai van phong", "lam viec tai cong ty", "lam viec truc tiep",
        "lam viec co dinh tai vp",
    ],
}
#: A number of days a month or week, with or without "remote" before it, is hybrid work.
DAY_UNITS = ["days/month", "ngay/tu[a-z]*"]
EDUCATION = {
    "phd": ["tien si", "phd", "doctor", "doctoral"],
    "master": ["thac si", "master", "mba", "cao hoc"],
    "bachelor": ["dai hoc", "cu nhan", "bachelor", "university"],
    "college": ["cao dang", "college", "trung cap"],
    "high_school": ["trung hoc", "high school", "pho thong"],
}
EMPLOYMENT = {
    "full_time": ["toan thoi gian", "full time", "full-time", "fulltime", "chinh thuc"],
    "part_time": ["ban thoi gian", "part time", "part-time", "parttime"],
    "internship": ["thuc tap", "thuc tap sinh", "internship", "intern"],
    "contract": ["hop dong", "contract"],
    "freelance": ["freelance", "freelancer", "cong tac vien", "ctv", "cong tac"],
    "temporary": ["temporary", "thoi vu", "ngan han"],
}
LEVELS = {
    "director": ["director", "head", "giam doc"],
    "manager": ["manager", "truong phong", "pho phong", "quan ly", "giam sat"],
    "lead": ["lead", "leader", "team lead", "truong nhom"],
    "senior": ["senior", "sr", "cao cap", "chuyen vien cao cap"],
    "middle": ["middle", "mid", "mid senior", "middle senior"],
    "junior": ["junior", "jr", "nhan vien"],
    "fresher": ["fresher", "moi tot nghiep"],
    "intern": ["intern", "internship", "thuc tap", "thuc tap sinh"],
}
USD_RATE = 25_000
# Our own short list of cities; pass another mapping for more.
CITIES = {
    "Ha Noi": ["ha noi", "hanoi"], "Ho Chi Minh": ["ho chi minh", "hcm", "tphcm", "sai gon"], "Da Nang": ["da nang", "danang"],
    "Hai Phong": ["hai phong"], "Can Tho": ["can tho"], "Berlin": ["berlin"], "Paris": ["paris"], "Madrid": ["madrid"], "London": ["london"],
}


def _first_rule(rules: dict[str, Column], default: str = "unknown") -> Column:
    out = None
    for name, test in rules.items():
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(default)


def any_of(key: Column, words: list[str]) -> Column:
    test = F.lit(False)
    for w in words:
        test = test | F.contains(key, F.lit(w))
    return test


def phrases(words: list[str], *more: str, loose: bool = False) -> str:
    """A pattern for any of ``words`` as whole words, longer ones first, or of the patterns ``more``. With ``loose`` a phrase of
    several words may end inside a longer word."""
    guard = lambda w: re.escape(w) if loose and " " in w else rf"\b{re.escape(w)}\b"
    return "|".join([*map(guard, sorted(words, key=len, reverse=True)), *more])


def mode_patterns() -> dict[str, str]:
    """A pattern for each work mode, in the order in which they are tried."""
    days = rf"\b(?:remote\s+)?\d+\s*(?:{'|'.join(DAY_UNITS)})\b"
    return {mode: phrases(words, days) if mode == "hybrid" else phrases(words) for mode, words in WORK_MODES.items()}


def work_mode(*texts: Column) -> Column:
    """hybrid, remote, onsite or unknown, the first of these whose words occur."""
    return let(match_key(F.concat_ws(" ", *texts)), lambda key: _first_rule({m: key.rlike(p) for m, p in mode_patterns().items()}))


def work_mode_source(*texts: Column) -> Column:
    """The words that decided ``work_mode``, null if none."""
    return let(match_key(F.concat_ws(" ", *texts)), lambda key: F.coalesce(*[F.when(key.rlike(p), F.regexp_extract(key, p, 0)) for p in mode_patterns().values()]))


def education_level(x: Column) -> Column:
    """The highest level mentioned."""
    return let(match_key(x), lambda key: _first_rule({level: any_of(key, ws) for level, ws in EDUCATION.items()}))


def employment_type(x: Column) -> Column:
    return let(match_key(x), lambda key: _first_rule({t: any_of(key, ws) for t, ws in EMPLOYMENT.items()}))


def level_from_text(x: Column) -> Column:
    return let(match_key(x), lambda key: _first_rule({level: key.rlike(phrases(words, loose=True)) for level, words in LEVELS.items()}))


def level_from_experience(years: Column) -> Column:
    """By the least years asked for; null years are unknown (not senior)."""
    return F.when(years.isNull(), "unknown").when(years <= 0.5, "fresher").when(years < 2.5, "junior").when(years < 4, "middle").otherwise("senior")


def job_level(title: Column, min_years: Column, raw: Column) -> Column:
    """(level, source): the title decides, else the years, else the raw level."""
    by = {"title": level_from_text(title), "experience_min_years": level_from_experience(min_years), "job_level_raw": level_from_text(raw)}
    level, source = F.lit("unknown"), F.lit("unknown")
    for name, value in reversed(by.items()):
        level = F.when(value != "unknown", value).otherwise(level)
        source = F.when(value != "unknown", name).otherwise(source)
    return F.struct(level.alias("level"), source.alias("source"))


def number(token: Column, compat: bool = False) -> Column:
    """A number with separators. One comma or dot is decimal, unless three digits follow it and it groups thousands
    (``compat`` takes it as decimal even then)."""
    commas, dots = (F.length(token) - F.length(F.replace(token, F.lit(c), F.lit(""))) for c in (",", "."))
    grouped = token.rlike(r"^\d{1,3}([.,]\d{3})+$") if not compat else F.lit(False)
    plain = (
        F.when((commas > 0) & (dots > 0) & ~grouped, F.translate(F.replace(token, F.lit("."), F.lit("")), ",", "."))
        .when((dots > 1) | (commas > 1) | grouped, F.regexp_replace(token, "[.,]", ""))
        .otherwise(F.translate(token, ",", "."))
    )
    return plain.try_cast("double")


def pay_bucket(low: Column, high: Column, negotiable: Column) -> Column:
    ref = F.coalesce(high, low)
    return (
        F.when(negotiable, "negotiable").when(ref.isNull(), "unknown").when(ref < 10_000_000, "under_10m").when(ref < 20_000_000, "10m_20m")
        .when(ref < 30_000_000, "20m_30m").when(ref < 50_000_000, "30m_50m").otherwise("50m_plus")
    )


def parse_pay(raw: Column, compat: bool = False) -> Column:
    """(clean, type, negotiable, low, high, bucket), in VND a month. Numbers take thousands groups whole;
    with ``compat`` a number has one separator at most."""
    text = squeeze(F.replace(F.lower(clean_light(raw)), F.lit("thoả"), F.lit("thỏa")))
    return let(text, lambda t: _pay(t, compat))


def _pay(text: Column, compat: bool) -> Column:
    pattern = r"\d+(?:[.,]\d+)?" if compat else r"\d+(?:[.,]\d+)*"
    nums = F.filter(F.transform(F.regexp_extract_all(text, F.lit(f"({pattern})")), lambda t: number(t, compat)), lambda v: v.isNotNull())
    usd = text.rlike(r"usd|\$")
    scale = F.when(usd, float(USD_RATE)).when(text.rlike(r"triệu|trieu|\b\d+(?:[.,]\d+)?\s*tr\b"), 1e6).when(text.rlike(r"nghìn|ngan|\b\d+(?:[.,]\d+)?\s*k\b"), 1e3).otherwise(1.0)
    negotiable = F.contains(text, F.lit("thỏa thuận")) | F.contains(text, F.lit("negotiable"))
    first, second, n = F.get(nums, F.lit(0)) * scale, F.get(nums, F.lit(1)) * scale, F.size(nums)
    upper = text.rlike("up ?to|tối đa")
    kind = (
        F.when(text == "", "unknown").when(negotiable & (n == 0), "negotiable").when(upper, F.when(n > 0, "upper_bound").otherwise("unknown"))
        .when(n >= 2, "range").when(n == 1, "fixed").otherwise("unknown")
    )
    low = F.when(kind.isin("range", "fixed"), first)
    high = F.when(kind.isin("upper_bound", "fixed"), first).when(kind == "range", second)
    flag = F.when(text != "", negotiable)
    return F.struct(text.alias("clean"), kind.alias("type"), flag.alias("negotiable"), low.alias("low"), high.alias("high"), pay_bucket(low, high, F.coalesce(flag, F.lit(False))).alias("bucket"))


def parse_experience(raw: Column, compat: bool = False) -> Column:
    """(low, high, type) in years. By default "a - b years" is a range; with ``compat`` only a range with a unit on both
    sides is, and the last number of others decides."""
    return let(match_key(raw), lambda t: _experience(t, compat))


def _experience(text: Column, compat: bool) -> Column:
    num, unit = r"(\d+(?:\.\d+)?)", r"(thang|months?|nam|years?)"
    both = rf"{num}\s*{unit}\s*(?:-|den|toi|to)\s*{num}\s*{unit}"
    short = rf"{num}\s*(?:-|den|toi|to)\s*{num}\s*{unit}"
    one = rf"{num}\s*(\+)?\s*{unit}"

    def years(value: Column, name: Column) -> Column:
        return F.when(name.rlike("^(thang|month)"), value.try_cast("double") / 12).otherwise(value.try_cast("double"))

    def part(p: str, i: int) -> Column:
        return F.regexp_extract(text, p, i)

    a, b = years(part(both, 1), part(both, 2)), years(part(both, 3), part(both, 4))
    c, d = years(part(short, 1), part(short, 3)), years(part(short, 2), part(short, 3))
    v = years(part(one, 1), part(one, 3))
    none = text.rlike("khong (yeu cau|can kinh nghiem|co kinh nghiem)|no experience")
    is_both, is_short, is_one = text.rlike(both), F.lit(False) if compat else text.rlike(short), text.rlike(one)
    least = text.rlike(r"\b(tu|tren|hon|it nhat|toi thieu|at least|over|from) ") | (part(one, 2) == "+")
    most = text.rlike(r"\b(duoi|toi da|under|less than) ")
    kind = F.when(none, "no_experience").when(is_both | is_short, "range").when(is_one & least, "minimum").when(is_one & most, "maximum").when(is_one, "fixed").otherwise("unknown")
    low = F.when(none, 0.0).when(is_both, F.least(a, b)).when(is_short, F.least(c, d)).when(kind == "maximum", 0.0).when(is_one, v)
    high = F.when(none, 0.0).when(is_both, F.greatest(a, b)).when(is_short, F.greatest(c, d)).when(kind.isin("maximum", "fixed"), v)
    return F.struct(low.alias("low"), high.alias("high"), kind.alias("type"))


def parse_deadline(raw: Column, ref: Column) -> Column:
    """(date, days, type, expired): a date day/month/year, else a number of days from ``ref``."""
    return let(match_key(raw), lambda t: _deadline(t, ref))


def _deadline(text: Column, ref: Column) -> Column:
    p = r"(\d{1,2})[/-](\d{1,2})[/-](\d{4}|\d{2})"
    year = F.when(F.length(F.regexp_extract(text, p, 3)) == 2, F.concat(F.lit("20"), F.regexp_extract(text, p, 3))).otherwise(F.regexp_extract(text, p, 3))
    iso = F.concat_ws("-", year, F.lpad(F.regexp_extract(text, p, 2), 2, "0"), F.lpad(F.regexp_extract(text, p, 1), 2, "0"))
    fixed = F.when(text.rlike(p), iso.try_cast("date"))
    span = F.regexp_extract(text, r"(\d+)\s*(?:ngay|days?)", 1).try_cast("int")
    date = F.coalesce(fixed, F.date_add(ref, span))
    kind = F.when(fixed.isNotNull(), "date").when(span.isNotNull(), "relative_days").otherwise("unknown")
    return F.struct(date.alias("date"), F.date_diff(date, ref).alias("days"), kind.alias("type"), (date < ref).alias("expired"))


def cities(x: Column, vocabulary: dict[str, list[str]] | None = None) -> Column:
    """The cities named, in vocabulary order."""

    def found(key: Column) -> Column:
        return F.array(*[F.when(key.rlike(rf"(?<![a-z0-9])({'|'.join(names)})(?![a-z0-9])"), city) for city, names in (vocabulary or CITIES).items()])

    return F.filter(let(match_key(x), found), lambda c: c.isNotNull())


def city_text(x: Column) -> Column:
    """The cities joined by a comma; null if none is named."""
    return F.nullif(F.array_join(cities(x), ", "), F.lit(""))


def clean_address(x: Column) -> Column:
    """Without remarks about other places and editorial notes."""
    t = F.regexp_replace(clean_light(x), r"(?i)\((?:tất cả[^)]*|đã được cập nhật[^)]*|all wards[^)]*|updated[^)]*)\)", " ")
    t = F.regexp_replace(t, r"(?i)(?:và|and) \d+ (?:địa điểm khác|other places?|nơi khác)", " ")
    return squeeze(F.regexp_replace(t, r"\s+,", ","))


def split_addresses(x: Column, vocabulary: dict[str, list[str]] | None = None) -> Column:
    """The parts of a text, between ; | and line ends, that begin with a city and a colon; others are dropped."""
    names = "|".join(n for ns in (vocabulary or CITIES).values() for n in ns)
    parts = F.filter(F.split(clean_address(x), r"\s*[;|\n]\s*"), lambda p: p != "")
    labelled = F.filter(parts, lambda p: strip_marks(p).rlike(rf"^(?:{names})\s*:"))
    tidy = F.transform(labelled, lambda p: F.regexp_replace(F.trim(p), r"[\s,;|]+$", ""))
    with_more = F.filter(tidy, lambda p: ~p.rlike(r":\s*$"))
    return dedup_by(with_more, lambda p: strip_marks(p))


def parse_address(x: Column) -> Column:
    """(parts, text, city, is_multi)."""
    parts, found = split_addresses(x), cities(x)
    return F.struct(parts.alias("parts"), F.array_join(parts, " | ").alias("text"), city_text(x).alias("city"), ((F.size(parts) >= 2) | (F.size(found) >= 2)).alias("is_multi"))


def experience_pattern(x: Column) -> Column:
    """For profiles: No requirement, <1 year, n years, else the first 32 characters, else Unknown."""
    key = match_key(x)
    n = F.regexp_extract(key, r"(\d+)\s*(?:nam|years?)", 1)
    return (
        F.when(key == "", "Unknown").when(key.rlike("khong yeu cau|no experience|no requirement"), "No requirement")
        .when(key.rlike(r"(duoi|under|less than) 1 (nam|year)"), "<1 year").when(n != "", F.concat(n, F.lit(" years"))).otherwise(F.left(F.trim(x), F.lit(32)))
    )


def years_number(x: Column) -> Column:
    """The first number of a text, 0 if there is none."""
    return F.coalesce(F.regexp_extract(F.coalesce(x, F.lit("")), r"(\d+(?:[.,]\d+)?)", 1).try_cast("double"), F.lit(0.0))


def pay_brief(low: Column, high: Column) -> Column:
    """Whole numbers with thousands separators."""
    f = lambda v: F.format_number(v, 0)
    return (
        F.when(low.isNotNull() & high.isNotNull(), F.when(low == high, f(low)).otherwise(F.concat(f(low), F.lit(" - "), f(high))))
        .when(low.isNotNull(), F.concat(F.lit("from "), f(low))).when(high.isNotNull(), F.concat(F.lit("up to "), f(high))).otherwise("")
    )


def plain_number(v: Column) -> Column:
    """Without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(v.cast("decimal(18,4)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def experience_brief(low: Column, high: Column) -> Column:
    n = plain_number
    return (
        F.when((low == 0) & (high == 0), "no experience required").when(low.isNotNull() & high.isNotNull() & (low == high), F.concat(n(low), F.lit(" years")))
        .when(low.isNotNull() & high.isNotNull(), F.concat(n(low), F.lit("-"), n(high), F.lit(" years")))
        .when(low.isNotNull(), F.concat(F.lit("from "), n(low), F.lit(" years"))).when(high.isNotNull(), F.concat(F.lit("up to "), n(high), F.lit(" years"))).otherwise("")
    )
