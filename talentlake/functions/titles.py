"""Job titles: noise removal, canonical titles, job families; and structured tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean_light, dedup_by, let, match_key, squeeze

# Our own compact vocabularies; every function takes others.
SENIORITY = r"\b(senior|junior|middle|fresher|intern|lead|sr|jr|principal|head of)\b"
KEEP_IN_BRACKETS = ("java", "python", "sql", "data", "cloud", "web", "mobile", "test", "ai", "net", "devops")
NOISE_SEGMENT = r"^(hot|urgent|tuyen gap|gap|remote|onsite|hybrid|full time|part time|ha noi|hcm|up to.*|luong.*|salary.*|\d+ (slots?|nguoi).*|di lam ngay)$"
SYNONYMS = {
    "data analyst": "Data Analyst", "bi analyst": "Data Analyst", "data engineer": "Data Engineer", "etl developer": "Data Engineer",
    "data scientist": "Data Scientist", "machine learning engineer": "AI Engineer", "ai engineer": "AI Engineer", "backend developer": "Backend Developer",
    "java developer": "Backend Developer", "frontend developer": "Frontend Developer", "react developer": "Frontend Developer",
    "mobile developer": "Mobile Developer", "qa engineer": "Tester", "tester": "Tester", "devops engineer": "DevOps Engineer",
    "business analyst": "Business Analyst", "product owner": "Product Owner", "project manager": "Project Manager",
    "database administrator": "Database Administrator", "product analyst": "Data Analyst",
}
KEYWORDS = {"Data Engineer": ["data pipeline", "big data"], "Tester": ["kiem thu", "test"], "Backend Developer": ["backend", "java", ".net"], "Frontend Developer": ["frontend", "react"]}
FAMILIES = {
    "data_analytics": ["data analyst", "product analyst"], "data_engineering": ["data engineer", "database administrator"], "data_science": ["data scientist", "ai engineer"],
    "software": ["developer"], "quality": ["tester"], "operations": ["devops"], "business": ["business analyst", "product owner", "project manager"],
}
FAMILY_HINTS = {"data_analytics": ["dashboard", "report", "insight"], "data_engineering": ["pipeline", "warehouse", "etl"], "software": ["api", "backend", "frontend"], "quality": ["test case", "automation test"]}
ROLES = {"developer": "Developer", "engineer": "Engineer", "analyst": "Analyst", "tester": "Tester", "data analyst": "Data Analyst", "data engineer": "Data Engineer"}
DOMAINS = ["finance", "banking", "retail", "education", "health", "logistics", "e-commerce"]
SPECIALTIES = ["machine learning", "big data", "cloud", "security", "frontend", "backend", "mobile", "sql", "python", "java"]


def cut_noise(x: Column) -> Column:
    """Without pay, urgency, "from n years" and language cues, and what follows them."""
    return F.trim(F.regexp_replace(x, r"(?i)[\s,\-–|]*\b(lương|luong|salary|thu nhập|up to|upto|tuyển gấp|urgent|từ \d+ năm|from \d+ years?|tiếng (anh|nhật|trung)|english required)\b.*$", ""))


def clean_brackets(x: Column, keep: tuple[str, ...] = KEEP_IN_BRACKETS) -> Column:
    """Without bracketed parts, but for those that name a technology."""

    def clean(t: Column) -> Column:
        parts = F.regexp_extract_all(t, F.lit(r"(\([^()]*\)|\[[^\[\]]*\])"))
        drop = F.filter(parts, lambda p: ~match_key(p).rlike("|".join(rf"\b{k}\b" for k in keep)))
        return squeeze(F.aggregate(drop, t, lambda text, p: F.replace(text, p, F.lit(" "))))

    return let(x, clean)


def drop_codes(x: Column) -> Column:
    """Without internal posting codes such as [ABC-123] or #12345."""
    return squeeze(F.regexp_replace(x, r"\b[A-Z]{2,}[-_.]?\d{2,}\b|#\d+", " "))


def segments(x: Column) -> Column:
    """Parts of a title between dashes; noise and repeats (but for seniority) dropped, all kept if nothing else is left."""
    all_ = F.filter(F.transform(F.split(x, r"\s*[-–|]\s+|\s+[-–|]\s*"), lambda s: F.trim(s)), lambda s: s != "")

    def chosen(every: Column) -> Column:
        good = F.filter(every, lambda s: ~match_key(s).rlike(NOISE_SEGMENT))
        return let(good, lambda g: F.when(F.size(g) > 0, g).otherwise(every))

    return dedup_by(let(all_, chosen), lambda s: squeeze(F.regexp_replace(match_key(s), SENIORITY, " ")))


def display_title(x: Column) -> Column:
    """Spacing around / , + as in print."""
    return squeeze(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"\s*/\s*", "/"), r"\s*,\s*", ", "), r"\s+\+", "+"))


def title_surface(x: Column) -> Column:
    """The readable title: codes, brackets and noise out, segments joined by dashes."""
    return display_title(F.array_join(segments(drop_codes(clean_brackets(cut_noise(clean_light(x))))), " - "))


def longest_contained(key: Column, words: list[str]) -> Column:
    """The longest of ``words`` in ``key``; of equal lengths the one given first."""
    ordered = F.array(*[F.lit(w) for w in sorted(words, key=lambda w: -len(w))])
    return F.get(F.filter(ordered, lambda w: F.contains(key, w)), F.lit(0))


def canonical_title(x: Column, synonyms: dict[str, str] | None = None, keywords: dict[str, list[str]] | None = None) -> Column:
    """The role of a title: an exact synonym, else the longest synonym in it, else the first role with a keyword in it,
    else the title itself."""
    synonyms, keywords = synonyms or SYNONYMS, keywords or KEYWORDS
    table = F.create_map(*[F.lit(v) for kv in synonyms.items() for v in kv])

    def role(key: Column) -> Column:
        out = F.coalesce(F.try_element_at(table, key), F.try_element_at(table, F.coalesce(longest_contained(key, list(synonyms)), F.lit("\0"))))
        return F.coalesce(out, _keyword_rule(key, keywords, None))

    return F.coalesce(let(squeeze(F.regexp_replace(match_key(x), SENIORITY, " ")), role), title_surface(x))


def _keyword_rule(key: Column, rules: dict[str, list[str]], default: str | None) -> Column:
    """The first rule one of whose words is in ``key``."""
    out = F.lit(default).cast("string")
    for name, words in reversed(rules.items()):
        test = F.lit(False)
        for w in words:
            test = test | F.contains(key, F.lit(w))
        out = F.when(test, name).otherwise(out)
    return out


def family_from_title(title: Column, families: dict[str, list[str]] | None = None) -> Column:
    """The first family one of whose words is in the title."""
    return let(match_key(title), lambda key: _keyword_rule(key, families or FAMILIES, "unknown"))


def family_from_description(text: Column, hints: dict[str, list[str]] | None = None) -> Column:
    """The family with the most hints in a text; the first of equals, unknown without any."""

    def best(key: Column) -> Column:
        scored = []
        for i, (family, words) in enumerate((hints or FAMILY_HINTS).items()):
            n = sum((F.contains(key, F.lit(w)).cast("int") for w in words), F.lit(0))
            scored.append(F.struct(n.alias("n"), F.lit(-i).alias("order"), F.lit(family).alias("family")))
        return F.array_max(F.array(*scored))

    return let(let(match_key(text), best), lambda b: F.when(b["n"] > 0, b["family"]).otherwise("unknown"))


def job_family(title: Column, description: Column) -> Column:
    """(family, source): the title wins over the description."""
    both = F.struct(family_from_title(title).alias("t"), family_from_description(description).alias("d"))
    return let(both, lambda b: _family_source(b["t"], b["d"]))


def _family_source(t: Column, d: Column) -> Column:
    family = F.when(t != "unknown", t).otherwise(d)
    source = F.when((t != "unknown") & (t == d), "title+description").when((t != "unknown") & (d != "unknown"), "title_priority").when(t != "unknown", "title").when(d != "unknown", "description").otherwise("unknown")
    return F.struct(family.alias("family"), source.alias("source"))


def tag_parts(x: Column) -> Column:
    """Tags between ; and line ends, tidied."""
    return F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), r"[;\n]"), lambda t: squeeze(t)), lambda t: t != "")


def in_parentheses(x: Column) -> Column:
    return F.transform(F.regexp_extract_all(x, F.lit(r"\(([^()]*)\)")), lambda t: F.trim(t))


def without_parentheses(x: Column) -> Column:
    return squeeze(F.regexp_replace(x, r"\([^()]*\)", " "))


def tag_role(tag: Column, roles: dict[str, str] | None = None) -> Column:
    """The role of the longest key in the tag, looked for outside parentheses first."""
    roles = roles or ROLES
    table = F.create_map(*[F.lit(v) for kv in roles.items() for v in kv])
    core, inner = match_key(without_parentheses(tag)), match_key(F.array_join(in_parentheses(tag), " "))
    key = F.coalesce(longest_contained(core, list(roles)), longest_contained(inner, list(roles)))
    return F.when(key.isNotNull(), F.try_element_at(table, key))


def tags_structured(x: Column) -> Column:
    """(parts, roles, domains, specialties, model_text, canonical_text) of a tag field."""
    parts, keys = tag_parts(x), match_key(F.replace(F.coalesce(x, F.lit("")), F.lit(";"), F.lit(" ")))
    roles = F.array_distinct(F.filter(F.transform(parts, lambda t: tag_role(t)), lambda r: r.isNotNull()))
    by_length = lambda ws: F.filter(F.array(*[F.lit(w) for w in sorted(ws, key=lambda w: -len(w))]), lambda w: F.contains(keys, w))
    domains, special = by_length(DOMAINS), by_length(SPECIALTIES)
    return F.struct(
        parts.alias("parts"), roles.alias("roles"), domains.alias("domains"), special.alias("specialties"),
        F.array_join(parts, ", ").alias("model_text"), F.array_join(F.array_distinct(F.concat(roles, domains, special)), " | ").alias("canonical_text"),
    )
