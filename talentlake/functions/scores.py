"""Scores, grades, intents and text metrics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ascii_key, squeeze_lower

# What a question's words say it is about, in order of priority.
INTENTS = {
    "skill_gap": ("gap", "missing", "thieu", "lack"), "career_path": ("career", "path", "lo trinh", "transition"),
    "job_match": ("job", "match", "viec lam", "recommend"), "hr_screening": ("screen", "candidate", "ung vien"),
}


def ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    """a / b as a double; ``empty`` where b is 0 or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(empty))


def grade(score: Column, with_e: bool = False) -> Column:
    out = F.when(score >= 85, "A").when(score >= 70, "B").when(score >= 55, "C")
    return out.when(score < 40, "E").otherwise("D") if with_e else out.otherwise("D")


def cv_score(skills: Column, years: Column, projects: Column, certificates: Column, has_education: Column) -> Column:
    """0 to 100: skills (of 12) 35 %, years (of 3) 25 %, projects (of 4) 20 %, certificates (of 3) 10 %, education 10 % of 100 or 40."""
    part = lambda x, full: F.least(F.coalesce(x, F.lit(0)).cast("double") / full * 100.0, F.lit(100.0))
    return 0.35 * part(skills, 12) + 0.25 * part(years, 3) + 0.2 * part(projects, 4) + 0.1 * part(certificates, 3) + 0.1 * F.when(has_education, 100.0).otherwise(40.0)


def match_weight(importance: Column) -> Column:
    return F.when(importance == "required", 2.0).when(importance == "preferred", 1.0).otherwise(0.5)


def hybrid(vector: Column, graph: Column, w_vector: float = 0.45, w_graph: float = 0.55) -> Column:
    """The weighted sum; a missing side counts 0."""
    return w_vector * F.coalesce(vector, F.lit(0.0)) + w_graph * F.coalesce(graph, F.lit(0.0))


def rerank(question_hits: Column, intent_hits: Column, focus_hits: Column, distance: Column) -> Column:
    return 1.5 * question_hits + 2.0 * intent_hits + 1.2 * focus_hits - 2.0 * distance


def drift(old: Column, new: Column) -> Column:
    """Relative change; 0 if both are 0, 1 if only the old one is."""
    return F.when((old == 0) & (new == 0), 0.0).when(old == 0, 1.0).otherwise(F.abs(new - old) / F.abs(old))


def intent(question: Column) -> Column:
    key, out = ascii_key(question), F.lit("general")
    for name, words in reversed(INTENTS.items()):
        out = F.when(key.rlike("|".join(rf"\b{w}\b" for w in words)), name).otherwise(out)
    return out


def stable_id(*parts: Column) -> Column:
    """16 hex digits of the SHA-256 of the parts."""
    return F.left(F.sha2(F.concat_ws("|", *parts), 256), F.lit(16))


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)).cast("double")


def jaccard(a: Column, b: Column) -> Column:
    """Of the sets of elements; 1 if both are empty."""
    return ratio(overlap(a, b), F.size(F.array_union(a, b)), 1.0)


def precision_recall_f1(predicted: Column, truth: Column) -> Column:
    """(precision, recall, f1) of the sets; all 1 if both are empty, 0 if one is."""
    p, t, both = F.array_distinct(predicted), F.array_distinct(truth), overlap(predicted, truth)
    empty = (F.size(p) == 0) & (F.size(t) == 0)
    precision = F.when(empty, 1.0).otherwise(ratio(both, F.size(p)))
    recall = F.when(empty, 1.0).otherwise(ratio(both, F.size(t)))
    return F.struct(precision.alias("precision"), recall.alias("recall"), ratio(2.0 * precision * recall, precision + recall).alias("f1"))


def words(x: Column) -> Column:
    return F.filter(F.split(squeeze_lower(x), " "), lambda w: w != "")


def bag_overlap(a: Column, b: Column) -> Column:
    """Words in common, each as often as in both."""
    count = lambda xs, w: F.size(F.filter(xs, lambda x: x == w))
    return F.aggregate(F.array_intersect(a, b), F.lit(0), lambda s, w: s + F.least(count(a, w), count(b, w)))


def token_f1(answer: Column, truth: Column) -> Column:
    a, t = words(answer), words(truth)
    both = bag_overlap(a, t)
    p, r = ratio(both, F.size(a)), ratio(both, F.size(t))
    return ratio(2.0 * p * r, p + r)


def lcs(a: Column, b: Column) -> Column:
    """The length of the longest common subsequence of two arrays, row by row of the usual table."""
    start = F.transform(F.concat(F.array(F.lit("")), b), lambda _: F.lit(0))
    step = lambda row, x: F.aggregate(
        F.sequence(F.lit(1), F.size(b)), F.array(F.lit(0)),
        lambda out, j: F.concat(out, F.array(F.when(F.get(b, j - 1) == x, F.get(row, j - 1) + 1).otherwise(F.greatest(F.get(row, j), F.get(out, j - 1))))),
    )
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0).otherwise(F.element_at(F.aggregate(a, start, step), -1))


def rouge_l(answer: Column, truth: Column) -> Column:
    """F1 of the longest common subsequence of words."""
    a, t = words(answer), words(truth)
    n = lcs(a, t)
    p, r = ratio(n, F.size(a)), ratio(n, F.size(t))
    return ratio(2.0 * p * r, p + r)


def bleu_2(answer: Column, truth: Column) -> Column:
    """The geometric mean of clipped word and word-pair precision, with brevity penalty."""
    a, t = words(answer), words(truth)
    pairs = lambda xs: F.when(F.size(xs) >= 2, F.transform(F.sequence(F.lit(0), F.size(xs) - 2), lambda i: F.concat_ws(" ", F.get(xs, i), F.get(xs, i + 1)))).otherwise(F.array().cast("array<string>"))
    p1, p2 = ratio(bag_overlap(a, t), F.size(a)), ratio(bag_overlap(pairs(a), pairs(t)), F.size(pairs(a)))
    brevity = F.when(F.size(a) >= F.size(t), 1.0).when(F.size(a) == 0, 0.0).otherwise(F.exp(1.0 - F.size(t) / F.greatest(F.size(a), F.lit(1))))
    return brevity * F.sqrt(p1 * p2)


def keyword_accuracy(answer: Column, keywords: Column, threshold: float = 0.67) -> Column:
    """1 if at least ``threshold`` of the keywords are in the answer."""
    text = squeeze_lower(answer)
    hits = F.size(F.filter(keywords, lambda k: F.contains(text, squeeze_lower(k))))
    return (ratio(hits, F.size(keywords)) >= threshold).cast("int")


def citations(x: Column) -> Column:
    """The numbers in [chunk_id=n] marks."""
    return F.transform(F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(r"\[chunk_id=(\d+)\]")), lambda n: n.cast("bigint"))
