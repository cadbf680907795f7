"""Loading scored labels: one table of rules, compiled to columns and to SQL, decides what is accepted, replaced and rejected."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordinals import numbered
from .tables import require_columns

# The columns of a label file, the bounds of its sub-scores, the sources of labels.
COLUMNS = [
    "cv_id", "role", "final_label_score", "grade", "subscore_skill", "subscore_experience", "subscore_achievement", "subscore_education",
    "subscore_formatting", "subscore_keywords", "label_source", "labeler_id", "label_confidence", "labeled_at",
]
BOUNDS = {"subscore_skill": 30, "subscore_experience": 25, "subscore_achievement": 20, "subscore_education": 10, "subscore_formatting": 10, "subscore_keywords": 5}
SOURCES = ("human_single", "human_double", "committee", "rubric_bootstrap")
#: A later row of a file with the same values in these replaces the earlier one.
KEY = ["cv_id", "labeler_id", "labeled_at"]
NUMBERS = ["final_label_score", "label_confidence", *BOUNDS]
TEXTS = [c for c in COLUMNS if c not in NUMBERS]


@dataclass(frozen=True)
class Rule:
    """``broken`` is SQL over typed columns, true where a row breaks the rule (null counts as kept); after a ``fatal`` one no other
    rule is looked at."""

    name: str
    broken: str
    fatal: bool = False


def rules(tolerance: float = 1.0) -> list[Rule]:
    """All rules of a row, in the order in which they are checked."""
    outside = lambda c, top: f"{c} IS NULL OR {c} < 0 OR {c} > {top}"
    grade = "CASE WHEN final_label_score >= 85 THEN 'A' WHEN final_label_score >= 70 THEN 'B' WHEN final_label_score >= 55 THEN 'C' WHEN final_label_score >= 40 THEN 'D' ELSE 'E' END"
    sound = " AND ".join(f"{c} BETWEEN 0 AND {top}" for c, top in BOUNDS.items())
    return [
        Rule("cv_id is empty", "coalesce(cv_id, '') = ''", fatal=True),
        Rule("role is empty", "coalesce(role, '') = ''"),
        Rule("final_label_score out of bounds", outside("final_label_score", 100), fatal=True),
        Rule("grade does not fit the score", f"coalesce(grade, '') <> {grade}"),
        Rule("unknown label_source", f"coalesce(label_source, '') NOT IN ({', '.join(repr(s) for s in SOURCES)})"),
        Rule("label_confidence out of bounds", outside("label_confidence", 1)),
        *[Rule(f"{c} out of bounds", outside(c, top)) for c, top in BOUNDS.items()],
        Rule("subscores do not add up", f"{sound} AND abs({' + '.join(BOUNDS)} - final_label_score) > {tolerance}"),
    ]


def typed(labels: DataFrame) -> DataFrame:
    """Texts trimmed, the grade in capitals, numbers as doubles (null where they are none); other columns as they are."""
    out = {c: F.trim(F.col(c).cast("string")) for c in TEXTS} | {c: F.trim(F.col(c).cast("string")).try_cast("double") for c in NUMBERS}
    return require_columns(labels, COLUMNS).withColumns(out | {"grade": F.upper(out["grade"])})


def reasons(table: list[Rule]) -> Column:
    """The names of the rules that a typed row breaks, up to the first fatal one. The expression grows with the rules: no part of it holds another twice."""
    out, stopped = [], F.lit(False)
    for rule in table:
        broken = F.coalesce(F.expr(rule.broken), F.lit(False))
        out.append(F.when(broken & ~stopped, F.lit(rule.name)))
        stopped = stopped | broken if rule.fatal else stopped
    return F.filter(F.array(*out), lambda name: name.isNotNull())


def sql_checks(view: str, table: list[Rule]) -> str:
    """The same rules as one SQL statement over a view of typed rows: rule, rows (that break it, each rule for itself)."""
    return "\nUNION ALL ".join(f"SELECT '{r.name}' AS rule, count(*) AS rows FROM {view} WHERE {r.broken}" for r in table)


def load_labels(old: DataFrame, labels: DataFrame, known: DataFrame, order: list[str], tolerance: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(merged, report) of loading ``labels`` into ``old``.

    report has a row per row of the file: row_no (its line, the header being line 1, by ``order``), cv_id, status and reasons. A row is
    rejected if it breaks a rule or its cv_id is not in ``known`` (cv_id); of the other rows with equal KEY the last is accepted
    and the ones before are replaced. merged is ``old`` with accepted rows in place of those with equal KEY, in the columns of
    ``old``. Null keys are equal to each other. An empty file changes nothing."""
    rows = numbered(typed(labels), [], order, "row_no", "label-rows").withColumn("row_no", F.col("row_no") + 1)
    there = known.select(F.trim(F.col("cv_id").cast("string")).alias("cv_id"), F.lit(True).alias("_known")).distinct()
    rows = rows.join(there, "cv_id", "left")
    missing = F.when(F.col("_known").isNull() & (F.coalesce("cv_id", F.lit("")) != ""), F.array(F.lit("no such record"))).otherwise(F.array().cast("array<string>"))
    judged = rows.withColumn("reasons", F.concat(reasons(rules(tolerance)), missing)).drop("_known")
    good, bad = judged.where(F.size("reasons") == 0), judged.where(F.size("reasons") > 0)
    last = F.max("row_no").over(Window.partitionBy(*KEY))
    good = good.withColumn("_last", last).withColumn("status", F.when(F.col("row_no") == F.col("_last"), "accepted").otherwise("replaced"))
    good = good.withColumn("reasons", F.when(F.col("status") == "replaced", F.array(F.concat(F.lit("replaced by row "), F.col("_last").cast("string")))).otherwise(F.col("reasons")))
    report = good.select("row_no", "cv_id", "status", "reasons").unionByName(bad.select("row_no", "cv_id", F.lit("rejected").alias("status"), "reasons"))
    fresh = good.where("status = 'accepted'")
    same = None
    keys = fresh.select(*[F.col(k).alias(f"_{k}") for k in KEY])
    for k in KEY:
        test = F.trim(F.col(k).cast("string")).eqNullSafe(F.col(f"_{k}"))
        same = test if same is None else same & test
    kept = old.join(keys, same, "left_anti")
    merged = kept.unionByName(fresh.select(*[F.col(c).cast(t).alias(c) if c in fresh.columns else F.lit(None).cast(t).alias(c) for c, t in old.dtypes]))
    return merged, report
