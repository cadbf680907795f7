"""Reference data: contracts of records, catalogs, profiles and cases, drift of a bundle, case building."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import drift, grade
from ..functions.text import clean_list, norm_empty, slug
from .ordinals import numbered
from .tables import violations

SUBSCORES = {"skill": 30, "experience": 25, "achievement": 20, "education": 10, "formatting": 10, "keywords": 5}


def label_rules(sources: list[str], tolerance: float = 0.5) -> dict[str, Column]:
    """What a scored label must meet: subscores within bounds that add up, a grade that fits, a known source, a confidence."""
    c = F.col
    rules = {f"{name} out of bounds": ~c(f"subscore_{name}").between(0, top) for name, top in SUBSCORES.items()}
    total = sum((F.coalesce(c(f"subscore_{n}"), F.lit(0.0)) for n in SUBSCORES), F.lit(0.0))
    return rules | {
        "score out of bounds": ~c("final_label_score").between(0, 100),
        "subscores do not add up": F.abs(total - c("final_label_score")) > tolerance,
        "grade does not fit the score": c("grade") != grade(c("final_label_score"), True),
        "unknown label source": ~c("label_source").isin(*sources),
        "confidence out of bounds": ~c("label_confidence").between(0, 1),
    }


def label_errors(labels: DataFrame, known: DataFrame, sources: list[str]) -> DataFrame:
    """cv_id, error: broken rules, repeated ids, and ids that no record has. A broken null rule does not count."""
    rules = {k: F.coalesce(v, F.lit(False)) for k, v in label_rules(sources).items()}
    repeated = labels.groupBy("cv_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("cv_id", F.lit("repeated id").alias("error"))
    unknown = labels.join(known, "cv_id", "left_anti").select("cv_id", F.lit("no such record").alias("error"))
    return violations(labels, "cv_id", rules).unionByName(repeated).unionByName(unknown)


def normalise_record(df: DataFrame, lists: list[str], texts: list[str]) -> DataFrame:
    """Texts without empty tokens, list fields split, cleaned and deduplicated."""
    return df.withColumns({c: norm_empty(F.col(c)) for c in texts} | {c: clean_list(F.col(c)) for c in lists})


def catalog_errors(catalog: DataFrame) -> DataFrame:
    """canonical, level, message for a catalog (canonical, aliases): errors, and warnings for aliases of two skills."""
    own = catalog.select("canonical", F.filter(F.array(
        F.when(F.coalesce(F.trim("canonical"), F.lit("")) == "", F.struct(F.lit("error").alias("level"), F.lit("no name").alias("message"))),
        F.when(F.coalesce(F.size("aliases"), F.lit(0)) <= 0, F.struct(F.lit("error").alias("level"), F.lit("no aliases").alias("message"))),
    ), lambda e: e.isNotNull()).alias("e")).select("canonical", F.explode("e").alias("e")).select("canonical", "e.level", "e.message")
    shared = catalog.select("canonical", F.explode("aliases").alias("alias"))
    twice = shared.groupBy("alias").agg(F.countDistinct("canonical").alias("n")).where("n > 1").select("alias")
    warned = shared.join(twice, "alias").select("canonical", F.lit("warning").alias("level"), F.concat(F.lit("shared alias "), F.col("alias")).alias("message"))
    return own.unionByName(warned)


def profile_errors(profiles: DataFrame, least_skills: int = 1) -> DataFrame:
    """role_name, error for profiles (role_name, job_count, common_skills)."""
    return violations(profiles, "role_name", {"no jobs": F.coalesce(F.col("job_count"), F.lit(0)) <= 0, "too few skills": F.coalesce(F.size("common_skills"), F.lit(0)) < least_skills})


def case_errors(cases: DataFrame, required: list[str]) -> DataFrame:
    """case_id, error: missing fields and repeated ids."""
    missing = violations(cases, "case_id", {f"missing {c}": F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "" for c in required})
    repeated = cases.groupBy("case_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("case_id", F.lit("repeated id").alias("error"))
    return missing.unionByName(repeated)


def bundle_drift(old: DataFrame, new: DataFrame, limit: float = 0.35) -> DataFrame:
    """name, old, new, drift, warn for two frames of counts (name, n)."""
    both = old.withColumnRenamed("n", "old").join(new.withColumnRenamed("n", "new"), "name", "full").na.fill(0, ["old", "new"])
    d = drift(F.col("old").cast("double"), F.col("new").cast("double"))
    return both.select("name", "old", "new", d.alias("drift"), (d > limit).alias("warn"))


def match_roles(roles: DataFrame, files: DataFrame) -> DataFrame:
    """role_name, file: the first file whose slug contains the role's slug or the other way round, by name; joined on the
    words of the slugs, so only pairs with a common word are compared."""
    r = roles.select("role_name", slug(F.col("role_name")).alias("role_slug")).withColumn("w", F.explode(F.split("role_slug", "_")))
    f = files.select("file", slug(F.regexp_replace("file", r"\.[^.]*$", "")).alias("file_slug")).withColumn("w", F.explode(F.split("file_slug", "_")))
    pairs = r.join(f, "w").groupBy("role_name", "role_slug", "file", "file_slug").agg(F.count(F.lit(1)).alias("common"))
    inside = F.contains("file_slug", F.col("role_slug")) | F.contains("role_slug", F.col("file_slug"))
    w = Window.partitionBy("role_name").orderBy(inside.desc(), F.col("common").desc(), "file")
    return pairs.withColumn("nth", F.row_number().over(w)).where("nth = 1").select("role_name", "file")


def build_cases(profiles: DataFrame, files: DataFrame) -> DataFrame:
    """case_id, role_name, file, expected_missing: the two skills to learn next, the common ones where there are none."""
    few = F.slice(F.when(F.size("recommended_next_skills") > 0, F.col("recommended_next_skills")).otherwise(F.col("common_skills")), 1, 2)
    return match_roles(profiles, files).join(profiles, "role_name").select(F.concat(F.lit("case_"), slug(F.col("role_name"))).alias("case_id"), "role_name", "file", few.alias("expected_missing"))


def template(cvs: DataFrame, jobs: DataFrame, per_cv: int) -> DataFrame:
    """(cv_id, job_id) pairs to judge: ``per_cv`` jobs for each cv in the order of ids, beginning where the cv before ended and going
    round all jobs. Places come from ``ordinals.numbered``; a table without jobs gives no pairs."""
    placed = numbered(cvs.select("cv_id"), [], ["cv_id"], "_cv", "template-cvs")
    held = numbered(jobs.select("job_id"), [], ["job_id"], "_place", "template-jobs")
    total = held.agg(F.count(F.lit(1)).alias("_n"))
    wanted = placed.crossJoin(F.broadcast(total)).where("_n > 0").select("cv_id", F.explode(F.sequence(F.lit(0), F.lit(per_cv - 1))).alias("_i"), "_cv", "_n")
    wanted = wanted.select("cv_id", (((F.col("_cv") - 1) * per_cv + F.col("_i")) % F.col("_n") + 1).alias("_place"))
    return wanted.join(held, "_place").select("cv_id", "job_id")
