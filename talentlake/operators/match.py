"""Recommendation, skill gaps, career paths, retrieval and hybrid ranking, as joins on edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import hybrid, match_weight, ratio
from ..functions.text import let
from ..functions.vector import cosine_distance
from .dictionary import contained


def recommend(owned: DataFrame, required: DataFrame, jobs: DataFrame, k: int, certified: DataFrame | None = None) -> DataFrame:
    """The ``k`` best jobs of each cv: cv_id, job_id, matched, total, coverage, cert_matches, score, rank.

    owned(cv_id, skill), certified(cv_id, skill), required(job_id, skill, importance), jobs(job_id, job_family, min_years)
    and cv facts on ``owned``'s side are joined on the skill, so only pairs with a common skill are made. Score: 2, 1 or 0.5 a
    match by importance, 2 x coverage, 0.05 a certified match."""
    totals = required.groupBy("job_id").agg(F.countDistinct("skill").alias("total"))
    have = owned.select("cv_id", "skill", F.lit(0).alias("cert"))
    if certified is not None:
        have = have.unionByName(certified.select("cv_id", "skill", F.lit(1).alias("cert")))
    have = have.groupBy("cv_id", "skill").agg(F.max("cert").alias("cert"))
    pairs = have.join(required, "skill").groupBy("cv_id", "job_id").agg(
        F.countDistinct("skill").alias("matched"), F.sum(match_weight(F.col("importance"))).alias("weighted"), F.sum("cert").alias("cert_matches")
    )
    scored = pairs.join(totals, "job_id").join(jobs, "job_id")
    scored = scored.withColumn("coverage", ratio(F.col("matched"), F.col("total")))
    scored = scored.withColumn("score", F.col("weighted") + 2.0 * F.col("coverage") + 0.05 * F.col("cert_matches"))
    w = Window.partitionBy("cv_id").orderBy(F.col("score").desc(), F.col("matched").desc(), F.col("coverage").desc(), F.col("cert_matches").desc(), "job_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def recommend_all(
    cvs: DataFrame, owned: DataFrame, required: DataFrame, jobs: DataFrame, targets: DataFrame, k: int, certified: DataFrame
) -> DataFrame:
    """The ``k`` best of all jobs for each cv: cv_id, job_id, has_match, matched, total, coverage, cert_matches, score, rank.

    cvs(cv_id, years), owned(cv_id, skill), certified(cv_id, skill), targets(cv_id, role), required(job_id, skill, importance) and
    jobs(job_id, title, job_family, min_years). Score: 2, 1 or 0.5 a match by importance, 2 x coverage, 0.2 if a target role
    stands in the job's family or title, 0.1 if the years suffice or 0.05 if the job asks for none (0 if the cv's are
    unknown), 0.05 a certified skill. Jobs with a match come first, equal ones by job_id.

    Only pairs with a common skill are joined. A cv with fewer than ``k`` matches (a certified skill that it does not own is none) is filled
    up from jobs without one, whose score has a handful of values: of each role (or none) and each demand of years the first 2 x ``k`` jobs are enough."""
    roles = targets.select("cv_id", F.lower("role").alias("role")).where("role <> ''").distinct()
    facts = cvs.select("cv_id", "years").join(roles.groupBy("cv_id").agg(F.collect_set("role").alias("roles")), "cv_id", "left")
    skills = owned.select("cv_id", F.lower("skill").alias("skill"), F.lit(1).alias("own"), F.lit(0).alias("cert"))
    skills = skills.unionByName(certified.select("cv_id", F.lower("skill").alias("skill"), F.lit(0).alias("own"), F.lit(1).alias("cert")))
    skills = skills.groupBy("cv_id", "skill").agg(F.max("own").alias("own"), F.max("cert").alias("cert"))
    need = required.select("job_id", F.lower("skill").alias("skill"), "importance")
    totals = need.groupBy("job_id").agg(F.count("skill").alias("total"))
    pairs = skills.join(need, "skill").groupBy("cv_id", "job_id").agg(
        F.sum("own").alias("matched"), F.sum(F.col("own") * match_weight(F.col("importance"))).alias("weighted"), F.sum("cert").alias("cert_matches")
    )
    described = jobs.select("job_id", F.lower("job_family").alias("family"), F.lower("title").alias("heading"), "min_years")
    fills = F.exists(F.col("roles"), lambda r: F.contains(F.col("family"), r) | F.contains(F.col("heading"), r))
    scored = pairs.join(described, "job_id").join(facts, "cv_id").join(totals, "job_id", "left")
    scored = scored.withColumn("in_role", F.coalesce(fills, F.lit(False))).drop("family", "heading", "roles")

    # Jobs without a common skill for the cvs that need them: `place` is a job's place among those of one role and one demand.
    enough = pairs.where("matched > 0").groupBy("cv_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
    short = facts.join(enough, "cv_id", "left_anti")
    first = lambda df, by: df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("job_id"))).where(F.col("place") <= 2 * k).drop("place")
    texts = described.select(F.explode(F.array_distinct(F.array("family", "heading"))).alias("text"), "job_id", "min_years")
    named = texts.join(contained(texts, "text", roles, "role"), "text").select("role", "job_id", "min_years").distinct()
    of_role = first(named, ["role", "min_years"])
    of_role = short.select("cv_id", "years", F.explode("roles").alias("role")).join(of_role, "role").select("cv_id", "years", "job_id", "min_years", F.lit(True).alias("in_role"))
    of_any = first(described.select("job_id", "min_years"), ["min_years"])
    rest = first(_by_years(short.select("years").distinct(), of_any), ["years", "bonus"])
    rest = short.join(rest.withColumnRenamed("years", "y"), F.col("years").eqNullSafe(F.col("y")))
    rest = rest.join(described.drop("min_years"), "job_id").withColumn("in_role", F.coalesce(fills, F.lit(False)))
    extra = of_role.unionByName(rest.select("cv_id", "years", "job_id", "min_years", "in_role")).distinct().join(pairs, ["cv_id", "job_id"], "left_anti")
    extra = extra.join(totals, "job_id", "left").withColumns({"matched": F.lit(0).cast("long"), "weighted": F.lit(0.0), "cert_matches": F.lit(0).cast("long")})

    every = scored.unionByName(extra).withColumn("total", F.coalesce("total", F.lit(0)))
    every = every.withColumn("coverage", ratio(F.col("matched"), F.col("total"))).withColumn("has_match", (F.col("matched") > 0).cast("int"))
    bonus = F.when(F.col("in_role"), 0.2).otherwise(0.0) + years_bonus(F.col("years"), F.col("min_years"))
    every = every.withColumn("score", F.round(F.col("weighted") + 2.0 * F.col("coverage") + bonus + 0.05 * F.col("cert_matches"), 9))
    keys = [F.col(c).desc() for c in ("has_match", "score", "matched", "coverage", "cert_matches")]
    ranked = every.withColumn("rank", F.row_number().over(Window.partitionBy("cv_id").orderBy(*keys, "job_id"))).where(F.col("rank") <= k)
    return ranked.select("cv_id", "job_id", "has_match", "matched", "total", "coverage", "cert_matches", "score", "rank")


def years_bonus(years: Column, least: Column) -> Column:
    """0.1 if ``years`` suffice, 0.05 if nothing is asked for, 0 if they are too few or unknown."""
    return F.when(years.isNull(), 0.0).when(least.isNull(), 0.05).when(years >= least, 0.1).otherwise(0.0)


def _by_years(years: DataFrame, jobs: DataFrame) -> DataFrame:
    """(years, job_id, min_years, bonus): distinct numbers of years with the few jobs of each demand, which are spread over one
    row (2 k for each demand) and exploded again."""
    one = lambda c: F.pmod(F.hash(c), F.lit(1)).alias("_one")  # noqa: E731  a key that all rows share
    demands = jobs.groupBy(one("min_years")).agg(F.collect_list(F.struct("job_id", "min_years")).alias("_jobs"))
    spread = years.select("years", one("years")).join(demands, "_one").select("years", F.explode("_jobs").alias("_j")).select("years", "_j.*")
    return spread.withColumn("bonus", years_bonus(F.col("years"), F.col("min_years")))


def infer_roles(cvs: DataFrame, profiles: DataFrame, k: int) -> DataFrame:
    """The ``k`` best roles of each cv: cv_id, role, confidence, rank, selected_role, requires_confirmation.

    cvs(cv_id, skills, target_role, signal, preferred), profiles(role, skills, keywords: arrays), of which there are as many as
    roles; they are spread over the cvs by Spark's own size check. Confidence: 0.65 of the profile's skills that the cv has,
    0.2 of its keywords of three letters or more that stand in the signal text, 0.15 if the target role is the role. The
    preferred role is selected if there is a profile of it, else the best; below 0.45 without a preference the choice needs
    confirmation."""
    own = profiles.select(F.col("role"), F.col("skills").alias("needed"), F.filter("keywords", lambda w: F.length(w) >= 3).alias("words"))
    pairs = cvs.join(own, F.lit(True))
    signal = F.lower(F.coalesce("signal", F.lit("")))
    hits = let(signal, lambda s: F.size(F.filter("words", lambda w: F.contains(s, w))))
    same = lambda a, b: F.coalesce(F.lower(F.trim(a)) == F.lower(F.trim(b)), F.lit(False))
    fit = 0.65 * ratio(F.size(F.array_intersect("needed", F.coalesce("skills", F.array()))), F.size("needed")) + 0.2 * ratio(hits, F.size("words"))
    fit = F.round(F.least(F.greatest(fit + 0.15 * same(F.col("target_role"), F.col("role")).cast("int"), F.lit(0.0)), F.lit(1.0)), 4)
    each = Window.partitionBy("cv_id")
    wish = F.coalesce(F.trim("preferred"), F.lit("")) != ""
    rows = pairs.withColumn("confidence", fit).withColumn("wished", same(F.col("preferred"), F.col("role")) & wish)
    rows = rows.withColumn("rank", F.row_number().over(each.orderBy(F.col("confidence").desc(), "role")))
    best = F.max_by(F.struct("role", "confidence"), F.struct(F.col("wished").cast("int"), -F.col("rank"))).over(each)
    rows = rows.withColumn("best", best).where(F.col("rank") <= k)
    return rows.select("cv_id", "role", "confidence", "rank", F.col("best.role").alias("selected_role"), ((F.col("best.confidence") < 0.45) & ~wish).alias("requires_confirmation"))


def hit_details(hits: DataFrame, details: DataFrame, url: str, content: str, text: str) -> DataFrame:
    """``hits`` with the details of their job by ``url`` (null where it is not known) and `shown`: the job's ``text``, or the
    hit's own ``content`` where that is missing or empty."""
    joined = hits.join(details.dropDuplicates([url]), url, "left")
    return joined.withColumn("shown", F.when(F.coalesce(F.col(text), F.lit("")) != "", F.col(text)).otherwise(F.coalesce(F.col(content), F.lit(""))))


def role_jobs(targets: DataFrame, jobs: DataFrame, family: str = "job_family", title: str = "title") -> DataFrame:
    """(cv_id, role, job_id) where the job's family is the role or its title contains it: an equi join and, for titles, a join of
    distinct titles and roles on their q-grams."""
    equal = targets.join(jobs, targets["role"] == jobs[family]).select("cv_id", "role", "job_id")
    inside = jobs.select("job_id", F.col(title).alias("_title")).join(contained(jobs.select(F.col(title).alias("_title")), "_title", targets, "role"), "_title").select("job_id", "role")
    return equal.unionByName(targets.join(inside, "role").select("cv_id", "role", "job_id")).distinct()


def skill_gap(owned: DataFrame, required: DataFrame, cv_jobs: DataFrame, k: int) -> DataFrame:
    """The ``k`` skills most asked for by a cv's jobs that it lacks: cv_id, skill, n, rank. A job of two roles counts twice."""
    need = cv_jobs.join(required, "job_id").groupBy("cv_id", "skill").agg(F.count(F.lit(1)).alias("n"))
    lack = need.join(owned.select("cv_id", "skill").distinct(), ["cv_id", "skill"], "left_anti")
    w = Window.partitionBy("cv_id").orderBy(F.col("n").desc(), "skill")
    return lack.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def career_path(owned: DataFrame, required: DataFrame, targets: DataFrame, jobs: DataFrame) -> DataFrame:
    """Per cv and role: open_jobs, owned_skills, needed_skills, known_share."""
    pairs = role_jobs(targets, jobs)
    need = pairs.join(required, "job_id").groupBy("cv_id", "role").agg(F.countDistinct("job_id").alias("open_jobs"), F.collect_set("skill").alias("needed"))
    have = owned.groupBy("cv_id").agg(F.collect_set("skill").alias("have"))
    both = targets.select("cv_id", "role").distinct().join(need, ["cv_id", "role"], "left").join(have, "cv_id", "left")
    empty = F.array().cast("array<string>")
    needed, own = F.coalesce("needed", empty), F.coalesce("have", empty)
    return both.select(
        "cv_id", "role", F.coalesce("open_jobs", F.lit(0)).cast("long").alias("open_jobs"), F.size(own).cast("long").alias("owned_skills"),
        F.size(needed).cast("long").alias("needed_skills"), ratio(F.size(F.array_intersect(needed, own)), F.size(needed)).alias("known_share"),
    )


def top_vectors(vectors: DataFrame, query: Column, k: int, vector: str, tie: str, where: Column | None = None) -> DataFrame:
    """The ``k`` rows nearest to one query vector by cosine distance: a bounded sort, no shuffle of the table."""
    rows = vectors if where is None else vectors.where(where)
    return rows.withColumn("distance", cosine_distance(F.col(vector), query)).orderBy("distance", tie).limit(k)


def hybrid_rank(vector_side: DataFrame, graph_side: DataFrame, id_: str, w_vector: float, w_graph: float) -> DataFrame:
    """Both candidate lists (the best few of each side) by id, scored; equal scores prefer candidates in both lists, then those
    with graph evidence."""
    both = vector_side.join(graph_side, id_, "full")
    score = F.round(hybrid(F.col("vector_score"), F.col("graph_score"), w_vector, w_graph), 9)
    in_both = F.col("vector_score").isNotNull() & F.col("graph_score").isNotNull()
    order = Window.orderBy(score.desc(), in_both.desc(), F.col("graph_score").isNotNull().desc(), id_)
    return both.withColumns({"score": score, "rank": F.row_number().over(order)})


def focus_filter(hits: DataFrame, group: str, focus: Column, order: list[Column], k: int, strong: Column | None = None) -> DataFrame:
    """The first ``k`` hits of a question; only those with a focus hit, if there are at least max(2, min(k, 3)) of them. ``strong`` marks
    the hits of a question of the domain that do not belong to another one: where there are as many of them, only they count."""
    each, enough = Window.partitionBy(group), max(2, min(k, 3))
    marked = hits.withColumn("_focused", F.coalesce(focus, F.lit(False))).withColumn("_strong", F.coalesce(strong, F.lit(False)) if strong is not None else F.lit(False))
    marked = marked.withColumn("_n", F.sum(F.col("_focused").cast("int")).over(each)).withColumn("_s", F.sum(F.col("_strong").cast("int")).over(each))
    kept = marked.where(F.when(F.col("_s") >= enough, F.col("_strong")).when(F.col("_n") >= enough, F.col("_focused")).otherwise(True))
    return kept.withColumn("rank", F.row_number().over(each.orderBy(*order))).where(F.col("rank") <= k).drop("_focused", "_strong", "_n", "_s")


def focus_terms(*texts: Column, most: int = 60) -> Column:
    """The distinct words of some texts, sorted, at most ``most``."""
    words = F.split(F.trim(F.regexp_replace(F.lower(F.concat_ws(" ", *texts)), "[^a-z0-9]+", " ")), " ")
    return F.slice(F.array_sort(F.array_distinct(F.filter(words, lambda w: F.length(w) >= 3))), 1, most)


def best_and_worst(df: DataFrame, key: str, scores_: dict[str, float], n: int = 2) -> DataFrame:
    """key, kind (best or worst), name, share: the ``n`` strongest and weakest of some scores, as shares of their maxima."""
    parts = F.array(*[F.struct((F.col(c).cast("double") / top).alias("share"), F.lit(c).alias("name")) for c, top in scores_.items()])
    ordered = df.select(key, F.array_sort(parts).alias("p"))
    pick = lambda kind, part: ordered.select(key, F.lit(kind).alias("kind"), F.explode(part).alias("e")).select(key, "kind", "e.name", "e.share")
    return pick("worst", F.slice("p", 1, n)).unionByName(pick("best", F.slice("p", -n, n)))


def domain_first(skills: Column, domain: Column) -> Column:
    """Skills of the domain first, otherwise in their order."""
    return F.concat(F.filter(skills, lambda s: F.array_contains(domain, s)), F.filter(skills, lambda s: ~F.array_contains(domain, s)))


def hit_at_k(predicted: Column, truth: Column, k: int) -> Column:
    """1 if any of the first ``k`` predicted is true."""
    return F.arrays_overlap(F.slice(predicted, 1, k), truth).cast("int")
