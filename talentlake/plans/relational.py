"""Loads, listings, audits and contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scores import drift as drift_of
from ..functions.scores import grade, ratio
from ..operators import labels, ordinals, qa, tables
from .base import Registry, table

R = Registry()


@R.add("""SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'P' THEN 'X' ELSE o_orderstatus END AS status FROM orders
          UNION ALL SELECT o_orderkey + 100000000, o_custkey, 'X' FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'""")
def upsert_latest(spark, sf):
    """New versions replace rows with their keys, new keys are added."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("status"), "o_orderpriority")
    changed = o.where("status = 'P'").withColumn("status", F.lit("X"))
    added = o.where("status = 'O' and o_orderpriority = '1-URGENT'").withColumns({"o_orderkey": F.col("o_orderkey") + 100000000, "status": F.lit("X")})
    return tables.upsert(o, changed.unionByName(added), ["o_orderkey"]).drop("o_orderpriority")


@R.add("""SELECT l_suppkey AS job_id, p_brand AS skill, 0 AS version FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' GROUP BY ALL
          UNION ALL SELECT DISTINCT l_suppkey, p_brand, 1 FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'A'
            AND (l_suppkey, p_brand) NOT IN (SELECT (l_suppkey, p_brand) FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R')""")
def insert_ignore(spark, sf):
    l, p = table(spark, sf, "lineitem"), table(spark, sf, "part")
    edges = l.join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").alias("job_id"), F.col("p_brand").alias("skill"), "l_returnflag")
    old = edges.where("l_returnflag = 'R'").select("job_id", "skill", F.lit(0).alias("version")).distinct()
    return tables.insert_ignore(old, edges.where("l_returnflag = 'A'").select("job_id", "skill", F.lit(1).alias("version")), ["job_id", "skill"])


@R.add("""SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')
          UNION ALL SELECT o_orderkey, 1, 0.0::DOUBLE FROM orders WHERE o_orderstatus = 'P'""")
def replace_children(spark, sf):
    """All lines of some orders replaced by one."""
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    new = table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.lit(0.0).alias("l_quantity"))
    return tables.replace_children(l, new, "l_orderkey")


@R.add("SELECT o_orderkey, o_orderdate, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50 OFFSET 100")
def list_page(spark, sf):
    """The third page of a listing, newest first."""
    return tables.page(table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_totalprice"), 50, 100, F.col("o_orderdate").desc(), F.col("o_orderkey").desc())


@R.add("""SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1""")
def latest_per_key(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return tables.latest(o, ["o_custkey"], F.col("o_orderdate").desc(), F.col("o_orderkey").desc())


@R.add("SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations QUALIFY n <= 200")
def chat_history(spark, sf):
    """Turns of each conversation, oldest first, at most 200."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf, "conversations").select("conv_id", "turn", "role").withColumn("n", F.row_number().over(w)).where("n <= 200")


@R.add("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey = 7 LIMIT 1")
def point_lookup(spark, sf):
    return table(spark, sf, "customer").where("c_custkey = 7").select("c_custkey", "c_name", "c_acctbal").limit(1)


@R.add("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey IN (0, 2)")
def in_list(spark, sf):
    return table(spark, sf, "nation").where(F.col("n_regionkey").isin(0, 2)).select("n_nationkey", "n_name")


@R.add("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')")
def not_exists(spark, sf):
    o = table(spark, sf, "orders").where("o_orderstatus = 'P'")
    return table(spark, sf, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@R.add("SELECT p_partkey, p_name, round(c, 6) AS cents, q FROM (SELECT p_partkey, p_name, p_retailprice * 100 AS c, try_cast(p_name AS DOUBLE) AS q FROM part)")
def safe_casts(spark, sf):
    """Casts that give null, not an error, and defaults for columns that are missing."""
    p = tables.with_defaults(table(spark, sf, "part"), {"note": "none"})
    tables.require_columns(p, ["p_partkey", "note"])
    out = p.select("p_partkey", "p_name", F.round(F.col("p_retailprice") * 100, 6).alias("cents"), F.col("p_name").try_cast("double").alias("q"), "note")
    return tables.select_existing(tables.prefer_columns(out, ["p_partkey"]), ["p_partkey", "p_name", "cents", "q", "absent"])


_MISSING = " UNION ALL ".join(f"SELECT '{c}' AS column_name, round(avg(({c} IS NULL)::INT::DOUBLE), 6) AS missing FROM documents" for c in ("doc_id", "text", "lang", "source", "n_chars"))


@R.add(f"{_MISSING} UNION ALL SELECT 'short', round(avg((n_chars < 500)::INT::DOUBLE), 6) FROM documents")
def missing_ratio(spark, sf):
    d = table(spark, sf, "documents").withColumn("short", F.when(F.col("n_chars") >= 500, F.col("n_chars")))
    return tables.missing_ratio(d).select("column_name", F.round("missing", 6).alias("missing"))


@R.add("SELECT round(1 - count(DISTINCT o_custkey)::DOUBLE / count(*), 6) AS duplicate_ratio FROM orders")
def duplicate_ratio(spark, sf):
    return tables.duplicate_ratio(table(spark, sf, "orders"), "o_custkey").select(F.round("duplicate_ratio", 6).alias("duplicate_ratio"))


@R.add("""SELECT count(*)::BIGINT AS n_rows, count(DISTINCT source)::BIGINT AS sources, round(avg(n_chars), 6) AS mean_chars, round(avg((lang = 'en')::INT::DOUBLE), 6) AS english,
          round(avg((text LIKE '%|%')::INT::DOUBLE), 6) AS tables, max(n_chars)::BIGINT AS longest, round(avg((text = '')::INT::DOUBLE), 6) AS empty FROM documents""")
def quality_row(spark, sf):
    """One pass over all documents for a QA row."""
    share = lambda c, name: F.round(F.avg(c.cast("double")), 6).alias(name)
    return table(spark, sf, "documents").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("source").alias("sources"), F.round(F.avg("n_chars"), 6).alias("mean_chars"), share(F.col("lang") == "en", "english"),
        share(F.contains("text", F.lit("|")), "tables"), F.max("n_chars").alias("longest"), share(F.col("text") == "", "empty"),
    )


@R.add("SELECT o_custkey, o_orderdate, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, sf):
    return tables.duplicated_keys(table(spark, sf, "orders"), "o_custkey", "o_orderdate")


@R.add("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def referential_check(spark, sf):
    """Documents without a label."""
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left_anti").select("doc_id")


LABEL_SQL = """SELECT o_orderkey AS cv_id, score, CASE WHEN score >= 85 THEN 'A' WHEN score >= 70 THEN 'B' WHEN score >= 55 THEN 'C' WHEN score < 40 THEN 'E' ELSE 'D' END AS good,
        CASE WHEN o_orderstatus = 'P' THEN 'A' ELSE CASE WHEN score >= 85 THEN 'A' WHEN score >= 70 THEN 'B' WHEN score >= 55 THEN 'C' WHEN score < 40 THEN 'E' ELSE 'D' END END AS grade,
        o_custkey % 40 AS skill, (o_orderkey % 12) / 10.0 AS confidence FROM (SELECT *, (o_orderkey % 106)::DOUBLE AS score FROM orders)"""


@R.add(f"""SELECT cv_id, 'score out of bounds' AS error FROM ({LABEL_SQL}) WHERE score > 100
           UNION ALL SELECT cv_id, 'grade does not fit the score' FROM ({LABEL_SQL}) WHERE grade <> good
           UNION ALL SELECT cv_id, 'skill out of bounds' FROM ({LABEL_SQL}) WHERE skill > 30
           UNION ALL SELECT cv_id, 'confidence out of bounds' FROM ({LABEL_SQL}) WHERE confidence > 1""")
def label_contract(spark, sf):
    """Bounds, grade and confidence rules on composed labels: a row per broken rule."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("cv_id"), (F.col("o_orderkey") % 106).cast("double").alias("score"), "o_orderstatus", (F.col("o_custkey") % 40).alias("skill"), ((F.col("o_orderkey") % 12) / F.lit(10.0)).alias("confidence"))
    o = o.withColumn("grade", F.when(F.col("o_orderstatus") == "P", "A").otherwise(grade(F.col("score"), True)))
    return tables.violations(o, "cv_id", {
        "score out of bounds": ~F.col("score").between(0, 100), "grade does not fit the score": F.col("grade") != grade(F.col("score"), True),
        "skill out of bounds": ~F.col("skill").between(0, 30), "confidence out of bounds": ~F.col("confidence").between(0, 1),
    })


@R.add("""SELECT source, old, new, round(CASE WHEN old = 0 AND new = 0 THEN 0 WHEN old = 0 THEN 1 ELSE abs(new - old)::DOUBLE / old END, 6) AS drift,
                 CASE WHEN old = 0 AND new = 0 THEN FALSE WHEN old = 0 THEN TRUE ELSE abs(new - old)::DOUBLE / old > 0.35 END AS warn
          FROM (SELECT source, count(*) FILTER (WHERE lang = 'en') AS old, count(*) FILTER (WHERE n_chars > 1000) AS new FROM documents GROUP BY source)""")
def drift(spark, sf):
    """How far a count moved between two builds, with a warning over 35 %."""
    g = table(spark, sf, "documents").groupBy("source").agg(F.count_if(F.col("lang") == "en").alias("old"), F.count_if(F.col("n_chars") > 1000).alias("new"))
    d = drift_of(F.col("old").cast("double"), F.col("new").cast("double"))
    return g.select("source", "old", "new", F.round(d, 6).alias("drift"), (d > 0.35).alias("warn"))


@R.add("""SELECT 'customers' AS what, (SELECT count(DISTINCT o_custkey) FROM orders) AS graph, (SELECT count(*) FROM customer) AS base,
                 round((SELECT count(DISTINCT o_custkey) FROM orders)::DOUBLE / (SELECT count(*) FROM customer), 6) AS completeness
          UNION ALL SELECT 'parts', (SELECT count(DISTINCT l_partkey) FROM lineitem), (SELECT count(*) FROM part), round((SELECT count(DISTINCT l_partkey) FROM lineitem)::DOUBLE / (SELECT count(*) FROM part), 6)""")
def graph_completeness(spark, sf):
    """Nodes that have edges, of all."""
    def row(what, edges, key, base):
        return edges.agg(F.lit(what).alias("what"), F.countDistinct(key).alias("graph")).crossJoin(base.agg(F.count(F.lit(1)).alias("base")))

    both = row("customers", table(spark, sf, "orders"), "o_custkey", table(spark, sf, "customer")).unionByName(row("parts", table(spark, sf, "lineitem"), "l_partkey", table(spark, sf, "part")))
    return both.withColumn("completeness", F.round(ratio(F.col("graph"), F.col("base")), 6))


@R.add("SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL ORDER BY o_orderpriority, n DESC")
def mixed_sort(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n")).orderBy("o_orderpriority", F.col("n").desc())


@R.add("""SELECT n_nationkey AS id, n_name AS name, NULL::INTEGER AS extra FROM nation UNION ALL SELECT r_regionkey, r_name, 1 FROM region""")
def union_by_name(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    r = table(spark, sf, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"), F.lit(1).alias("extra"))
    return n.unionByName(r, allowMissingColumns=True)


@R.add("""SELECT o_custkey, round(d, 6) AS age_days, d <= 365 AS fresh FROM (SELECT o_custkey, (epoch(TIMESTAMP '1999-01-01') - epoch(max(o_orderdate))) / 86400.0::DOUBLE AS d FROM orders GROUP BY o_custkey)""")
def freshness(spark, sf):
    """Age in days at a given time."""
    days = F.timestamp_diff("SECOND", F.max("o_orderdate"), F.lit("1999-01-01").cast("timestamp")) / F.lit(86400.0)
    return table(spark, sf, "orders").groupBy("o_custkey").agg(days.alias("d")).select("o_custkey", F.round("d", 6).alias("age_days"), (F.col("d") <= 365).alias("fresh"))


@R.add("""SELECT source || CASE WHEN n > 1 THEN '_' || n ELSE '' END AS case_id, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents)""")
def unique_case_ids(spark, sf):
    """Repeated names get a running number, in as many tasks as there are ranges of documents."""
    d = table(spark, sf, "documents").select("source", "doc_id")
    return ordinals.unique_ids(d, "source", ["doc_id"], "case_id").select("case_id", "doc_id")


# A file of labels made from `labels` and `documents`, with rows that break rules, repeat keys or name no English document.
_FILE = """SELECT d.doc_id, d.doc_id % 3 = 0 AS again, CASE WHEN d.doc_id % 29 = 0 THEN ' ' ELSE d.doc_id::VARCHAR END AS cv_id, CASE WHEN d.doc_id % 17 = 0 THEN '' ELSE source END AS role,
            (n_chars % 31)::DOUBLE AS skill, (n_chars % 27)::DOUBLE AS experience, quality * 20.0::DOUBLE AS achievement, toxic * 5 + 5.0::DOUBLE AS education, (n_chars % 11)::DOUBLE AS formatting, 5.0::DOUBLE AS keywords, d.lang
          FROM labels l JOIN documents d USING (doc_id)"""
_SCORED = f"""SELECT *, CASE WHEN doc_id % 23 = 0 THEN NULL WHEN doc_id % 19 = 0 THEN 101 ELSE skill + experience + achievement + education + formatting + keywords + CASE WHEN doc_id % 13 = 0 THEN 3 ELSE 0 END END::DOUBLE AS score,
            CASE WHEN doc_id % 11 = 0 THEN 'guess' ELSE 'committee' END AS label_source, (doc_id % 12) / 10.0::DOUBLE AS confidence FROM ({_FILE})"""
_GRADED = f"""SELECT *, CASE WHEN doc_id % 7 = 0 THEN 'A' ELSE good END AS grade FROM (SELECT *, CASE WHEN score >= 85 THEN 'A' WHEN score >= 70 THEN 'B' WHEN score >= 55 THEN 'C' WHEN score >= 40 THEN 'D' ELSE 'E' END AS good FROM ({_SCORED}))"""
_REPORT = f"""WITH r AS (SELECT *, row_number() OVER (ORDER BY doc_id, version) + 1 AS row_no, trim(cv_id) AS id FROM (SELECT *, 1 AS version FROM ({_GRADED}) UNION ALL SELECT *, 2 FROM ({_GRADED}) WHERE again)),
            e AS (SELECT *, CASE WHEN id = '' THEN ['cv_id is empty'] ELSE list_concat(CASE WHEN role = '' THEN ['role is empty'] ELSE [] END,
                CASE WHEN score IS NULL OR score > 100 THEN ['final_label_score out of bounds'] ELSE list_concat(CASE WHEN grade <> good THEN ['grade does not fit the score'] ELSE [] END,
                  list_concat(CASE WHEN label_source = 'guess' THEN ['unknown label_source'] ELSE [] END, list_concat(CASE WHEN confidence > 1 THEN ['label_confidence out of bounds'] ELSE [] END,
                  list_concat(CASE WHEN experience > 25 THEN ['subscore_experience out of bounds'] ELSE [] END, CASE WHEN experience <= 25 AND doc_id % 13 = 0 THEN ['subscores do not add up'] ELSE [] END)))) END) END AS own FROM r),
            a AS (SELECT *, list_concat(own, CASE WHEN id <> '' AND lang <> 'en' THEN ['no such record'] ELSE [] END) AS reasons FROM e),
            s AS (SELECT *, CASE WHEN len(reasons) = 0 THEN max(row_no) OVER (PARTITION BY id, len(reasons) = 0) END AS last FROM a)"""


def _label_file(spark, sf):
    d, l = table(spark, sf, "documents").select("doc_id", "source", "n_chars", "lang"), table(spark, sf, "labels")
    k, c = F.col("doc_id"), F.col("n_chars")
    rows = l.join(d, "doc_id").select(
        "doc_id", F.when(k % 29 == 0, " ").otherwise(F.concat(F.lit(" "), k.cast("string"))).alias("cv_id"), F.when(k % 17 == 0, "").otherwise(F.col("source")).alias("role"), (c % 31).alias("subscore_skill"), (c % 27).alias("subscore_experience"),
        (F.col("quality") * 20).alias("subscore_achievement"), (F.col("toxic") * 5 + 5).alias("subscore_education"), (c % 11).alias("subscore_formatting"), F.lit("5").alias("subscore_keywords"),
        F.when(k % 11 == 0, "guess").otherwise("committee").alias("label_source"), F.lit("someone").alias("labeler_id"), ((k % 12) / F.lit(10.0)).alias("label_confidence"), F.lit("2024-05-01").alias("labeled_at"),
    )
    total = sum((F.col(f"subscore_{n}").cast("double") for n in ("skill", "experience", "achievement", "education", "formatting", "keywords")), F.lit(0.0))
    score = F.when(k % 23 == 0, "none").when(k % 19 == 0, "101").otherwise((total + F.when(k % 13 == 0, 3).otherwise(0)).cast("string"))
    rows = rows.withColumn("final_label_score", score)
    given = F.lower(F.when(k % 7 == 0, "A").otherwise(grade(F.coalesce(score.try_cast("double"), F.lit(0.0)), True)))
    rows = rows.withColumn("grade", given)
    return rows.withColumn("version", F.lit(1)).unionByName(rows.where(k % 3 == 0).withColumn("version", F.lit(2))), d.where("lang = 'en'").select(F.col("doc_id").alias("cv_id"))


def _old_labels(spark, sf):
    old = table(spark, sf, "labels").where("doc_id % 5 = 0").select(F.col("doc_id").cast("string").alias("cv_id"), F.lit("someone").alias("labeler_id"), F.lit("2024-05-01").alias("labeled_at"), F.lit(0.0).alias("final_label_score"))
    return old.unionByName(old.withColumn("labeled_at", F.lit("2023-01-01")))


@R.add(f"""{_REPORT} SELECT row_no, id AS cv_id, CASE WHEN len(reasons) > 0 THEN 'rejected' WHEN row_no = last THEN 'accepted' ELSE 'replaced' END AS status,
           CASE WHEN len(reasons) > 0 THEN array_to_string(reasons, '; ') WHEN row_no = last THEN '' ELSE 'replaced by row ' || last END AS reasons FROM s""")
def label_report(spark, sf):
    """What becomes of each line of a label file, and why."""
    file, known = _label_file(spark, sf)
    _, report = labels.load_labels(_old_labels(spark, sf), file, known, ["doc_id", "version"])
    return report.select("row_no", "cv_id", "status", F.array_join("reasons", "; ").alias("reasons"))


@R.add(f"""{_REPORT}, n AS (SELECT id AS cv_id, score FROM s WHERE row_no = last),
           o AS (SELECT doc_id::VARCHAR AS cv_id, unnest(['2024-05-01', '2023-01-01']) AS labeled_at FROM labels WHERE doc_id % 5 = 0)
           SELECT cv_id, labeled_at, 0.0::DOUBLE AS final_label_score FROM o WHERE labeled_at = '2023-01-01' OR cv_id NOT IN (SELECT cv_id FROM n) UNION ALL SELECT cv_id, '2024-05-01', score FROM n""")
def label_load(spark, sf):
    """The table of labels after a load: accepted rows in place of those with their key."""
    file, known = _label_file(spark, sf)
    merged, _ = labels.load_labels(_old_labels(spark, sf), file, known, ["doc_id", "version"])
    return merged.select("cv_id", "labeled_at", "final_label_score")


def _qa_jobs(spark, sf):
    d, k, c = table(spark, sf, "documents"), F.col("doc_id"), F.col("n_chars")
    words = F.filter(F.split(F.substring("text", 1, 60), " "), lambda w: F.length(w) > 6)
    return d.select(
        F.col("source").alias("job_title_display"), F.when(k % 7 > 0, F.col("source")).alias("job_title_canonical"), F.when(F.col("lang") == "en", "known").otherwise(" Unknown").alias("job_family"), F.when(k % 3 == 0, "Paris").alias("location_city"),
        F.when(k % 5 > 0, k % 4 == 0).alias("is_multi_location"), F.when(c > 800, "remote").when(c > 200, "unknown").alias("work_mode"), F.when(c % 2 == 0, c).alias("salary_min_vnd_month"), F.when(c % 2 == 0, c * 2).alias("salary_max_vnd_month"),
        (c % 9 == 0).alias("salary_is_negotiable"), F.when(k % 6 < 4, k % 6).alias("experience_min_years"), F.split("source", "r").alias("tags_list"), words.alias("skills_extracted"), F.when(k % 2 == 0, words).alias("skills_required"),
        F.col("lang").alias("job_text_sparse"), F.when(k % 8 > 0, F.col("text")).alias("job_text_match"), (k % 10 < 3).cast("int").alias("has_dense_embedding"),
    )


@R.add("""WITH j AS (SELECT *, len(list_filter(string_split(text[1:60], ' '), lambda w: length(w) > 6)) AS skills, doc_id AS k, n_chars AS c FROM documents),
          s AS (SELECT length(text) AS n FROM conversations)
          SELECT count(*) AS n_jobs, round(avg((source IS NULL)::INT::DOUBLE), 6) AS pct_missing_job_title_display, round(avg((k % 7 = 0)::INT::DOUBLE), 6) AS pct_missing_job_title_canonical, round(avg((lang IS DISTINCT FROM 'en')::INT::DOUBLE), 6) AS pct_unknown_job_family,
                 round(avg((k % 3 <> 0)::INT::DOUBLE), 6) AS pct_missing_location_city, round(avg((k % 5 > 0 AND k % 4 = 0)::INT::DOUBLE), 6) AS pct_true_is_multi_location, round(avg((c > 200 AND c <= 800)::INT::DOUBLE), 6) AS pct_unknown_work_mode,
                 round(avg((c % 2 <> 0)::INT::DOUBLE), 6) AS pct_missing_salary_min, round(avg((c % 2 <> 0)::INT::DOUBLE), 6) AS pct_missing_salary_max, round(avg((c % 9 = 0)::INT::DOUBLE), 6) AS pct_negotiable_salary,
                 round(avg((k % 6 >= 4)::INT::DOUBLE), 6) AS pct_missing_experience_min, round(avg(len(string_split(source, 'r'))::DOUBLE), 6) AS avg_tags_per_job, round(avg(skills::DOUBLE), 6) AS avg_skills_per_job,
                 round(avg(CASE WHEN k % 2 = 0 THEN skills ELSE 0 END::DOUBLE), 6) AS avg_required_skills_per_job, round(avg((skills = 0)::INT::DOUBLE), 6) AS pct_jobs_without_skills, round(avg(length(lang)::DOUBLE), 6) AS avg_job_text_sparse_len,
                 round(avg(CASE WHEN k % 8 > 0 THEN length(text) ELSE 0 END::DOUBLE), 6) AS avg_job_text_match_len, round(avg((k % 10 < 3)::INT::DOUBLE), 6) AS job_has_dense_embedding_rate,
                 (SELECT count(*) FROM s) AS n_sections, (SELECT round(avg(n::DOUBLE), 6) FROM s) AS avg_section_chunk_len, 0 AS absent FROM j""")
def quality_row_full(spark, sf):
    """The QA row over all documents as jobs and all turns as sections; what the tables lack is null, and counted."""
    row = qa.qa_row(_qa_jobs(spark, sf), table(spark, sf, "conversations").select(F.col("text").alias("chunk_text")))
    absent = ["pct_missing_experience_max", "pct_unknown_experience_type", "pct_unknown_education_level", "pct_unknown_employment_type", "pct_unknown_job_level", "avg_preferred_skills_per_job", "avg_job_text_chatbot_len", "section_has_dense_embedding_rate"]
    kept = [c for c in row.columns if c not in absent]
    counted = sum((F.col(c).isNotNull().cast("int") for c in absent), F.lit(0)).alias("absent")
    return row.select(*[F.round(c, 6).alias(c) if not c.startswith("n_") else F.col(c) for c in kept], counted)


@R.add("""SELECT 'r1' AS run, 'orders' AS name, (SELECT count(*) FROM orders) AS rows, 2 AS columns, 'o_orderkey:bigint,o_custkey:bigint' AS schema UNION ALL SELECT 'r1', 'urgent', (SELECT count(*) FROM orders WHERE o_orderpriority = '1-URGENT'), 1, 'o_orderkey:bigint'""")
def load_manifest(spark, sf):
    """What a load has written: a row for each table."""
    o = table(spark, sf, "orders")
    return qa.manifest({"orders": o.select("o_orderkey", "o_custkey"), "urgent": o.where("o_orderpriority = '1-URGENT'").select("o_orderkey")}, "r1")


@R.add("""SELECT count(*) AS n_rows, round((count(*) - count(DISTINCT split_part(url, '/', 4)))::DOUBLE / count(*), 6) AS dup_by_url_ratio, round(avg((length(title) > 0 AND length(html) > 400)::INT::DOUBLE), 6) AS has_minimum_content_ratio
          FROM (SELECT url, html, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title FROM pages)""")
def audit_row(spark, sf):
    """The audit before cleaning: repeated addresses, and pages with a title and a body."""
    p = table(spark, sf, "pages").select(F.split_part("url", F.lit("/"), F.lit(4)).alias("url"), F.trim(F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"), F.when(F.length("html") > 400, F.col("html")).alias("body"), F.lit("").alias("none"))
    return qa.audit_row(p, "url", "title", ["body", "none"]).select("n_rows", *[F.round(c, 6).alias(c) for c in ("dup_by_url_ratio", "has_minimum_content_ratio")])
