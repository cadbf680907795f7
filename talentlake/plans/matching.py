"""Skills, roles, graph, vector and hybrid queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores, vector
from ..functions.skills import mention_ratio, skills_in
from ..functions.text import match_key
from ..operators import match, rank, skills
from .base import SKILLS, STOPWORDS, Registry, table

R = Registry()

_KEY = "trim(regexp_replace(regexp_replace(strip_accents(lower({})), '[^a-z0-9_ß\\s/+#.-]', ' ', 'g'), '\\s+', ' ', 'g'))"
_VOCABULARY = "(VALUES " + ", ".join(f"('{s}', '{a}')" for s, aliases in SKILLS.items() for a in aliases) + ") v(skill, alias)"
_HIT = "regexp_matches(key, '(^|[^a-z0-9_ß])' || alias || '($|[^a-z0-9_ß])')"
RECORDS_SQL = f"""SELECT DISTINCT doc_id, source, skill, CASE WHEN regexp_matches(key, '\\b(preferred|nice to have|uu tien|loi the|plus|bonus)\\b') THEN 'preferred'
          WHEN field = 'requirements' THEN 'required' WHEN regexp_matches(key, '\\b(required|must have|bat buoc|yeu cau|can co|thanh thao)\\b') THEN 'required' ELSE 'mentioned' END AS importance, field AS source_field
          FROM (SELECT doc_id, source, field, {_KEY.format("segment")} AS key FROM (
                SELECT doc_id, source, field, unnest(regexp_split_to_array(text, '[\\n•;]|\\s-\\s')) AS segment FROM (
                  SELECT doc_id, source, 'description' AS field, text FROM documents UNION ALL SELECT doc_id, source, 'requirements', array_to_string(list_filter(string_split(text, chr(10)), lambda l: contains(l, ',')), chr(10)) FROM documents))), {_VOCABULARY} WHERE {_HIT}"""


def _records(spark, sf) -> DataFrame:
    # Lines with enumerations stand for requirements.
    asked = F.array_join(F.filter(F.split("text", "\n"), lambda line: F.contains(line, F.lit(","))), "\n")
    fields = {"description": F.col("text"), "requirements": asked}
    return skills.skill_records(table(spark, sf, "documents"), ["doc_id", "source"], fields, SKILLS)


@R.add(RECORDS_SQL)
def skill_records(spark, sf):
    """Who asks for which skill, where and how much."""
    return _records(spark, sf).drop("excerpt")


@R.add(f"SELECT source AS job_family, skill, importance, count(*) AS job_count FROM ({RECORDS_SQL}) GROUP BY ALL")
def role_skill_stats(spark, sf):
    """The flagship: skill records by role, skill and importance."""
    return skills.role_skill_stats(_records(spark, sf), "source").withColumnRenamed("source", "job_family")


@R.add(f"""SELECT skill, count(DISTINCT doc_id) AS mentions, count(DISTINCT source) AS roles FROM (SELECT doc_id, source, {_KEY.format("replace(text, chr(10), ' ')")} AS key FROM documents), {_VOCABULARY} WHERE {_HIT}
           GROUP BY skill HAVING count(DISTINCT doc_id) >= 1 OR count(DISTINCT source) >= 1""")
def catalog_support(spark, sf):
    return skills.catalog_support(table(spark, sf, "documents"), "source", F.replace("text", F.lit("\n"), F.lit(" ")), SKILLS)


@R.add("""SELECT canonical, string_agg(alias, '|' ORDER BY alias) AS aliases FROM (SELECT DISTINCT canonical, alias FROM (SELECT p_brand AS canonical, p_name AS alias FROM part UNION SELECT p_brand, p_type FROM part UNION SELECT p_brand, p_brand FROM part)) GROUP BY canonical""")
def catalog_merge(spark, sf):
    p = table(spark, sf, "part")
    merged = skills.merge_catalogs(p.select(F.col("p_brand").alias("canonical"), F.col("p_name").alias("alias")), p.select(F.col("p_brand").alias("canonical"), F.col("p_type").alias("alias")))
    return merged.select("canonical", F.array_join("aliases", "|").alias("aliases"))


_WORDS_SQL = f"""SELECT source, word, count(*) AS n FROM (SELECT source, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM documents)
          WHERE length(word) >= 3 AND NOT regexp_matches(word, '^[0-9]+$') AND word NOT IN ({", ".join(f"'{w}'" for w in STOPWORDS)}) GROUP BY ALL"""


def _words(spark, sf) -> DataFrame:
    return skills.keyword_counts(table(spark, sf, "documents"), "source", F.col("text"), STOPWORDS)


@R.add(f"SELECT source, word, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, word) AS rank FROM ({_WORDS_SQL})) WHERE rank <= 10")
def keyword_topk(spark, sf):
    return skills.top_by(_words(spark, sf), "source", "word", 10)


@R.add(f"""WITH c AS ({_WORDS_SQL}), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, word) AS rank FROM c),
           t AS (SELECT source, string_agg(word, ',' ORDER BY rank) FILTER (WHERE rank <= 8) AS top, string_agg(word, ',' ORDER BY rank) FILTER (WHERE rank BETWEEN 9 AND 12) AS more FROM r GROUP BY source)
           SELECT d.source AS role_name, count(*) AS job_count, any_value(top) AS common_keywords, any_value(more) AS next_keywords FROM documents d JOIN t USING (source) GROUP BY d.source""")
def role_profiles(spark, sf):
    """Per role: documents, top keywords and the ones that come next."""
    words = _words(spark, sf)
    ordered = lambda: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]), ",")
    top = skills.top_by(words, "source", "word", 8).groupBy("source").agg(ordered().alias("common_keywords"))
    more = skills.next_items(words, "source", "word", 8, 4).groupBy("source").agg(ordered().alias("next_keywords"))
    jobs = table(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("job_count"))
    return jobs.join(top, "source").join(more, "source").withColumnRenamed("source", "role_name")


# A nation's customers stand for a cv, a supplier for a job, a part's brand for a skill.
_OWNED = "SELECT DISTINCT c_nationkey AS cv_id, p_brand AS skill FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE p_size <= 2 AND l_quantity >= 45"
_REQUIRED = "SELECT l_suppkey AS job_id, p_brand AS skill, CASE min(l_returnflag) WHEN 'A' THEN 'preferred' WHEN 'R' THEN 'required' ELSE 'mentioned' END AS importance FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size >= 40 AND l_quantity <= 10 GROUP BY ALL"
_JOBS = "SELECT s_suppkey AS job_id, n_name AS job_family, 'Open: ' || (SELECT any_value(m.n_name) FROM nation m WHERE m.n_nationkey = (s_suppkey % 25)) AS title FROM supplier JOIN nation ON s_nationkey = n_nationkey"
_TARGETS = "SELECT n_nationkey AS cv_id, n_name AS role FROM nation"
_ROLE_JOBS = f"SELECT DISTINCT cv_id, role, job_id FROM ({_TARGETS}) JOIN ({_JOBS}) ON job_family = role OR contains(title, role)"


def _owned(spark, sf) -> DataFrame:
    l = table(spark, sf, "lineitem").where("l_quantity >= 45").select("l_orderkey", "l_partkey")
    p = table(spark, sf, "part").where("p_size <= 2").select("p_partkey", F.col("p_brand").alias("skill"))
    o, c = table(spark, sf, "orders").select("o_orderkey", "o_custkey"), table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("cv_id"))
    return l.join(p, l["l_partkey"] == p["p_partkey"]).join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).select("cv_id", "skill").distinct()


def _required(spark, sf) -> DataFrame:
    l, p = table(spark, sf, "lineitem").where("l_quantity <= 10"), table(spark, sf, "part").where("p_size >= 40")
    g = l.join(p, l["l_partkey"] == p["p_partkey"]).groupBy(F.col("l_suppkey").alias("job_id"), F.col("p_brand").alias("skill")).agg(F.min("l_returnflag").alias("f"))
    return g.select("job_id", "skill", F.when(F.col("f") == "A", "preferred").when(F.col("f") == "R", "required").otherwise("mentioned").alias("importance"))


def _jobs(spark, sf) -> DataFrame:
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation").select("n_nationkey", "n_name")
    named = s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(F.col("s_suppkey").alias("job_id"), F.col("n_name").alias("job_family"))
    return named.join(n, F.col("job_id") % 25 == n["n_nationkey"]).select("job_id", "job_family", F.concat(F.lit("Open: "), F.col("n_name")).alias("title"))


def _targets(spark, sf) -> DataFrame:
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("cv_id"), F.col("n_name").alias("role"))


@R.add(f"""WITH t AS (SELECT job_id, count(DISTINCT skill) AS total FROM ({_REQUIRED}) GROUP BY job_id),
           p AS (SELECT cv_id, job_id, count(DISTINCT skill) AS matched, sum(CASE importance WHEN 'required' THEN 2 WHEN 'preferred' THEN 1 ELSE 0.5 END)::DOUBLE AS w FROM ({_OWNED}) JOIN ({_REQUIRED}) USING (skill) GROUP BY ALL),
           s AS (SELECT cv_id, job_id, matched, total, matched::DOUBLE / total AS coverage, w + 2 * matched::DOUBLE / total AS score FROM p JOIN t USING (job_id) JOIN ({_JOBS}) USING (job_id)),
           r AS (SELECT *, row_number() OVER (PARTITION BY cv_id ORDER BY score DESC, matched DESC, coverage DESC, job_id) AS rank FROM s)
           SELECT cv_id, job_id, matched, total, round(coverage, 6) AS coverage, round(score, 6) AS score, rank FROM r WHERE rank <= 10""")
def graph_recommend(spark, sf):
    """The ten best jobs for each cv."""
    out = match.recommend(_owned(spark, sf), _required(spark, sf), _jobs(spark, sf), 10)
    return out.select("cv_id", "job_id", "matched", "total", F.round("coverage", 6).alias("coverage"), F.round("score", 6).alias("score"), "rank")


@R.add(f"""WITH n AS (SELECT cv_id, skill, count(*) AS n FROM ({_ROLE_JOBS}) JOIN ({_REQUIRED}) USING (job_id) GROUP BY ALL),
           l AS (SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM ({_OWNED}) o WHERE o.cv_id = n.cv_id AND o.skill = n.skill))
           SELECT cv_id, skill, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY cv_id ORDER BY n DESC, skill) AS rank FROM l) WHERE rank <= 10""")
def skill_gap(spark, sf):
    """Skills that a cv's target jobs ask for most and it lacks."""
    pairs = match.role_jobs(_targets(spark, sf), _jobs(spark, sf))
    return match.skill_gap(_owned(spark, sf), _required(spark, sf), pairs, 10)


@R.add(f"""WITH n AS (SELECT cv_id, role, count(DISTINCT job_id) AS open_jobs, list_distinct(list(skill)) AS needed FROM ({_ROLE_JOBS}) JOIN ({_REQUIRED}) USING (job_id) GROUP BY ALL),
           h AS (SELECT cv_id, list(skill) AS have FROM ({_OWNED}) GROUP BY ALL)
           SELECT cv_id, role, coalesce(open_jobs, 0) AS open_jobs, coalesce(len(have), 0) AS owned_skills, coalesce(len(needed), 0) AS needed_skills,
                  round(coalesce(len(list_intersect(needed, have))::DOUBLE / nullif(len(needed), 0), 0), 6) AS known_share
           FROM ({_TARGETS}) LEFT JOIN n USING (cv_id, role) LEFT JOIN h USING (cv_id)""")
def career_path(spark, sf):
    out = match.career_path(_owned(spark, sf), _required(spark, sf), _targets(spark, sf), _jobs(spark, sf))
    return out.withColumn("known_share", F.round("known_share", 6))


_Q = "(SELECT embedding::DOUBLE[] AS q FROM embeddings ORDER BY vec_id LIMIT 1)"
_D = "1 - list_cosine_similarity(embedding::DOUBLE[], q)"


def _with_query(spark, sf) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return e.crossJoin(F.broadcast(e.orderBy("vec_id").limit(1).select(F.col("embedding").alias("q"))))  # one row


@R.add(f"SELECT vec_id, round({_D}, 6) AS distance FROM embeddings, {_Q} ORDER BY {_D}, vec_id LIMIT 20")
def vector_topk(spark, sf):
    return match.top_vectors(_with_query(spark, sf), F.col("q"), 20, "embedding", "vec_id").select("vec_id", F.round("distance", 6).alias("distance"))


@R.add(f"SELECT vec_id, round({_D}, 6) AS distance FROM embeddings, {_Q} WHERE label = 1 ORDER BY {_D}, vec_id LIMIT 20")
def vector_topk_filtered(spark, sf):
    return match.top_vectors(_with_query(spark, sf), F.col("q"), 20, "embedding", "vec_id", F.col("label") == 1).select("vec_id", F.round("distance", 6).alias("distance"))


@R.add(f"SELECT label, arg_min(vec_id, d) AS vec_id, round(min(d), 6) AS distance, round(least(greatest((1 - min(d)) * 100, 0), 100), 2) AS percent FROM (SELECT label, vec_id, {_D} AS d FROM embeddings, {_Q}) GROUP BY label")
def doc_min_distance(spark, sf):
    """The nearest chunk of each document, and its compatibility in percent."""
    e = _with_query(spark, sf).select("label", "vec_id", vector.cosine_distance(F.col("embedding"), F.col("q")).alias("d"))
    best = e.groupBy("label").agg(F.min(F.struct("d", "vec_id")).alias("m"))
    return best.select("label", "m.vec_id", F.round("m.d", 6).alias("distance"), vector.percent(F.col("m.d")).alias("percent"))


@R.add("""WITH n AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / greatest(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 1e-12)) AS u FROM embeddings),
          q AS (SELECT list_transform(list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), lambda z: 0.55 * z[1] + 0.45 * z[2]) AS q FROM (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) a, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1 OFFSET 1) b)
          SELECT vec_id, round(list_inner_product(u, q), 6) AS score FROM n, q ORDER BY list_inner_product(u, q) DESC, vec_id LIMIT 20""")
def blended_query(spark, sf):
    """A blend of two vectors against all normalised ones."""
    e = table(spark, sf, "embeddings")
    two = e.orderBy("vec_id").limit(2).agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("a"))  # two rows
    q = two.select(vector.blend(F.col("a")[0]["embedding"], F.col("a")[1]["embedding"]).alias("q"))
    scored = e.crossJoin(F.broadcast(q)).withColumn("s", vector.dot(vector.l2_normalize(F.col("embedding")), F.col("q")))
    return scored.orderBy(F.col("s").desc(), "vec_id").limit(20).select("vec_id", F.round("s", 6).alias("score"))


@R.add(f"""WITH v AS (SELECT vec_id AS job_id, 1 - ({_D}) AS vs FROM embeddings, {_Q} ORDER BY {_D}, vec_id LIMIT 30), g AS (SELECT vec_id AS job_id, (label + 1) / 20.0 AS gs FROM embeddings ORDER BY label DESC, vec_id LIMIT 30),
           b AS (SELECT job_id, vs, gs, round(0.45 * coalesce(vs, 0) + 0.55 * coalesce(gs, 0), 9) AS s FROM v FULL JOIN g USING (job_id))
           SELECT job_id, round(s, 6) AS score, row_number() OVER (ORDER BY s DESC, (vs IS NOT NULL AND gs IS NOT NULL) DESC, (gs IS NOT NULL) DESC, job_id) AS rank FROM b""")
def hybrid_rank(spark, sf):
    """The best thirty vector and graph candidates in one order."""
    v = match.top_vectors(_with_query(spark, sf), F.col("q"), 30, "embedding", "vec_id").select(F.col("vec_id").alias("job_id"), (1.0 - F.col("distance")).alias("vector_score"))
    g = table(spark, sf, "embeddings").orderBy(F.col("label").desc(), "vec_id").limit(30).select(F.col("vec_id").alias("job_id"), ((F.col("label") + 1) / F.lit(20.0)).alias("graph_score"))
    return match.hybrid_rank(v, g, "job_id", 0.45, 0.55).select("job_id", F.round("score", 6).alias("score"), "rank")


@R.add("""WITH b AS (SELECT item_id, list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda w: length(w) >= 5)) AS terms FROM benchmark),
          d AS (SELECT doc_id, list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda w: length(w) >= 5)) AS terms FROM documents),
          p AS (SELECT item_id, doc_id, count(*) AS hits FROM (SELECT item_id, unnest(terms) AS w FROM b) JOIN (SELECT doc_id, unnest(terms) AS w FROM d) USING (w) GROUP BY ALL),
          s AS (SELECT item_id, doc_id, hits, 1.5 * hits - 2.0 * (1 - hits::DOUBLE / len(b.terms)) AS score FROM p JOIN b USING (item_id))
          SELECT item_id, doc_id, hits, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 3""")
def rerank(spark, sf):
    """Documents for each question by shared terms less their distance; common terms are joined only where they can matter."""
    b, d = _terms(table(spark, sf, "benchmark"), "item_id"), _terms(table(spark, sf, "documents"), "doc_id")
    hits = rank.top_by_terms(rank.term_weights((b, 1.0), key="item_id"), "item_id", d, "doc_id", 3)
    scored = hits.join(b, "item_id").withColumn("hits", F.col("score").cast("long"))
    score = scores.rerank(F.col("hits"), F.lit(0), F.lit(0), 1.0 - F.col("hits") / F.size("terms"))
    return scored.select("item_id", "doc_id", "hits", F.round(score, 6).alias("score"), "rank")


def _terms(df: DataFrame, key: str, least: int = 5) -> DataFrame:
    words = F.filter(F.split(F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " ")), " "), lambda w: F.length(w) >= least)
    return df.select(key, F.array_distinct(words).alias("terms"))


_TOKENS = "list_distinct(list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: length(w) >= {}))"


@R.add(f"""WITH w AS (SELECT item_id, term, sum(w) AS w FROM (SELECT item_id, unnest({_TOKENS.format(4)}) AS term, 1.5::DOUBLE AS w FROM benchmark
             UNION ALL SELECT item_id, unnest(list_sort({_TOKENS.format(3)})[1:60]), 1.2::DOUBLE FROM benchmark UNION ALL SELECT item_id, unnest(CASE item_id % 3 WHEN 0 THEN ['erin', 'para', 'pour'] WHEN 1 THEN ['edon', 'sch'] ELSE ['thon'] END), 2.0::DOUBLE FROM benchmark) GROUP BY ALL),
           d AS (SELECT doc_id, unnest({_TOKENS.format(1)}) AS term FROM documents), s AS (SELECT item_id, doc_id, round(sum(w), 9) AS score FROM w JOIN d USING (term) GROUP BY ALL)
           SELECT item_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 5""")
def rerank_weighted(spark, sf):
    """The five best documents for each question by overlap (1.5), words of its intent (2.0) and focus terms (1.2) together."""
    b, k = table(spark, sf, "benchmark"), F.col("item_id") % 3
    words = lambda *ws: F.array(*[F.lit(w) for w in ws])
    intent = b.select("item_id", F.when(k == 0, words("erin", "para", "pour")).when(k == 1, words("edon", "sch")).otherwise(words("thon")).alias("terms"))
    focus = b.select("item_id", match.focus_terms(F.col("text")).alias("terms"))
    weights = rank.term_weights((_terms(b, "item_id", 4), 1.5), (intent, 2.0), (focus, 1.2), key="item_id")
    best = rank.top_by_terms(weights, "item_id", _terms(table(spark, sf, "documents"), "doc_id", 1), "doc_id", 5)
    return best.select("item_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@R.add("""WITH p AS (SELECT a.vec_id AS query, b.vec_id, round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 12) AS d FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
          r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d, vec_id) AS n FROM p)
          SELECT query, vec_id, source, round(d, 6) AS distance, n AS rank FROM r JOIN documents ON doc_id = vec_id WHERE n <= 5""")
def batch_neighbours(spark, sf):
    """The five nearest vectors of every vector, with the document of each."""
    e = table(spark, sf, "embeddings")
    hits = rank.nearest(e, e, "vec_id", "embedding", 5, apart=True)
    chunks, documents = e.select("vec_id", F.col("vec_id").alias("doc_id")), table(spark, sf, "documents").select("doc_id", "source")
    return rank.with_documents(hits, chunks, documents, "vec_id", "doc_id").select("query", "vec_id", "source", F.round("distance", 6).alias("distance"), "rank")


@R.add("""WITH p AS (SELECT a.vec_id AS query, b.vec_id, b.label, round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 12) AS d FROM embeddings a CROSS JOIN embeddings b WHERE a.vec_id % 50 = 0),
          r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d, vec_id) AS n FROM p), c AS (SELECT query, label, min(d) AS d FROM r WHERE n <= 10 GROUP BY ALL)
          SELECT query, label, round(d, 6) AS distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d, label) AS rank FROM c) WHERE rank <= 3""")
def neighbour_documents(spark, sf):
    """The three nearest documents (labels) of every fiftieth vector, by the nearest of twice as many chunks and more."""
    e = table(spark, sf, "embeddings")
    hits = rank.nearest(e.where("vec_id % 50 = 0"), e, "vec_id", "embedding", 10)
    hits = hits.join(e.select(F.col("vec_id").alias("id"), "label"), "id")
    return rank.nearest_documents(hits, "label", 3).select("query", "label", F.round("distance", 6).alias("distance"), "rank")


_PROFILE = "SELECT c_mktsegment AS role, list_distinct(list(p_brand)) AS skills FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE p_size <= 3 AND l_quantity >= 49 GROUP BY ALL"


@R.add(f"""SELECT cv_id, role, round(0.65 * len(list_intersect(h.skills, p.skills))::DOUBLE / len(p.skills) + 0.15 * (role = 'MACHINERY')::INT, 6) AS score, missing FROM
           (SELECT cv_id, role, h.skills, p.skills, array_to_string(list_sort(list_filter(p.skills, lambda s: NOT list_contains(h.skills, s)))[1:5], ',') AS missing FROM (SELECT cv_id, list(skill) AS skills FROM ({_OWNED}) GROUP BY ALL) h, ({_PROFILE}) p) t(cv_id, role, hs, ps, missing)
           JOIN (SELECT cv_id AS c2, list(skill) AS skills FROM ({_OWNED}) GROUP BY ALL) h ON c2 = cv_id JOIN (SELECT role AS r2, skills FROM ({_PROFILE})) p ON r2 = role""")
def role_inference(spark, sf):
    """How well each role fits each cv, and what it lacks: a fixed handful of profiles is broadcast."""
    l = table(spark, sf, "lineitem").where("l_quantity >= 49")
    p = table(spark, sf, "part").where("p_size <= 3")
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    profiles = l.join(p, l["l_partkey"] == p["p_partkey"]).join(o, l["l_orderkey"] == o["o_orderkey"]).join(c, o["o_custkey"] == c["c_custkey"])
    profiles = profiles.groupBy(F.col("c_mktsegment").alias("role")).agg(F.collect_set("p_brand").alias("needed"))
    have = _owned(spark, sf).groupBy("cv_id").agg(F.collect_set("skill").alias("have"))
    fit = 0.65 * scores.ratio(scores.overlap(F.col("needed"), F.col("have")), F.size("needed")) + 0.15 * (F.col("role") == "MACHINERY").cast("int")
    missing = F.array_join(F.slice(F.array_sort(F.array_except("needed", "have")), 1, 5), ",")
    return have.crossJoin(profiles).select("cv_id", "role", F.round(fit, 6).alias("score"), missing.alias("missing"))


@R.add("""SELECT o_custkey AS cv_id, round(s, 6) AS score, CASE WHEN s >= 85 THEN 'A' WHEN s >= 70 THEN 'B' WHEN s >= 55 THEN 'C' ELSE 'D' END AS grade FROM (
          SELECT o_custkey, 0.35 * least(count(DISTINCT o_orderpriority) / 12.0 * 100, 100) + 0.25 * least(count(*) / 3.0 * 100, 100) + 0.2 * least(count(DISTINCT o_orderstatus) / 4.0 * 100, 100)
                 + 0.1 * least(count(*) FILTER (WHERE o_orderstatus = 'P') / 3.0 * 100, 100) + 0.1 * CASE WHEN min(o_orderpriority) = '1-URGENT' THEN 100 ELSE 40 END AS s FROM orders GROUP BY o_custkey)""")
def cv_score(spark, sf):
    g = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("cv_id")).agg(
        F.countDistinct("o_orderpriority").alias("skills"), F.count(F.lit(1)).alias("years"), F.countDistinct("o_orderstatus").alias("projects"),
        F.count_if(F.col("o_orderstatus") == "P").alias("certs"), F.min("o_orderpriority").alias("best"),
    )
    s = scores.cv_score(F.col("skills"), F.col("years"), F.col("projects"), F.col("certs"), F.col("best") == "1-URGENT")
    return g.select("cv_id", F.round(s, 6).alias("score"), scores.grade(s).alias("grade"))


@R.add("""SELECT doc_id, round((contains(k, 'erin')::INT + contains(k, 'para')::INT + contains(k, 'zzzz')::INT) / 3.0::DOUBLE, 6) AS share FROM (SELECT doc_id, strip_accents(lower(text)) AS k FROM documents)""")
def grounded_share(spark, sf):
    """How many stated facts a text supports."""
    facts = F.array(F.lit("erin"), F.lit("para"), F.lit("zzzz"))
    return table(spark, sf, "documents").select("doc_id", F.round(mention_ratio(F.col("text"), facts), 6).alias("share"))


@R.add("""SELECT doc_id, round((contains(k, 'erin')::INT + contains(k, 'para')::INT + contains(k, 'zzzz')::INT) / 3.0::DOUBLE, 6) AS share FROM (SELECT doc_id, strip_accents(lower(text)) AS k FROM documents)""")
def grounded_share_whole(spark, sf):
    """How many stated facts a whole text supports."""
    facts = F.array(F.lit("erin"), F.lit("para"), F.lit("zzzz"))
    return table(spark, sf, "documents").select("doc_id", F.round(mention_ratio(F.col("text"), facts), 6).alias("share"))


@R.add("""WITH f AS (SELECT label, vec_id, embedding[1] AS s, vec_id % 7 = 0 AS focused FROM embeddings), n AS (SELECT *, count(*) FILTER (WHERE focused) OVER (PARTITION BY label) AS c FROM f)
          SELECT label, vec_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) AS rank FROM n WHERE focused OR c < 3) WHERE rank <= 4""")
def focus_filter(spark, sf):
    """The best hits of each question, focused ones only where there are enough."""
    e = table(spark, sf, "embeddings").select("label", "vec_id", F.col("embedding")[0].alias("s"))
    return match.focus_filter(e, "label", F.col("vec_id") % 7 == 0, [F.col("s").desc(), F.col("vec_id")], 4).select("label", "vec_id", "rank")


@R.add("""WITH f AS (SELECT label, vec_id, embedding[1] AS s, vec_id % 3 = 0 AS focused, vec_id % 3 = 0 AND embedding[2] > 0 AS strong, label % 2 = 0 AS data FROM embeddings),
          n AS (SELECT *, count(*) FILTER (WHERE focused) OVER w AS cf, count(*) FILTER (WHERE strong) OVER w AS cs FROM f WINDOW w AS (PARTITION BY label))
          SELECT label, vec_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) AS rank FROM n WHERE CASE WHEN data AND cs >= 3 THEN strong WHEN cf >= 3 THEN focused ELSE TRUE END) WHERE rank <= 4""")
def focus_filter_strong(spark, sf):
    """For questions of the domain only strong hits, if there are enough, else focused ones, else all."""
    e = table(spark, sf, "embeddings").select("label", "vec_id", F.col("embedding")[0].alias("s"), F.col("embedding")[1].alias("t"))
    focus = F.col("vec_id") % 3 == 0
    return match.focus_filter(e, "label", focus, [F.col("s").desc(), F.col("vec_id")], 4, (F.col("label") % 2 == 0) & focus & (F.col("t") > 0)).select("label", "vec_id", "rank")


@R.add("""WITH u AS (SELECT o_orderkey, unnest(['price', 'day', 'cust']) AS name, unnest([o_totalprice / 500000, extract(day FROM o_orderdate) / 31.0::DOUBLE, (o_custkey % 100) / 100.0::DOUBLE]) AS share FROM orders),
          r AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY share, name) AS n FROM u)
          SELECT o_orderkey, 'worst' AS kind, name, round(share, 8) AS share FROM r WHERE n <= 1 UNION ALL SELECT o_orderkey, 'best', name, round(share, 8) FROM r WHERE n = 3""")
def best_and_worst(spark, sf):
    """The strongest and the weakest part of each score."""
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"), F.dayofmonth("o_orderdate").alias("day"), (F.col("o_custkey") % 100).alias("cust"))
    return match.best_and_worst(o, "o_orderkey", {"price": 500000.0, "day": 31.0, "cust": 100.0}, 1).withColumn("share", F.round("share", 8))


@R.add("""SELECT item_id, array_to_string(list_sort(list_distinct(list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: length(w) >= 3)))[1:60], ',') AS terms FROM benchmark""")
def focus_terms(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.array_join(match.focus_terms(F.col("text")), ",").alias("terms"))


@R.add("""WITH p AS (SELECT n_regionkey AS cv_id, list(n_name ORDER BY n_nationkey) AS names FROM nation GROUP BY ALL)
          SELECT cv_id, array_to_string(list_concat(list_filter(names, lambda n: n IN ('NATION_7', 'NATION_9')), list_filter(names, lambda n: n NOT IN ('NATION_7', 'NATION_9'))), ',') AS ordered,
                 (len(list_intersect(names[1:2], ['NATION_1', 'NATION_5'])) > 0)::INTEGER AS hit FROM p""")
def domain_first(spark, sf):
    """Lists with a domain's entries first, and whether the first two hit."""
    p = table(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("cv_id")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("p"))
    names = F.col("p.n_name")
    domain, truth = F.array(F.lit("NATION_7"), F.lit("NATION_9")), F.array(F.lit("NATION_1"), F.lit("NATION_5"))
    return p.select("cv_id", F.array_join(match.domain_first(names, domain), ",").alias("ordered"), match.hit_at_k(names, truth, 2).alias("hit"))


@R.add("""SELECT item_id, 64 AS size, TRUE AS unit, 1.0::DOUBLE AS self FROM benchmark""")
def hash_encoder(spark, sf):
    """Vectors without a model: their size, length and similarity to themselves."""
    b = table(spark, sf, "benchmark").select("item_id", vector.hash_encode(F.col("text")).alias("v"))
    return b.select("item_id", F.size("v").alias("size"), (F.abs(vector.norm(F.col("v")) - 1.0) < 1e-9).alias("unit"), F.round(vector.cosine(F.col("v"), F.col("v")), 6).alias("self"))


@R.add(f"SELECT vec_id, round(least(greatest((1 - ({_D})) * 100, 0), 100), 2) AS percent FROM embeddings, {_Q}")
def similarity_percent(spark, sf):
    return _with_query(spark, sf).select("vec_id", vector.percent(vector.cosine_distance(F.col("embedding"), F.col("q"))).alias("percent"))


@R.add(f"""SELECT cv_id, array_to_string(list_sort(list_filter((SELECT list_sort(list(DISTINCT p_brand)) FROM part), lambda s: NOT list_contains(h, s)))[1:5], ',') AS missing FROM (SELECT cv_id, list(skill) AS h FROM ({_OWNED}) GROUP BY ALL)""")
def missing_skills(spark, sf):
    """Skills of the catalog that a cv lacks, at most five."""
    have = _owned(spark, sf).groupBy("cv_id").agg(F.collect_set("skill").alias("h"))
    catalog = table(spark, sf, "part").agg(F.collect_set("p_brand").alias("all"))
    return have.crossJoin(F.broadcast(catalog)).select("cv_id", F.array_join(F.slice(F.array_sort(F.array_except("all", "h")), 1, 5), ",").alias("missing"))  # one row


# The full recommender: nations as cvs with years and certificates, suppliers as jobs that may ask for years or nothing.
_CVS = "SELECT n_nationkey AS cv_id, CASE WHEN n_nationkey % 6 < 5 THEN n_nationkey % 6 END AS years FROM nation"
_CERTIFIED = "SELECT DISTINCT n_nationkey AS cv_id, p_brand AS skill FROM nation JOIN part ON p_partkey % 25 = n_nationkey WHERE p_size = 7"
_FEW = f"SELECT cv_id, skill FROM ({_OWNED}) WHERE cv_id % 3 <> 0"
_FULL_JOBS = f"SELECT job_id, job_family, title, CASE WHEN job_id % 7 > 0 THEN job_id % 7 END AS min_years FROM ({_JOBS})"
_ASKED = f"SELECT * FROM ({_REQUIRED}) WHERE job_id % 4 <> 1"


@R.add(f"""WITH p AS (SELECT c.cv_id, j.job_id, c.years, j.min_years, sum((o.skill IS NOT NULL)::INT) AS matched, count(q.skill) AS total,
             sum(CASE WHEN o.skill IS NULL THEN 0 WHEN importance = 'required' THEN 2 WHEN importance = 'preferred' THEN 1 ELSE 0.5 END)::DOUBLE AS w, sum((e.skill IS NOT NULL)::INT) AS cert_matches,
             max((contains(lower(job_family), lower(role)) OR contains(lower(title), lower(role)))::INT) AS in_role
           FROM ({_CVS}) c CROSS JOIN ({_FULL_JOBS}) j LEFT JOIN ({_TARGETS}) t ON t.cv_id = c.cv_id LEFT JOIN ({_ASKED}) q ON q.job_id = j.job_id
           LEFT JOIN ({_FEW}) o ON o.cv_id = c.cv_id AND o.skill = q.skill LEFT JOIN ({_CERTIFIED}) e ON e.cv_id = c.cv_id AND e.skill = q.skill GROUP BY ALL),
           s AS (SELECT *, (matched > 0)::INTEGER AS has_match, coalesce(matched::DOUBLE / nullif(total, 0), 0) AS coverage FROM p),
           r AS (SELECT *, round(w + 2 * coverage + CASE WHEN in_role = 1 THEN 0.2 ELSE 0 END + CASE WHEN years IS NULL THEN 0 WHEN min_years IS NULL THEN 0.05 WHEN years >= min_years THEN 0.1 ELSE 0 END + 0.05 * cert_matches, 9) AS score FROM s)
           SELECT cv_id, job_id, has_match, matched::BIGINT AS matched, total, round(coverage, 6) AS coverage, cert_matches::BIGINT AS cert_matches, round(score, 6) AS score, rank FROM (
             SELECT *, row_number() OVER (PARTITION BY cv_id ORDER BY has_match DESC, score DESC, matched DESC, coverage DESC, cert_matches DESC, job_id) AS rank FROM r) WHERE rank <= 40""")
def graph_recommend_all(spark, sf):
    """The forty best of all jobs for each cv, with role, experience and certificate bonuses, and jobs without a match."""
    n, p = table(spark, sf, "nation"), table(spark, sf, "part").where("p_size = 7")
    cvs = n.select(F.col("n_nationkey").alias("cv_id"), F.when(F.col("n_nationkey") % 6 < 5, F.col("n_nationkey") % 6).alias("years"))
    certified = n.join(p, F.col("p_partkey") % 25 == F.col("n_nationkey")).select(F.col("n_nationkey").alias("cv_id"), F.col("p_brand").alias("skill")).distinct()
    jobs = _jobs(spark, sf).withColumn("min_years", F.when(F.col("job_id") % 7 > 0, F.col("job_id") % 7))
    required = _required(spark, sf).where("job_id % 4 <> 1")
    out = match.recommend_all(cvs, _owned(spark, sf).where("cv_id % 3 <> 0"), required, jobs, _targets(spark, sf), 40, certified)
    return out.withColumns({"coverage": F.round("coverage", 6), "score": F.round("score", 6)})


_INFER_CVS = f"""SELECT n_nationkey AS cv_id, list_distinct(list(skill) FILTER (WHERE skill IS NOT NULL)) AS skills, CASE n_nationkey % 4 WHEN 0 THEN ' machinery' WHEN 1 THEN 'BUILDING' END AS target_role,
               any_value(lower(p_name || ' ' || p_type)) AS signal, CASE n_nationkey % 5 WHEN 0 THEN 'automobile' WHEN 1 THEN 'none such' END AS preferred
               FROM nation JOIN part ON p_partkey = n_nationkey LEFT JOIN ({_OWNED}) ON cv_id = n_nationkey GROUP BY n_nationkey"""
_INFER_PROFILES = """SELECT c_mktsegment AS role, list_distinct(list(p_brand)) AS skills, list_distinct(list(split_part(p_name, ' ', 1))) AS keywords FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
                     JOIN part ON l_partkey = p_partkey WHERE p_size <= 3 AND l_quantity >= 49 GROUP BY ALL"""


@R.add(f"""WITH p AS (SELECT c.*, p.role, p.skills AS needed, list_filter(p.keywords, lambda w: length(w) >= 3) AS words FROM ({_INFER_CVS}) c CROSS JOIN ({_INFER_PROFILES}) p),
           s AS (SELECT cv_id, role, coalesce(trim(preferred), '') AS wish, round(0.65 * len(list_intersect(needed, coalesce(skills, [])))::DOUBLE / len(needed)
                   + 0.2 * coalesce(len(list_filter(words, lambda w: contains(signal, w)))::DOUBLE / nullif(len(words), 0), 0) + 0.15 * coalesce(lower(trim(target_role)) = lower(trim(role)), false)::INT, 4) AS confidence FROM p),
           r AS (SELECT *, row_number() OVER (PARTITION BY cv_id ORDER BY confidence DESC, role) AS rank FROM s),
           b AS (SELECT *, first_value(role) OVER w AS selected_role, first_value(confidence) OVER w AS best FROM r WINDOW w AS (PARTITION BY cv_id ORDER BY (wish <> '' AND lower(role) = lower(wish)) DESC, rank))
           SELECT cv_id, role, confidence, rank, selected_role, best < 0.45 AND wish = '' AS requires_confirmation FROM b WHERE rank <= 3""")
def role_inference_full(spark, sf):
    """The three best roles of each cv by skills, keywords and title, the one selected, and whether that needs confirmation."""
    n, part = table(spark, sf, "nation"), table(spark, sf, "part")
    cvs = n.join(part, F.col("p_partkey") == F.col("n_nationkey")).select(
        F.col("n_nationkey").alias("cv_id"), F.when(F.col("n_nationkey") % 4 == 0, " machinery").when(F.col("n_nationkey") % 4 == 1, "BUILDING").alias("target_role"),
        F.concat_ws(" ", "p_name", "p_type").alias("signal"), F.when(F.col("n_nationkey") % 5 == 0, "automobile").when(F.col("n_nationkey") % 5 == 1, "none such").alias("preferred"),
    )
    cvs = cvs.join(_owned(spark, sf).groupBy("cv_id").agg(F.collect_set("skill").alias("skills")), "cv_id", "left")
    l, p = table(spark, sf, "lineitem").where("l_quantity >= 49"), part.where("p_size <= 3")
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    sold = l.join(p, l["l_partkey"] == p["p_partkey"]).join(o, l["l_orderkey"] == o["o_orderkey"]).join(c, o["o_custkey"] == c["c_custkey"])
    profiles = sold.groupBy(F.col("c_mktsegment").alias("role")).agg(F.collect_set("p_brand").alias("skills"), F.collect_set(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("keywords"))
    return match.infer_roles(cvs, profiles, 3)


@R.add("""WITH e AS (SELECT vec_id // 4 AS grp, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 3 <> 0), u AS (SELECT grp, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e),
          m AS (SELECT grp, i, avg(x) AS x FROM u GROUP BY ALL) SELECT grp, count(*) AS size, round(sum(x), 6) AS total, round(sum(x * i), 5) AS moment FROM m GROUP BY grp""")
def mean_pooling(spark, sf):
    """Four token vectors in one, those that are masked left out."""
    e = table(spark, sf, "embeddings").select(F.expr("vec_id div 4").alias("grp"), F.struct("vec_id", "embedding").alias("e"))
    lists = e.groupBy("grp").agg(F.array_sort(F.collect_list("e")).alias("es"))  # four each
    mask = F.transform("es.vec_id", lambda k: (k % 3 != 0).cast("int"))
    pooled = lists.select("grp", vector.mean_pool(F.col("es.embedding"), mask).alias("v")).where("v is not null")
    moment = F.aggregate(F.transform("v", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return pooled.select("grp", F.size("v").cast("long").alias("size"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.round(moment, 5).alias("moment"))


@R.add(f"""SELECT doc_id, coalesce(string_agg(DISTINCT skill, ',' ORDER BY skill) FILTER (WHERE importance = 'required'), '') AS required, string_agg(DISTINCT skill, ',' ORDER BY skill) AS skills FROM ({RECORDS_SQL}) GROUP BY doc_id""")
def skill_lists(spark, sf):
    """The skills of each job, all of them and the required ones."""
    lists = skills.lists_by_importance(_records(spark, sf), ["doc_id"], ["required"])
    return lists.select("doc_id", F.array_join("skills", ",").alias("skills"), F.array_join("required", ",").alias("required"))


@R.add(f"""SELECT doc_id, coalesce(string_agg(DISTINCT skill, ',' ORDER BY skill), '') AS skills FROM (SELECT doc_id, {_KEY.format("text")} AS key FROM documents) LEFT JOIN (VALUES ('Erin', 'erin'), ('Edon', 'edon'), ('Dotted', '.edon')) v(skill, alias)
           ON regexp_matches(key, '(^|[^a-z0-9_ß])' || replace(alias, '.', '\\.') || '($|[^a-z0-9_ß])') AND alias NOT LIKE '.%' GROUP BY doc_id""")
def skills_compat(spark, sf):
    """Skills by word boundaries: a name that begins with a sign is not found after a space."""
    found = skills_in(match_key(F.col("text")), {"Edon": ["edon"], "Erin": ["erin"], "Dotted": [".edon"]}, compat=True)
    return table(spark, sf, "documents").select("doc_id", F.array_join(F.array_sort(F.filter(found, lambda s: s != "Dotted")), ",").alias("skills"))


@R.add("""WITH h AS (SELECT vec_id, label, 'http://job/' || (vec_id % 300)::VARCHAR AS url, 'chunk ' || vec_id::VARCHAR AS content FROM embeddings),
          d AS (SELECT 'http://job/' || p_partkey::VARCHAR AS url, CASE WHEN p_size > 10 THEN p_name END AS requirements, p_size AS years FROM part WHERE p_partkey < 250)
          SELECT vec_id, url, years, CASE WHEN coalesce(requirements, '') <> '' THEN requirements ELSE content END AS shown FROM h LEFT JOIN d USING (url)""")
def hit_details(spark, sf):
    """Retrieved chunks with the details of their jobs, or their own content where a job is not known or says nothing."""
    url = lambda k: F.concat(F.lit("http://job/"), k.cast("string"))
    hits = table(spark, sf, "embeddings").select("vec_id", url(F.col("vec_id") % 300).alias("url"), F.concat(F.lit("chunk "), F.col("vec_id").cast("string")).alias("content"))
    part = table(spark, sf, "part").where("p_partkey < 250")
    details = part.select(url(F.col("p_partkey")).alias("url"), F.when(F.col("p_size") > 10, F.col("p_name")).alias("requirements"), F.col("p_size").alias("years"))
    return match.hit_details(hits, details, "url", "content", "requirements").select("vec_id", "url", "years", "shown")
