"""Queries whose vocabularies are tables: dictionaries of names, title synonyms, families, tags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import dictionary, skills, titles
from .base import STOPWORDS, Registry, spread, table
from .matching import _KEY

R = Registry()
_FLAT = _KEY.format("replace(text, chr(10), ' ')")
_EDGE = "[^a-z0-9_ß]"


@R.add(f"""WITH k AS (SELECT doc_id, source, {_FLAT} AS key FROM documents), w AS (SELECT item_id, string_split({_FLAT}, ' ') AS ws FROM benchmark),
           v AS (SELECT DISTINCT 'item ' || item_id AS name, ws[i] || ' ' || ws[i + 1] AS alias FROM (SELECT item_id, ws, unnest(range(1, len(ws))) AS i FROM w)),
           h AS (SELECT DISTINCT doc_id, source, name FROM k JOIN v ON contains(key, alias) AND regexp_matches(key, '(^|{_EDGE})' || regexp_escape(alias) || '($|{_EDGE})'))
           SELECT name AS skill, count(*) AS mentions, count(DISTINCT source) AS roles FROM h GROUP BY name HAVING count(*) >= 3 OR count(DISTINCT source) >= 2""")
def dictionary_support(spark, sf):
    """Which passages of the benchmark have a pair of words in which documents: a vocabulary of thousands of aliases in one join."""
    flat = lambda: text.match_key(F.replace("text", F.lit("\n"), F.lit(" ")))
    b = table(spark, sf, "benchmark").select("item_id", F.split(flat(), " ").alias("ws")).where(F.size("ws") > 1)
    pairs = F.transform(F.sequence(F.lit(0), F.size("ws") - 2), lambda i: F.concat_ws(" ", F.get("ws", i), F.get("ws", i + 1)))
    vocabulary = b.select(F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("name"), F.explode(pairs).alias("alias"))
    return skills.catalog_support(table(spark, sf, "documents"), "source", F.replace("text", F.lit("\n"), F.lit(" ")), vocabulary, 3, 2)


@R.add("""SELECT s_suppkey, array_to_string(list_transform(list_sort(list_distinct(list_filter([k % 25, k * 7 % 25, CASE WHEN k % 25 BETWEEN 1 AND 2 THEN k % 25 * 10 END], lambda x: x IS NOT NULL))), lambda x: 'NATION_' || x), ', ') AS places
          FROM (SELECT s_suppkey, s_suppkey::BIGINT AS k FROM supplier)""")
def place_names(spark, sf):
    """The nations that composed addresses name, in the order of the nation table: NATION_1 is not in NATION_10."""
    k = F.col("s_suppkey")
    n = lambda x: x.cast("string")
    address = F.concat(F.lit("Offices: NATION_"), n(k % 25), F.lit(" and nation_"), n(k * 7 % 25), F.lit(", not NATION_"), n(k % 25), F.lit("0."))
    places = table(spark, sf, "nation").select(F.col("n_name").alias("name"), F.col("n_name").alias("alias"), F.col("n_nationkey").alias("nth"))
    s = table(spark, sf, "supplier").select("s_suppkey", text.match_key(address).alias("key"))
    return dictionary.name_lists(s, ["s_suppkey"], F.col("key"), places).select("s_suppkey", F.array_join("names", ", ").alias("places"))


@R.add("""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS word FROM benchmark)
          SELECT word, count(*) AS documents FROM documents JOIN w ON contains(lower(text), word) GROUP BY word""")
def contained_words(spark, sf):
    """In how many documents each word of the benchmark stands, inside other words too."""
    words = table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{4,})"))).alias("word"))
    d = table(spark, sf, "documents").select("doc_id", F.lower("text").alias("text"))
    return dictionary.contained_in(d, "doc_id", "text", words, "word").groupBy("word").agg(F.count(F.lit(1)).alias("documents"))


def _nouns(spark, sf) -> DataFrame:
    """(name, alias, nth): the nouns of part names are roles, and so are whole names of red parts."""
    p = table(spark, sf, "part").select("p_name", F.split_part("p_name", F.lit(" "), F.lit(2)).alias("noun"))
    whole = p.where("p_name like 'red %'").select(F.initcap("p_name").alias("name"), F.col("p_name").alias("alias"))
    return p.select(F.initcap("noun").alias("name"), F.col("noun").alias("alias")).unionByName(whole).distinct().withColumn("nth", F.lit(0))


_NOUNS = """SELECT DISTINCT upper(noun[1]) || noun[2:] AS name, noun AS alias FROM (SELECT split_part(p_name, ' ', 2) AS noun FROM part)
            UNION SELECT 'Red ' || upper(noun[1]) || noun[2:], 'red ' || noun FROM (SELECT split_part(p_name, ' ', 2) AS noun FROM part WHERE p_name LIKE 'red %')"""


@R.add(f"""WITH t AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Senior ' || p_name WHEN 3 THEN p_type ELSE p_name END AS surface, CASE p_partkey % 4 WHEN 3 THEN lower(p_type) ELSE p_name END AS key FROM part),
           s AS (SELECT key, arg_max(name, length(alias)) AS name FROM (SELECT DISTINCT key FROM t) JOIN ({_NOUNS}) v ON contains(key, alias) GROUP BY key),
           k AS (SELECT key, min(name) AS name FROM (SELECT DISTINCT key FROM t) JOIN (SELECT DISTINCT p_type[1] || lower(p_type[2:]) AS name, lower(p_type) AS alias FROM part WHERE p_type LIKE '%M%') ON contains(key, alias) GROUP BY key)
           SELECT p_partkey, surface, coalesce(s.name, k.name, surface) AS canonical FROM t LEFT JOIN s USING (key) LEFT JOIN k USING (key)""")
def title_canonical(spark, sf):
    """Readable titles and roles of composed titles, by a table of synonyms and one of keywords."""
    p, k = table(spark, sf, "part"), F.col("p_partkey") % 4
    title = F.when(k == 0, F.concat(F.lit("[HOT] Senior "), "p_name", F.lit(" - Up to 2000$"))).when(k == 1, F.concat("p_name", F.lit(" ABC-"), (F.col("p_size") + 100).cast("string")))
    title = title.when(k == 2, F.concat("p_name", F.lit(" | Remote"))).otherwise(F.concat("p_type", F.lit(" ("), "p_brand", F.lit(")")))
    keywords = p.where("p_type like '%M%'").select(F.initcap("p_type").alias("name"), F.lower("p_type").alias("alias")).distinct()
    return titles.canonical_titles(spread(p.select("p_partkey", title.alias("title"))), ["p_partkey"], F.col("title"), _nouns(spark, sf), keywords)


_HINTS = "SELECT DISTINCT 'family ' || (item_id % 4) AS name, unnest(regexp_extract_all(lower(text), '[a-z]{6,}')) AS alias, (item_id % 4) AS nth FROM benchmark"


@R.add(f"""WITH h AS (SELECT doc_id, name, nth, count(DISTINCT alias) AS n FROM (SELECT doc_id, {_FLAT} AS key FROM documents) JOIN ({_HINTS}) ON contains(key, alias) GROUP BY ALL),
           b AS (SELECT doc_id, name FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, nth) AS rn FROM h) WHERE rn = 1),
           t AS (SELECT doc_id, CASE WHEN contains(source, 'src1') THEN 'family 1' WHEN contains(source, '2') THEN 'family 2' ELSE 'unknown' END AS t, coalesce(b.name, 'unknown') AS d FROM documents LEFT JOIN b USING (doc_id))
           SELECT doc_id, CASE WHEN t <> 'unknown' THEN t ELSE d END AS family, CASE WHEN t <> 'unknown' AND t = d THEN 'title+description' WHEN t <> 'unknown' AND d <> 'unknown' THEN 'title_priority'
                  WHEN t <> 'unknown' THEN 'title' WHEN d <> 'unknown' THEN 'description' ELSE 'unknown' END AS source FROM t""")
def family_resolve(spark, sf):
    """Families by the source's name, else by the hints that a text has most of."""
    hints = table(spark, sf, "benchmark").select(F.concat(F.lit("family "), (F.col("item_id") % 4).cast("string")).alias("name"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{6,})"))).alias("alias"), (F.col("item_id") % 4).alias("nth"))
    of_titles = spark.createDataFrame([("family 1", "src1", 0), ("family 2", "2", 1)], "name string, alias string, nth int")
    return titles.families(table(spark, sf, "documents"), "doc_id", F.col("source"), F.replace("text", F.lit("\n"), F.lit(" ")), of_titles, hints.distinct())


@R.add(f"""WITH p AS (SELECT *, lower(p_type) || ' ' || lower(p_brand) || ' ' || p_name AS every, split_part(p_name, ' ', 2) AS noun FROM part),
           c AS (SELECT every, min({{'l': -length(alias), 'a': alias}}).a AS domain FROM (SELECT DISTINCT every FROM p) JOIN (SELECT DISTINCT split_part(p_name, ' ', 1) AS alias FROM part) ON contains(every, alias) GROUP BY every),
           s AS (SELECT every, string_agg(alias, '/' ORDER BY length(alias) DESC, alias) AS specialties FROM (SELECT DISTINCT every FROM p) JOIN (SELECT DISTINCT lower(p_type) AS alias FROM part) ON contains(every, alias) GROUP BY every),
           r AS (SELECT p_name, arg_max(name, length(alias)) AS role FROM (SELECT DISTINCT p_name FROM part) JOIN ({_NOUNS}) ON contains(p_name, alias) GROUP BY p_name)
           SELECT p_partkey, 'Maker ' || substr(p_brand, 7) || ' | ' || role AS roles, domain AS domains, specialties, 2 AS n_parts FROM p JOIN c USING (every) JOIN s USING (every) JOIN r USING (p_name)""")
def tags_structured(spark, sf):
    """Roles, domains and specialties of composed tag fields; the role of the first tag stands in its parentheses."""
    p = table(spark, sf, "part")
    tags = p.select("p_partkey", F.concat("p_type", F.lit(" ("), "p_brand", F.lit(");  "), "p_name", F.lit("\n")).alias("tags"))
    makers = p.select(F.concat(F.lit("Maker "), F.substr("p_brand", F.lit(7))).alias("name"), F.lower("p_brand").alias("alias"), F.lit(0).alias("nth")).distinct()
    own = lambda c: p.select(c.alias("name"), c.alias("alias")).distinct()
    out = titles.structured_tags(tags, "p_partkey", F.col("tags"), _nouns(spark, sf).unionByName(makers), own(F.split_part("p_name", F.lit(" "), F.lit(1))), own(F.lower("p_type")))
    return out.select("p_partkey", F.array_join("roles", " | ").alias("roles"), F.array_join("domains", "/").alias("domains"), F.array_join("specialties", "/").alias("specialties"), F.size("parts").alias("n_parts"))


_PROFILE_KEY = _KEY.format("text")


@R.add(f"""WITH d AS (SELECT doc_id, upper(source[1]) || source[2:] AS role, lower(text) AS low, {_PROFILE_KEY} AS key, CASE n_chars % 4 WHEN 0 THEN 'No requirement' WHEN 1 THEN '<1 year' WHEN 2 THEN 'Unknown' ELSE (n_chars % 3 + 1) || ' years' END AS pattern FROM documents),
           v AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{{7,}}')) AS skill FROM benchmark),
           s AS (SELECT role, skill, count(*) AS n FROM (SELECT DISTINCT doc_id, role, unnest(regexp_extract_all(key, '[a-z0-9_ß]+')) AS skill FROM d) JOIN v USING (skill) GROUP BY ALL),
           j AS (SELECT role, count(*) AS job_count FROM d GROUP BY role HAVING count(*) >= 5),
           k AS (SELECT role, word AS item, count(*) AS n FROM (SELECT role, unnest(regexp_extract_all(low, '[a-z0-9]+')) AS word FROM d) WHERE length(word) >= 3 AND NOT regexp_matches(word, '^[0-9]+$') AND word NOT IN ({", ".join(f"'{w}'" for w in STOPWORDS)}) GROUP BY ALL),
           e AS (SELECT role, pattern AS item, count(*) AS n FROM d GROUP BY ALL),
           rs AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY n DESC, skill) AS place FROM s),
           rk AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY n DESC, item) AS place FROM k),
           re AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY n DESC, item) AS place FROM e),
           g AS (SELECT skill, row_number() OVER (ORDER BY sum(n) DESC, skill) AS place FROM s GROUP BY skill),
           nx AS (SELECT role, skill, 0 AS late, place FROM rs WHERE place BETWEEN 9 AND 12
                  UNION ALL SELECT j.role, g.skill, 1, g.place FROM j CROSS JOIN g WHERE NOT EXISTS (SELECT 1 FROM rs WHERE rs.role = j.role AND rs.skill = g.skill AND rs.place <= 12)),
           nr AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY late, place) AS rn FROM nx)
           SELECT j.role AS role_name, job_count, coalesce((SELECT string_agg(skill, ',' ORDER BY place) FROM rs WHERE rs.role = j.role AND place <= 8), '') AS common_skills,
                  coalesce((SELECT string_agg(item, ',' ORDER BY place) FROM rk WHERE rk.role = j.role AND place <= 8), '') AS common_keywords,
                  (SELECT string_agg(item, ',' ORDER BY place) FROM re WHERE re.role = j.role AND place <= 5) AS common_experience_patterns,
                  coalesce((SELECT string_agg(skill, ',' ORDER BY rn) FROM nr WHERE nr.role = j.role AND rn <= 4), '') AS recommended_next_skills FROM j""")
def role_profiles_full(spark, sf):
    """Whole profiles: skills by a vocabulary of hundreds, keywords, experience patterns, what to learn next; five jobs at least."""
    k = F.col("n_chars")
    asked = F.when(k % 4 == 0, "Không yêu cầu kinh nghiệm").when(k % 4 == 1, "Dưới 1 năm").when(k % 4 == 2, "").otherwise(F.concat((k % 3 + 1).cast("string"), F.lit(" năm")))
    words = table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{7,})"))).alias("name")).distinct().withColumn("alias", F.col("name"))
    items = skills.role_items(table(spark, sf, "documents"), F.col("source"), F.col("text"), asked, words, STOPWORDS)
    out = skills.profiles(items, least_jobs=5)
    lists = [F.array_join(c, ",").alias(c) for c in ("common_skills", "common_keywords", "common_experience_patterns", "recommended_next_skills")]
    return out.select("role_name", "job_count", *lists)
