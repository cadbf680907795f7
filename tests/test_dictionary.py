"""Dictionary and containment joins against patterns and plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from talentlake.functions import text as rules
from talentlake.functions import titles as columns
from talentlake.functions.skills import skills_in
from talentlake.operators import dictionary, match, titles
from talentlake.plans import catalog

ALIASES = {"C++": ["c++"], "NET": [".net"], "CSharp": ["c#"], "Java": ["java"], "With": ["with the", "with"], "R": ["r"], "Node": ["node.js", "node"], "Data": ["data engineer", "data"], "Gone": [""]}
TEXTS = [
    "c++/java and asp.net", ".net, c++11 c#", "java-script with  the node.js", "javascript r", "R&D r/w Data Engineer data", "", None, "c", "node", "with", "the with the the", "x.net .net",
    "c+++ ++c c++", "data engineer", "größe r.", "über data", "node.jsx node.js", "c# c#7", "r" * 50,
]


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(1)
    parts = ["java", "c++", ".net", "c#", "r", "node.js", "data", "engineer", "with", "the", "/", "-", ".", "x", "7"]
    more = ["".join(rng.choice(parts) + rng.choice(["", " ", " "]) for _ in range(rng.randint(1, 12))) for _ in range(150)]
    return spark.createDataFrame(list(enumerate(TEXTS + more)), "id int, text string").withColumn("key", rules.match_key(F.col("text")))


def test_equal_to_one_pattern_per_name(texts):
    """The n-gram join finds what guarded patterns find."""
    vocabulary = {k: [a for a in v if a] for k, v in ALIASES.items() if v != [""]}
    want = {r.id: sorted(r.s) for r in texts.select("id", skills_in(F.col("key"), vocabulary).alias("s")).collect() if r.s}
    got = {}
    for r in dictionary.names_in(texts, ["id"], F.col("key"), ALIASES).collect():
        got.setdefault(r.id, []).append(r.name)
    assert {k: sorted(v) for k, v in got.items()} == want


def test_names_come_in_order_of_the_vocabulary(texts):
    lists = {r.id: r.names for r in dictionary.name_lists(texts, ["id"], F.col("key"), ALIASES).collect()}
    assert lists[4] == ["R", "Data"] and lists[0] == ["C++", "Java"] and 6 not in lists


def test_longest_alias_wins(texts):
    got = sorted((r.place, r.name, r.alias) for r in dictionary.longest_names(texts, ["id"], F.col("key"), ALIASES).where("id = 10").collect())
    assert [(n, a) for _, n, a in got] == [("With", "with the")]
    every = dictionary.longest_names(texts, ["id"], F.col("key"), ALIASES).where("id = 4").collect()
    assert sorted((r.place, r.alias) for r in every)[-2:] == [(8, "data engineer"), (12, "data")]


def test_empty_vocabulary_and_texts(spark, texts):
    none = spark.createDataFrame([], "name string, alias string")
    assert dictionary.occurrences(texts, F.col("key"), none).count() == 0
    assert dictionary.names_in(texts.limit(0), ["id"], F.col("key"), ALIASES).count() == 0
    assert dictionary.contained(texts, "text", none, "alias").count() == 0
    assert dictionary.contained_in(texts, "id", "text", none, "alias").count() == 0


def test_contained_is_contains(spark):
    rng = random.Random(7)
    some = lambda n: "".join(rng.choice("abcd é") for _ in range(n))
    texts = [some(rng.randint(0, 30)) for _ in range(120)] + [None, "", "aaaaaa", "aaaaaa"]
    words = [some(rng.randint(0, 6)) for _ in range(80)] + [None, "", "a", "aa", "zzz", "aaaaaaa"]
    t = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    w = spark.createDataFrame([(x,) for x in words], "word string")
    want = {(x, y) for x in texts if x for y in words if y and y in x}
    assert {tuple(r) for r in dictionary.contained(t, "text", w, "word").collect()} == want
    rows = [tuple(r) for r in dictionary.contained_in(t, "id", "text", w, "word").collect()]
    assert sorted(rows) == sorted({(i, y) for i, x in enumerate(texts) if x for y in words if y and y in x})


def test_no_nested_loops(spark):
    """Jobs meet roles by q-grams."""
    jobs = spark.createDataFrame([(1, "data", "Open: analyst"), (2, "x", "analyst lead"), (3, "analyst", "other")], "job_id int, job_family string, title string")
    targets = spark.createDataFrame([(7, "analyst"), (8, "none")], "cv_id int, role string")
    pairs = match.role_jobs(targets, jobs)
    assert "NestedLoop" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.cv_id, r.job_id) for r in pairs.collect()) == [(7, 1), (7, 2), (7, 3)]


def vocabulary(spark, mapping):
    return dictionary.as_vocabulary(spark, mapping)


def test_titles_agree_with_the_column_rules(spark):
    names = ["[HOT] Senior Data Analyst (Python) - Hà Nội - Up to 2000$", "Java Developer ABC-123", "Kỹ sư kiểm thử phần mềm", "Data Engineer | Remote", "Nhân viên bán hàng", "Product Analyst (thưởng cao)", "", None]
    df = spark.createDataFrame([(i, t, "builds dashboard and report pages" if i in (3, 4) else "") for i, t in enumerate(names)], "id int, title string, text string")
    synonyms, keywords = vocabulary(spark, {}), vocabulary(spark, columns.KEYWORDS)
    synonyms = spark.createDataFrame([(role, alias, i) for i, (alias, role) in enumerate(columns.SYNONYMS.items())], "name string, alias string, nth int")
    want = {r.id: (r.s, r.c) for r in df.select("id", columns.title_surface(F.col("title")).alias("s"), columns.canonical_title(F.col("title")).alias("c")).collect()}
    assert {r.id: (r.surface, r.canonical) for r in titles.canonical_titles(df, ["id"], F.col("title"), synonyms, keywords).collect()} == want
    rule = columns.job_family(columns.title_surface(F.col("title")), F.col("text"))
    want = {r.id: (r.f.family, r.f.source) for r in df.select("id", rule.alias("f")).collect()}
    got = titles.families(df, "id", columns.title_surface(F.col("title")), F.col("text"), vocabulary(spark, columns.FAMILIES), vocabulary(spark, columns.FAMILY_HINTS))
    assert {r.id: (r.family, r.source) for r in got.collect()} == want


def test_tags_agree_with_the_column_rules(spark):
    df = spark.createDataFrame([(1, "Data Engineer (Big Data);  Python developer\nBanking"), (2, "QA (tester)"), (3, None), (4, "retail; e-commerce java sql")], "id int, tags string")
    want = {r.id: r.t for r in df.select("id", columns.tags_structured(F.col("tags")).alias("t")).collect()}
    role = spark.createDataFrame([(n, a, 0) for a, n in columns.ROLES.items()], "name string, alias string, nth int")
    own = lambda words: spark.createDataFrame([(w, w, i) for i, w in enumerate(words)], "name string, alias string, nth int")
    for r in titles.structured_tags(df, "id", F.col("tags"), role, own(columns.DOMAINS), own(columns.SPECIALTIES)).collect():
        w = want[r.id]
        assert (r.parts, r.roles, r.model_text) == (w.parts, w.roles, w.model_text)
        assert r.domains == w.domains[:1] and sorted(r.specialties) == sorted(w.specialties)


def test_long_lists_of_lines_take_seconds(spark):
    import time

    lines = "\n".join(f"a line with the number {i % 60_000}" for i in range(100_000))
    df = spark.createDataFrame([(lines,)], "text string")
    start = time.perf_counter()
    kept = df.select(rules.dedup_lines(F.col("text")).alias("t")).first().t
    assert kept.count("\n") == 59_999 and kept.startswith("a line with the number 0\n") and time.perf_counter() - start < 30


def test_dedup_keeps_the_first_in_order(spark):
    df = spark.createDataFrame([(["b", "A", "a", None, "B", "c", "a"],)], "x array<string>")
    assert df.select(rules.dedup_by(F.col("x"), lambda e: F.lower(e)).alias("k")).first().k == ["b", "A", "c"]
    assert re.fullmatch("b\nshort\nshort", df.select(rules.dedup_lines(F.lit("b\nshort\n\nshort")).alias("t")).first().t)


def test_words_meet_tokens_and_not_texts(spark, monkeypatch):
    """Words without a space are looked for in distinct tokens: no whole text goes through the join by grams for them."""
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab c\n\td ") for _ in range(300)) for _ in range(40)] + [None, "", " a b"]
    words = ["ab", "a", "d a", "ca", "\td", "abab", "c\n", "zz", ""]
    met, seen = dictionary._meetings, []

    def watched(rows, ids, text, given, word, gram):
        seen.append((max((len(r[0]) for r in rows.select(text).collect() if r[0]), default=0), {r[0] for r in given.select(word).collect()}))
        return met(rows, ids, text, given, word, gram)

    monkeypatch.setattr(dictionary, "_meetings", watched)
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = sorted(map(tuple, dictionary.contained_in(df, "id", "text", spark.createDataFrame([(w,) for w in words], "w string"), "w").collect()))
    assert got == sorted((i, w) for i, t in enumerate(texts) for w in words if w and t and w in t)
    assert all(length < 100 or all(" " in w or "\n" in w or "\t" in w for w in given) for length, given in seen)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["skill_records", "skill_lists", "role_skill_stats", "role_profiles_full", "dictionary_support", "catalog_support"])
def test_the_vocabulary_is_broadcast_and_not_the_texts(spark, name):
    """A vocabulary of unknown size counts as larger than all texts, whose runs were then broadcast, or exchanged."""
    plan = plan_of(catalog.QUERIES[name](spark, "/root/testdata/sf0.001"))
    joins = [line for line in plan.splitlines() if "Join [_gram" in line]
    assert joins and all("BroadcastHashJoin" in j and "BuildRight" in j for j in joins), plan


def test_skill_lists_read_the_texts_once(spark):
    plan = plan_of(catalog.QUERIES["skill_lists"](spark, "/root/testdata/sf0.001"))
    assert plan.count("documents.parquet") == 1


def test_places_of_long_and_short_aliases(spark):
    df = spark.createDataFrame([(1, "a b a b c"), (2, "+a b c"), (3, "a b cc")], "id int, t string")
    got = {(r.id, r.alias, r.place) for r in dictionary.occurrences(df, F.col("t"), {"A": ["a b c"], "B": ["b"], "P": ["+"]}).collect()}
    assert got == {(1, "b", 2), (1, "b", 6), (1, "a b c", 4), (2, "b", 3), (2, "a b c", 1), (3, "b", 2)}


def test_profiles_cut_texts_into_words_once(spark):
    """Counts of words were made for each of the three readers of a profile's items."""
    plan = plan_of(catalog.QUERIES["role_profiles_full"](spark, "/root/testdata/sf0.001"))
    cuts = [line for line in plan.splitlines() if "Generate explode(" in line and "regexp_extract_all(lower(" in line]
    assert len(cuts) == 1, plan


def test_runs_that_no_alias_can_be_do_not_reach_the_join(spark):
    """Runs of a length of some alias, with other numbers of spaces or bytes or with a space at the end, are dropped before the join, and nothing else is."""
    rng = random.Random(3)
    some = lambda n: "".join(rng.choice(["a", "bb", "é", "漢", " ", " ", "+", ".", "/"]) for _ in range(n))
    keyed = lambda t: re.sub(" +", " ", t).strip()
    texts = [keyed(some(rng.randint(0, 40))) for _ in range(150)]
    names = sorted({a for a in (keyed(some(rng.randint(1, 5))) for _ in range(60)) if a})
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", rules.match_key(F.col("t")).alias("t"))
    keys = {r.id: r.t for r in df.collect()}
    aliases = spark.createDataFrame([(a, a) for a in names], "name string, alias string")
    known = [r.a for r in aliases.select(rules.match_key(F.col("alias")).alias("a")).distinct().collect() if r.a]
    found = dictionary.occurrences(df, F.col("t"), aliases)
    want = {(i, a) for i, t in keys.items() for a in known if re.search(rf"(?<!\w){re.escape(a)}(?!\w)", t)}
    assert {(r.id, r.alias) for r in found.select("id", "alias").distinct().collect()} == want and want
    assert "octet_length" in next(line for line in plan_of(found).splitlines() if "AS _grams" in line)
