"""Dictionaries of any size as tables: which names stand in which texts, by equi joins.

A vocabulary is a table (name, alias). Whole-word matching (skills, places) cuts texts and aliases into atoms, joins runs of atoms with
aliases of as many, and has no pattern per alias: cost does not grow with the vocabulary but for the lookup. Matching anywhere in
a text (title synonyms, tags) files each alias under the one of its q-grams that is rarest in the texts and verifies what meets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import let, match_key
from ..storage import staged

#: What tokens lie between.
_SPACE = r"[ \n\r\t]+"
#: Characters of the grams that texts and contained words meet by.
GRAM = 3


def as_vocabulary(spark: SparkSession, vocabulary: dict[str, list[str]] | DataFrame) -> DataFrame:
    """(name, alias, nth) of a mapping, or a table (name, alias) as it is; ``nth`` is the order of names, if the table has none by name."""
    if isinstance(vocabulary, dict):
        return spark.createDataFrame([(name, alias, i) for i, (name, aliases) in enumerate(vocabulary.items()) for alias in aliases], "name string, alias string, nth int")
    return vocabulary


def atoms(key: Column) -> Column:
    """Runs of word characters, and every other character for itself."""
    return F.regexp_extract_all(key, F.lit(r"(?Us)([a-z0-9_\w]+|.)"))  # letters and digits stand first, as \w is slow


def aliases(vocabulary: DataFrame) -> DataFrame:
    """(name, alias, n): normalised as texts are, with the number of atoms; empty ones dropped."""
    v = vocabulary.select("name", match_key(F.col("alias")).alias("alias")).where("alias <> ''").distinct()
    return v.withColumn("n", F.size(atoms(F.col("alias"))))


def occurrences(df: DataFrame, key: Column, vocabulary: dict[str, list[str]] | DataFrame) -> DataFrame:
    """The columns of ``df`` with name, alias and place (of the atom, from 0): a row for each time an alias stands in the normalised
    text ``key``, not inside a longer word.

    Names such as c++, c# and .net work: where an alias begins or ends with a sign, no word may touch it there. Null and empty texts have
    no rows; equal rows of ``df`` each have theirs. The lengths of aliases are looked up first (as many numbers as there are different
    ones, with the fewest and most spaces and bytes); a run of atoms that no alias can be, as it ends in a space or has
    more words, is dropped, and then texts meet the vocabulary in one join. The vocabulary is written before, so that Spark knows its size and broadcasts
    it if it is small: of unknown size it counts as larger than any text, and all runs of all texts would be broadcast or exchanged."""
    word = lambda c: c.rlike(r"(?U)^\w")
    words = aliases(as_vocabulary(df.sparkSession, vocabulary))
    # Which ends are words is asked once for an alias, not for each run of atoms.
    words = staged(words.withColumns({"opens": word(F.col("alias")), "closes": F.col("alias").rlike(r"(?U)\w$")}), "aliases")
    sizes, spaces = F.octet_length("alias"), F.length("alias") - F.length(F.replace("alias", F.lit(" ")))
    of_n = [f(c).alias(name) for c, low, high in ((sizes, "shortest", "longest"), (spaces, "least", "most")) for f, name in ((F.min, low), (F.max, high))]
    lengths = sorted(words.groupBy("n").agg(*of_n).collect())
    if not lengths:
        return df.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("name", "string"), ("alias", "string"), ("place", "int"))]).limit(0)
    # Outer, as Spark would else filter by the size of `_a` and work it out twice for that.
    rows = df.withColumn("_a", atoms(F.coalesce(key, F.lit("")))).select("*", F.posexplode_outer("_a").alias("_place", "_atom")).where("_atom <> ' '")
    at = lambda j: F.get("_a", F.col("_place") + j)

    def run(r: Row) -> Column:
        """The run of atoms of a length, null if no alias of that length is like it."""
        able = sum(F.octet_length(at(j)) for j in range(r.n)).between(r.shortest, r.longest)
        if r.n > 1:
            able = (at(r.n - 1) != " ") & sum((F.when(at(j) == " ", 1).otherwise(0) for j in range(1, r.n - 1)), F.lit(0)).between(r.least, r.most) & able
        return F.when(able, F.concat(*[at(j) for j in range(r.n)]))

    rows = rows.withColumns({"_left": F.coalesce(at(-1), F.lit("")), "_after": F.array(*[F.coalesce(at(r.n), F.lit("")) for r in lengths]), "_grams": F.array(*[run(r) for r in lengths])})
    met = rows.select(*df.columns, "_place", "_left", "_after", F.posexplode_outer("_grams").alias("_nth", "_gram")).where("_gram is not null")
    met = met.withColumn("_right", F.get("_after", F.col("_nth"))).drop("_after", "_nth")
    met = met.join(words.drop("n").withColumnsRenamed({"alias": "_alias", "opens": "_opens", "closes": "_closes"}), F.col("_gram") == F.col("_alias"))
    free = (F.col("_opens") | ~word(F.col("_left"))) & (F.col("_closes") | ~word(F.col("_right")))
    return met.where(free).select(*df.columns, "name", F.col("_alias").alias("alias"), F.col("_place").alias("place"))


def names_in(df: DataFrame, keys: list[str], key: Column, vocabulary: dict[str, list[str]] | DataFrame) -> DataFrame:
    """``keys`` and name: each name once for each value of ``keys``."""
    return occurrences(df.select(*keys, key.alias("_key")), F.col("_key"), vocabulary).select(*keys, "name").distinct()


def name_lists(df: DataFrame, keys: list[str], key: Column, vocabulary: dict[str, list[str]] | DataFrame) -> DataFrame:
    """``keys`` and names: all names of a text in the order of the vocabulary's ``nth`` (where it has none, by name). Texts without
    a name have no row."""
    v = as_vocabulary(df.sparkSession, vocabulary)
    order = v.groupBy("name").agg((F.min("nth") if "nth" in v.columns else F.lit(0)).alias("nth"))
    found = names_in(df, keys, key, v).join(order, "name")
    return found.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("nth", "name"))).alias("l")).select(*keys, F.col("l.name").alias("names"))


def longest_names(df: DataFrame, keys: list[str], key: Column, vocabulary: dict[str, list[str]] | DataFrame) -> DataFrame:
    """At every place of a text where aliases begin only the longest counts, and none inside another that began before: keys, name,
    alias, place. Places are walked through in order, text by text."""
    found = occurrences(df.select(*keys, key.alias("_key")), F.col("_key"), vocabulary).withColumn("n", F.size(atoms(F.col("alias"))))
    hits = found.groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct("place", (-F.col("n")).alias("less"), "name", "alias"))).alias("hits"))
    start = F.struct(F.array().cast("array<struct<place:int,less:int,name:string,alias:string>>").alias("kept"), F.lit(0).alias("end"))
    step = lambda s, h: F.when(h["place"] >= s["end"], F.struct(F.array_append(s["kept"], h).alias("kept"), (h["place"] - h["less"]).alias("end"))).otherwise(s)
    kept = F.explode(F.aggregate("hits", start, step, lambda s: s["kept"]))
    return hits.select(*keys, kept.alias("h")).select(*keys, "h.name", "h.alias", "h.place")


def _grams(text: Column, n: int) -> Column:
    """The distinct substrings of ``n`` characters, in one pass over the text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))


def _meetings(rows: DataFrame, ids: list[str], text: str, words: DataFrame, word: str, gram: int) -> DataFrame | None:
    """(ids, _w): texts and words that share the word's rarest gram; None without words."""
    w = words.select(F.col(word).alias("_w")).where("_w <> ''").distinct()
    w = w.withColumn("_n", F.least(F.length("_w"), F.lit(gram)))
    lengths = sorted(r["_n"] for r in w.select("_n").distinct().collect())  # at most ``gram`` numbers
    if not lengths:
        return None
    of_word = F.array().cast("array<string>")
    for n in lengths:
        of_word = F.when(F.col("_n") == n, _grams(F.col("_w"), n)).otherwise(of_word)
    filed = w.select("_w", F.explode(of_word).alias("_gram"))
    every = rows.select(*ids, F.explode(F.flatten(F.array(*[_grams(F.col(text), n) for n in lengths]))).alias("_gram"))
    met = every.join(filed.select("_gram").distinct(), "_gram", "left_semi")
    often = met.groupBy("_gram").agg(F.count(F.lit(1)).alias("_texts"))
    rarest = filed.join(often, "_gram", "left").groupBy("_w").agg(F.min(F.struct(F.coalesce("_texts", F.lit(0)).alias("n"), F.col("_gram").alias("g"))).alias("m"))
    rarest = rarest.where("m.n > 0").select("_w", F.col("m.g").alias("_gram"))
    return met.join(rarest, "_gram").select(*ids, "_w")


def contained(texts: DataFrame, text: str, words: DataFrame, word: str, gram: int = GRAM) -> DataFrame:
    """(text, word) for every distinct value of ``text`` in ``texts`` and of ``word`` in ``words`` that it contains, case-sensitively.

    For short texts such as titles. A word is filed under the one of its ``gram``-grams that the fewest texts have (a shorter word
    under itself); texts meet it there by an equi join, and ``contains`` decides. A word with a gram that no text has is in none. Null
    and empty words are in no text. Both sides are made distinct first, and only grams that some word has are exchanged."""
    t = texts.select(F.col(text).alias("_t")).where("_t <> ''").distinct()
    met = _meetings(t, ["_t"], "_t", words, word, gram)
    if met is None:
        return t.select(F.col("_t").alias(text), F.lit(None).cast("string").alias(word)).limit(0)
    return met.where(F.contains("_t", F.col("_w"))).select(F.col("_t").alias(text), F.col("_w").alias(word))


def contained_in(df: DataFrame, key: str, text: str, words: DataFrame, word: str, gram: int = GRAM) -> DataFrame:
    """(key, word) for every row of ``df`` and word that its ``text`` contains, case-sensitively: ``contained`` for long texts. ``key``
    tells rows apart.

    A word without a space stands inside one token (what lies between spaces and line ends), so it is looked for in the distinct tokens of all texts
    and texts are not exchanged. Words with spaces meet the texts, which are exchanged once, after it is known which can be in them."""
    w = words.select(F.col(word).alias("_w")).where("_w <> ''").distinct()
    spaced = F.col("_w").rlike(_SPACE)
    tokens = df.select(key, F.explode(F.array_distinct(F.split(F.col(text), _SPACE))).alias("_t")).where("_t <> ''")
    inside = staged(contained(tokens, "_t", w.where(~spaced), "_w", gram), "token-words")  # its size is known, so that a small one is broadcast
    found = tokens.join(inside, "_t").select(key, "_w")
    met = _meetings(df, [key], text, w.where(spaced), "_w", gram)
    if met is not None:
        found = found.unionByName(df.select(key, text).join(met, key).where(F.contains(text, F.col("_w"))).select(key, "_w"))
    return found.distinct().withColumnRenamed("_w", word)


def _order(vocabulary: DataFrame) -> list[Column]:
    return [F.col("nth")] if "nth" in vocabulary.columns else []


def longest_contained(texts: DataFrame, text: str, vocabulary: DataFrame) -> DataFrame:
    """(text, name, alias): the name of the longest alias that each distinct text contains; of equal lengths the first by ``nth`` if the
    vocabulary has it, then by alias. Texts that contain none have no row."""
    found = contained(texts, text, vocabulary, "alias").join(vocabulary, "alias")
    first = F.row_number().over(Window.partitionBy(text).orderBy(F.length("alias").desc(), *_order(vocabulary), "alias", "name"))
    return found.withColumn("_nth", first).where("_nth = 1").select(text, "name", "alias")


def first_contained(texts: DataFrame, text: str, vocabulary: DataFrame) -> DataFrame:
    """(text, name): the first name by ``nth`` (then by name) one of whose aliases each distinct text contains."""
    found = contained(texts, text, vocabulary, "alias").join(vocabulary, "alias")
    return found.groupBy(text).agg(F.min(F.struct(*_order(vocabulary), "name")).alias("m")).select(text, F.col("m.name").alias("name"))


def most_contained(df: DataFrame, key: str, text: str, vocabulary: DataFrame) -> DataFrame:
    """(key, name, n): the name with the most aliases in a text; of equals the first by ``nth``, then by name."""
    found = contained_in(df, key, text, vocabulary, "alias").join(vocabulary, "alias")
    counts = found.groupBy(key, "name").agg(F.countDistinct("alias").alias("n"), *[F.min(c).alias("nth") for c in _order(vocabulary)])
    best = F.min(F.struct((-F.col("n")).alias("less"), *_order(vocabulary), "name")).alias("m")
    return counts.groupBy(key).agg(best).select(key, F.col("m.name").alias("name"), (-F.col("m.less")).alias("n"))
