"""What the registered queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

#: Skills whose names occur in the prose of the fixtures; one has two words.
SKILLS = {"Erin": ["erin", "anea"], "WithThe": ["with the"], "Edon": ["edon", "edonre"], "Pour": ["pour"], "Para": ["para", "con"], "Sch": ["sch", "schen"]}
STOPWORDS = ["the", "and", "der", "die", "les", "des", "que", "con", "una", "for"]


class Registry:
    """Queries and their SQL twins by name."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        def register(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql is not None:
                self.oracles[f.__name__] = sql
            return f

        return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over as many partitions as shuffles have. Millions of short rows fit into one or two splits of a file; where much is worked
    out for each row, they keep one or two cores busy and all others wait."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
