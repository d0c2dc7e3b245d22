"""Table access and registration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    """Tables of a folder as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


def registry():
    """(QUERIES, decorator): query(sql) registers a function of Tables under its name."""
    found: dict = {}

    def query(sql: str | None = None):
        def add(fn):
            found[fn.__name__] = (lambda spark, sf_dir: fn(Tables(spark, sf_dir)), sql)
            return fn

        return add

    return found, query


def literal(text: str) -> str:
    """A SQL string."""
    return "'" + text.replace("'", "''") + "'"


def listed(texts: list[str], index: str) -> str:
    """SQL: the text at index modulo their number."""
    return f"[{', '.join(map(literal, texts))}][({index} % {len(texts)} + 1)::INT]"


def pick(texts: list[str], index: str) -> Column:
    """The text at index modulo their number: tables get what their own rows lack."""
    return F.element_at(F.array(*map(F.lit, texts)), (F.col(index) % len(texts) + 1).cast("int"))


def codes_sql(column: str, patterns: dict[str, str]) -> str:
    """SQL: names of the patterns found, in order."""
    return f"list_filter([{', '.join(f'CASE WHEN regexp_matches({column}, {literal(p)}) THEN {literal(k)} END' for k, p in patterns.items())}], lambda x: x IS NOT NULL)"


def any_sql(column: str, patterns: dict[str, str]) -> str:
    return "(" + " OR ".join(f"regexp_matches({column}, {literal(p)})" for p in patterns.values()) + ")"
