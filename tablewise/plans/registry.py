"""Registered queries: a Spark callable and, where SQL can say it, an equivalent statement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tablewise.plans import inputs
from tablewise.sources.files import spread

TABLE_NAMES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()
# keys by which a large table in a single split is spread
KEYS = {"customer": "c_custkey", "lineitem": "l_orderkey", "orders": "o_orderkey", "events": "event_id", "documents": "doc_id", "pages": "page_id", "conversations": "conv_id"}


class Tables:
    """Lazy access to the source tables and to the inputs derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLE_NAMES:
            df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            return spread(df, KEYS[name]) if name in KEYS else df
        if name in inputs.DERIVED:
            text = inputs.DERIVED[name]
            used = {t: getattr(self, t) for t in TABLE_NAMES + list(inputs.DERIVED) if "{" + t + "}" in text}
            return self.spark.sql(text, **used)
        raise AttributeError(name)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def with_inputs(sql: str) -> str:
    """Prefix a statement with the derived inputs it names in braces."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in inputs.DERIVED:
            if "{" + name + "}" in text and name not in needed:
                visit(inputs.DERIVED[name])
                if name not in needed:
                    needed.append(name)

    visit(sql)

    def plain(text: str) -> str:
        for t in TABLE_NAMES + list(inputs.DERIVED):
            text = text.replace("{" + t + "}", t)
        return text

    ctes = [f"{n} AS ({plain(inputs.DERIVED[n])})" for n in needed]
    body = plain(sql).strip()
    if not ctes:
        return body
    if body[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(ctes) + ",\n" + body[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + body


def query(key: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under a key, with its oracle statement if there is one."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        QUERIES[key] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[key] = with_inputs(sql)
        return fn

    return wrap
