"""Tables that a job writes to the folder all machines share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewise.session import shared_folder


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: later steps don't compute it anew."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tasks(df: DataFrame) -> int:
    """The number of tasks that the session deals a shuffle to."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


#: Stands for a document number that is null, which so counts as the smallest.
NO_ID = -(1 << 63)


def number(column: str = "doc_id") -> Column:
    """A document number that is never null."""
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


def text_key() -> Column:
    """A hash of the text, which tells rows of one document number apart; null is empty."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def given(column: str = "doc_id") -> Column:
    """The document number as it was given."""
    return F.nullif(F.col(column), F.lit(NO_ID)).alias(column)


def one_row_each(docs: DataFrame, stay: DataFrame) -> DataFrame:
    """One row of ``docs`` for each row of ``stay(_stay, _text, _rows)``: a document number, the key of its text and how many rows have both.

    Of several such rows the one with the smallest columns stays. Where ``_rows`` is 1 no row is looked at twice.
    """
    same = (number() == stay["_stay"]) & (text_key() == stay["_text"])
    single = docs.join(stay.where("_rows = 1"), same, "left_semi")
    if stay.where("_rows > 1").isEmpty():
        return single
    order = F.struct(*[c.name for c in docs.schema if "map<" not in c.dataType.simpleString()])
    several = docs.join(stay.where("_rows > 1"), same, "left_semi").groupBy(number().alias("_stay"), text_key().alias("_text"))
    return single.unionByName(several.agg(F.min_by(F.struct(*docs.columns), order).alias("_row")).select("_row.*"))
