"""Reading, narrowing, writing, snapshots, fingerprints and stored step results."""

from __future__ import annotations

import json
import os.path
import re
from collections.abc import Callable, Mapping, Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewise.functions.moments import half_up
from tablewise.operators.measures import col, measure, null_counts, report

SEPARATORS = [",", ";", "\t", "|"]


def missing_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes null, so there is one kind of missing value."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(col(c)), col(c)) for c in floats}) if floats else df


def spread(df: DataFrame, key: str, least_bytes: int = 2_000_000) -> DataFrame:
    """Spread a table that arrives in fewer splits than there are cores (one large row group, say) by its key.

    A table in many files has enough splits and is left alone, as is a small one. Where there is a split for most cores the rows
    of each are counted (from the footers): if the largest has at most twice its share, no pass over the table needs a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    splits = df._jdf.rdd().getNumPartitions()
    if int(str(size)) < least_bytes or splits > cores:
        return df
    if 2 * splits > cores:
        rows = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]  # one row per split
        if max(rows, default=0) * cores <= 2 * sum(rows):
            return df
    return df.repartition(cores, col(key))


def sniff_separator(spark: SparkSession, path: str) -> str:
    """The separator that splits the first 20 lines into the most, equally many, fields."""
    lines = [r[0] for r in spark.read.text(path).limit(20).collect() if r[0].strip()]

    def fit(sep):
        counts = [len(line.split(sep)) for line in lines]
        return (min(counts) if counts and min(counts) == max(counts) else 0, min(counts, default=0))

    return max(SEPARATORS, key=fit)


def read_csv(spark: SparkSession, path: str, sep: str | None = None, schema: str | None = None) -> DataFrame:
    """CSV with a header. Give a schema to avoid the extra pass that infers the types."""
    reader = spark.read.option("header", True).option("sep", sep or sniff_separator(spark, path))
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    return missing_to_null(reader.csv(path))


def read_json(spark: SparkSession, path: str, schema: str | None = None, lines: bool = False) -> DataFrame:
    """A JSON array of records, or one record per line (which can be split over tasks)."""
    reader = spark.read.option("multiLine", not lines)
    return missing_to_null((reader.schema(schema) if schema else reader).json(path))


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Read a file or folder by its extension; an unknown one is read as CSV."""
    kind = os.path.splitext(path.rstrip("/"))[1].lower()
    if kind == ".parquet":
        return missing_to_null(spark.read.parquet(path))
    if kind in (".json", ".jsonl", ".ndjson"):
        return read_json(spark, path, schema, lines=kind != ".json")
    return read_csv(spark, path, "\t" if kind == ".tsv" else None, schema)


def column_preview(spark: SparkSession, path: str) -> list[str]:
    """Column names without reading data (Parquet footer or CSV header)."""
    return read_table(spark, path).columns


def preview(df: DataFrame, key: str, n: int = 10) -> DataFrame:
    """The first n rows by key (then by the other columns, missing values first) as text, missing values shown as 'NaN'."""
    rest = [c.name for c in df.schema if c.name != key and "map<" not in c.dataType.simpleString()]
    return df.orderBy(col(key), *[col(c) for c in rest]).limit(n).select(*[F.coalesce(col(c).cast("string"), F.lit("NaN")).alias(c) for c in df.columns])


def from_records(spark: SparkSession, records: Sequence[Mapping], schema: str) -> DataFrame:
    """A request body of records as a table."""
    return spark.createDataFrame([tuple(r.get(f.name) for f in T._parse_datatype_string(schema).fields) for r in records], schema)


def parse_records(df: DataFrame, column: str, schema: str) -> DataFrame:
    """Text column of JSON records to typed columns."""
    return df.withColumn("_r", F.from_json(col(column), schema)).select(*[col(c) for c in df.columns if c != column], "_r.*")


WIDTH = {"bigint": 8, "int": 4, "smallint": 2, "double": 8, "float": 4, "boolean": 1, "date": 4, "timestamp": 8, "timestamp_ntz": 8}


def narrow_numbers(df: DataFrame, floats: bool = False) -> tuple[DataFrame, DataFrame]:
    """Long to int where the range fits; double to float on request (lossy). Gives the frame and the savings."""
    longs = [f.name for f in df.schema if isinstance(f.dataType, T.LongType)]
    doubles = [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType)] if floats else []
    row = measure(df, n=F.count("*"), **{f"{k}{i}": f(col(c)) for i, c in enumerate(longs) for k, f in (("lo", F.min), ("hi", F.max))})
    fit = [c for i, c in enumerate(longs) if row[f"lo{i}"] is not None and -(2**31) <= row[f"lo{i}"] and row[f"hi{i}"] < 2**31]
    out = df.withColumns({c: col(c).cast("int") for c in fit} | {c: col(c).cast("float") for c in doubles}) if fit or doubles else df
    before, after = dict(df.dtypes), dict(out.dtypes)
    rows = [(c, before[c], after[c], row["n"] * WIDTH[before[c]], row["n"] * WIDTH[after[c]]) for c in df.columns if before[c] in WIDTH]
    return out, report(df, rows, "column string, type_before string, type_after string, bytes_before long, bytes_after long")


def write_table(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").parquet(path)
    return path


def export_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def _label(name: str) -> str:
    return re.sub(r"\W+", "_", name).strip("_").lower()


def save_snapshot(df: DataFrame, base: str, label: str) -> DataFrame:
    """Write a named copy of a table and its one-row record."""
    spark = df.sparkSession
    write_table(df, f"{base}/data/{_label(label)}")
    stored = spark.read.parquet(f"{base}/data/{_label(label)}")
    record = report(df, [(_label(label), stored.count(), len(stored.columns), datetime.now(timezone.utc).isoformat())], "label string, n_rows long, n_columns int, saved_at string")
    record.write.mode("append").parquet(f"{base}/records")
    return record


def list_snapshots(spark: SparkSession, base: str) -> DataFrame:
    """The latest record per label."""
    return spark.read.parquet(f"{base}/records").groupBy("label").agg(F.max_by(F.struct("n_rows", "n_columns"), "saved_at").alias("r"), F.max("saved_at").alias("saved_at")).select("label", "r.*", "saved_at")


def restore_snapshot(spark: SparkSession, base: str, label: str) -> DataFrame:
    return spark.read.parquet(f"{base}/data/{_label(label)}")


def fingerprint(df: DataFrame, config: Mapping | None = None) -> DataFrame:
    """A content hash that does not depend on the row order and sees every row."""
    row = measure(df, n=F.count("*"), h=F.sum(F.xxhash64(*[col(c) for c in df.columns]).cast("decimal(38,0)")))
    miss = null_counts(df, df.columns)
    text = "|".join([str(row["n"]), df.schema.simpleString(), str([miss[c] for c in df.columns]), str(row["h"]), json.dumps(config or {}, sort_keys=True)])
    return report(df, [(text,)], "text string").select(F.sha2("text", 256).alias("fingerprint"), F.lit(row["n"]).cast("long").alias("n_rows"))


def cached_step(df: DataFrame, base: str, step: str, make: Callable[[DataFrame], DataFrame], config: Mapping | None = None) -> tuple[DataFrame, bool]:
    """The stored result of a step on this table, computed and stored if there is none."""
    spark = df.sparkSession
    path = f"{base}/{fingerprint(df, config).first()['fingerprint']}/{step}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.read.parquet(path), True
    return spark.read.parquet(write_table(make(df), path)), False


def size_report(df: DataFrame) -> DataFrame:
    """Rows and columns with their bytes at fixed type widths."""
    n = df.count()
    return report(df, [(n, len(df.columns), half_up(n * sum(WIDTH.get(t, 16) for _, t in df.dtypes) / 1e6, 2))], "n_rows long, n_columns int, megabytes double")
