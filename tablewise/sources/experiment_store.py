"""Experiment records in four Parquet tables: append-only, the newest version of a row counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "experiments": "id string, name string, description string, tags array<string>, dataset_name string, target_column string, problem_type string, "
                   "n_rows long, n_cols int, status string, created_at string, updated_at string, best_model string, best_score double, primary_metric string, "
                   "session_id string, notes string, user_id string, problem_statement string",
    "results": "id string, experiment_id string, step string, result_data string, created_at string",
    "models": "id string, experiment_id string, model_name string, model_type string, primary_metric double, metrics map<string,double>, is_best boolean, "
              "created_at string, hyperparameters map<string,string>, feature_importance map<string,double>",
    "fingerprints": "id string, experiment_id string, fingerprint array<double>, created_at string",
}


class ExperimentStore:
    """Append, read the newest versions, delete by rewrite. One table per kind under ``base``."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base

    def append(self, kind: str, rows: Sequence[Mapping]) -> None:
        now = datetime.now(timezone.utc).isoformat()
        names = [p.strip().split(" ")[0] for p in _fields(SCHEMAS[kind])]
        data = [tuple(r.get(n, now if n == "created_at" else None) for n in names) + (now, False) for r in rows]
        self.spark.createDataFrame(data, SCHEMAS[kind] + ", version string, gone boolean").write.mode("append").parquet(f"{self.base}/{kind}")

    def newest(self, kind: str) -> DataFrame:
        """One row per id: the newest version that is not a deletion (a two-step aggregate, no window)."""
        df = self.spark.read.parquet(f"{self.base}/{kind}")
        last = df.groupBy("id").agg(F.max_by(F.struct(*df.columns), "version").alias("r")).select("r.*")
        return last.where(~F.col("gone")).drop("version", "gone")

    def delete(self, experiment_id: str) -> None:
        """Mark an experiment and everything that belongs to it as gone, in all four tables."""
        now = datetime.now(timezone.utc).isoformat()
        for kind in SCHEMAS:
            owner = F.col("id") if kind == "experiments" else F.col("experiment_id")
            self.newest(kind).where(owner == experiment_id).withColumns({"version": F.lit(now), "gone": F.lit(True)}).write.mode("append").parquet(f"{self.base}/{kind}")


def _fields(ddl: str) -> list[str]:
    out, depth, cur = [], 0, ""
    for ch in ddl:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            out.append(cur)
            cur = ""
        else:
            cur += ch
    return out + [cur]
