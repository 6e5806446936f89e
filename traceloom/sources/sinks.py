"""Sinks: kept traces to several back ends, dead letters, splits, reports, error lines."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fan_out(df: DataFrame, sinks: dict[str, Callable[[DataFrame], None]]) -> dict[str, str | None]:
    """Kept rows to each sink by itself; name -> error or None. The rows are computed once."""
    kept = df.where("keep").persist()
    said: dict[str, str | None] = {}
    try:
        for name, write in sinks.items():
            try:
                write(kept)
                said[name] = None
            except Exception as e:  # a back end's failure is its own
                said[name] = f"{type(e).__name__}: {e}"[:500]
    finally:
        kept.unpersist()
    return said


def export_records(df: DataFrame, limit: int = 1 << 20) -> DataFrame:
    """What goes on an export queue: without the original spans where they are over the limit."""
    spans = F.when(F.octet_length("otlp_spans") <= limit, F.col("otlp_spans")) if "otlp_spans" in df.columns else F.lit(None).cast("binary")
    return df.withColumn("otlp_spans", spans)


def dead_letters(df: DataFrame, error: str, deliveries: str, source: str) -> DataFrame:
    return df.select(F.to_json(F.struct(*[c for c in df.columns if c not in (error, deliveries)])).alias("payload"), F.col(error).alias("reason"), F.current_timestamp().alias("at"), F.col(deliveries).alias("deliveries"), F.lit(source).alias("source"))


def error_lines(faults: DataFrame) -> DataFrame:
    """A flat JSON line for each fault (kind, component, op, trace_id, severe, attrs); its own fields win over attrs."""
    level = F.when(F.col("severe") | (F.col("kind") == "internal"), "ERROR").otherwise("WARN")
    fixed = F.create_map(F.lit("level"), level, F.lit("kind"), F.col("kind"), F.lit("component"), F.col("component"), F.lit("op"), F.col("op"), F.lit("trace_id"), F.col("trace_id"))
    rest = F.map_filter("attrs", lambda k, _: ~F.map_contains_key(fixed, k))
    return faults.select(F.to_json(F.map_concat(rest, F.map_filter(fixed, lambda _, v: v.isNotNull()))).alias("value"))


def training_lines(df: DataFrame, questions: str, expected: str | None = None) -> DataFrame:
    """state, questions and, apart from or inside them, the expected answers, as JSON lines."""
    fields = [F.col("state"), F.col(questions).alias("questions")] + ([F.col(expected).alias("expected")] if expected else [])
    return df.select(F.to_json(F.struct(*fields)).alias("value"))


def write_splits(df: DataFrame, path: str) -> None:
    df.write.partitionBy("portion").json(path)


def write_report(results: DataFrame, path: str, manifest: dict) -> None:
    """results.csv beside manifest.json, as Spark writes them; both are small."""
    results.coalesce(1).write.option("header", True).csv(f"{path}/results")
    results.sparkSession.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{path}/manifest")


def decision_lines(decisions: DataFrame) -> DataFrame:
    """A JSON line for each decision, for a log; absent values are left out."""
    names = [c for c in ("trace_id", "agent", "model", "reason", "severity", "p_keep", "latency_ms") if c in decisions.columns]
    return decisions.select(F.to_json(F.struct(F.when(F.col("keep"), "keep").otherwise("drop").alias("decision"), *names)).alias("value"))


def dataset_lines(rows: DataFrame, keep: list[str]) -> DataFrame:
    """Rows as JSON lines with the columns of `keep` alone, in that order; a null stands as null, a column that is missing is an error."""
    return rows.select(F.to_json(F.struct(*keep), {"ignoreNullFields": "false"}).alias("value"))


def append_runs(runs: DataFrame, path: str) -> None:
    """Finished runs (error null) to path/runs and failed ones to path/errors. A run_key that path/runs has isn't written again."""
    spark, log = runs.sparkSession, f"{path}/runs"
    done = runs.where("error IS NULL").drop("error").dropDuplicates(["run_key"])
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(log)
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        done = done.join(spark.read.parquet(log).select("run_key"), "run_key", "left_anti")
    done.write.mode("append").parquet(log)
    runs.where("error IS NOT NULL").select("run_key", "error").write.mode("append").parquet(f"{path}/errors")


def write_comparison(path: str, comparison: dict, tables: dict[str, DataFrame]) -> None:
    """A comparison of models: each table (results, summary, head_to_head: models x rates, small) as CSV, and all of it as one JSON text."""
    spark = next(iter(tables.values())).sparkSession
    every = dict(comparison)
    for name, df in tables.items():
        df.coalesce(1).write.option("header", True).csv(f"{path}/{name}")
        every[name] = [json.loads(r[0]) for r in df.select(F.to_json(F.struct(*df.columns))).collect()]
    spark.createDataFrame([(json.dumps(every),)], "value string").coalesce(1).write.text(f"{path}/comparison")
