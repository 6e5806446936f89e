"""Tables written on the way, in the folder that the cluster shares, and stages of tables that a later run can go on from."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; with a local master, a fresh temporary folder where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    found = f"file://{tempfile.mkdtemp(prefix='traceloom-')}"
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and outlives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


class Stages:
    """A run in stages, each of which leaves named tables and a manifest in a folder of its own below `path`.

    The manifest is written last and carries a key of the stage's name, its settings and the key of the stage before it.
    A run that finds it reads the tables back; one that finds none, or another key, makes the stage again, and with it all
    that come after. So a killed run goes on where it stopped, and one with other settings redoes what depends on them.
    """

    def __init__(self, spark: SparkSession, path: str, settings: dict | None = None):
        self.spark, self.path, self.made = spark, path.rstrip("/"), []
        self.key = hashlib.sha256(json.dumps(settings or {}, sort_keys=True, default=str).encode()).hexdigest()

    def manifest(self, name: str) -> dict | None:
        """The manifest of a finished stage: key, settings and the schemas of its tables."""
        path = f"{self.path}/{name}/manifest"
        if not exists(self.spark, f"{path}/_SUCCESS"):
            return None
        return json.loads(self.spark.read.text(path, wholetext=True).first()[0])

    def stage(self, name: str, make: Callable[[], dict[str, DataFrame]], **settings: object) -> dict[str, DataFrame]:
        """The stage's tables: those that are there, or those of make(), written. Stages follow each other in the order of the calls."""
        self.key = hashlib.sha256(json.dumps([self.key, name, settings], sort_keys=True, default=str).encode()).hexdigest()
        there = self.manifest(name)
        if there is None or there["key"] != self.key:
            tables = make()
            for table, df in tables.items():
                df.write.mode("overwrite").parquet(f"{self.path}/{name}/{table}")
            there = {"stage": name, "key": self.key, "settings": settings, "tables": {table: json.loads(df.schema.json()) for table, df in tables.items()}}
            self.spark.createDataFrame([(json.dumps(there, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/{name}/manifest")
            self.made.append(name)
        from pyspark.sql.types import StructType

        return {table: self.spark.read.schema(StructType.fromJson(schema)).parquet(f"{self.path}/{name}/{table}") for table, schema in there["tables"].items()}
