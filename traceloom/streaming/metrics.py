"""Counts and duration histograms by attribute set, as rows: of a table, or of a query while it runs.

A point is (attributes, le, n, total): attributes as JSON with sorted keys, an upper bound in seconds, how many measurements
are at most that, and the sum of all of the set; le is infinity for the count of all. Absent attributes are left out, so
error.type stands on failures alone.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from itertools import product

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..operators.evaluate import BUCKETS

POINT = "attributes string, le double, n long, total double"
_LE = (*BUCKETS, float("inf"))
#: What stands for the rows of no set that is asked for.
OTHER = "{}"


def attributes(**values: Column) -> Column:
    """Attributes as JSON, keys sorted; a null value is an absent attribute. Underscores twice stand for a dot in a name."""
    named = sorted((k.replace("__", "."), v) for k, v in values.items())
    return F.to_json(F.struct(*[v.cast("string").alias(k) for k, v in named]))


def http_attributes(server: Column, method: Column, route: Column, status: Column) -> Column:
    return attributes(observer__server=server, http__request__method=method, http__route=route, http__response__status_code=status, error__type=F.when(status >= 500, status))


def rpc_attributes(server: Column, method: Column, status: Column) -> Column:
    """Status 0 is fine, all others are errors."""
    return attributes(observer__server=server, rpc__system=F.lit("grpc"), rpc__method=method, rpc__grpc__status_code=status, error__type=F.when(status != 0, status))


def score_attributes(agent: Column, model: Column, error_kind: Column) -> Column:
    return attributes(observer__agent=agent, observer__model=model, error__type=error_kind)


def decision_attributes(agent: Column, model: Column, keep: Column, reason: Column) -> Column:
    return attributes(observer__agent=agent, observer__model=model, observer__decision=F.when(keep, "keep").otherwise("drop"), observer__reason=reason)


def send_attributes(exporter: Column, error_kind: Column) -> Column:
    return attributes(observer__exporter=exporter, error__type=error_kind)


def fault_attributes(component: Column, kind: Column) -> Column:
    return attributes(observer__component=component, error__type=kind)


def _points(sums: DataFrame) -> DataFrame:
    each = F.explode(F.arrays_zip(F.array(*map(F.lit, _LE)).alias("le"), F.col("counts").alias("n")))
    return sums.select("attributes", "total", each.alias("p")).select("attributes", F.col("p.le").alias("le"), F.col("p.n").alias("n"), "total")


def _counts(seconds: Column, where: Column | None = None) -> list[Column]:
    """Cumulative counts by bound. A null measurement counts among all alone, as does one beyond the last bound."""
    here = F.lit(True) if where is None else where
    return [*(F.count_if(here & (seconds <= b)) for b in BUCKETS), F.count_if(here)]


def points(df: DataFrame, attributes_: Column, seconds: Column | None = None) -> DataFrame:
    """Points of a table, one aggregate for all sets. Without seconds, each row counts once and measures nothing."""
    seconds = F.lit(None).cast("double") if seconds is None else seconds
    rows = df.select(attributes_.alias("attributes"), seconds.alias("_s"))
    return _points(rows.groupBy("attributes").agg(F.array(*_counts(F.col("_s"))).alias("counts"), F.coalesce(F.sum("_s"), F.lit(0.0)).alias("total")))


def attribute_sets(**values: list) -> list[str]:
    """All combinations of attribute values, None for an absent one, as attributes() writes them."""
    names = sorted((k.replace("__", "."), v) for k, v in values.items())
    return [json.dumps({k: str(v) for (k, _), v in zip(names, found, strict=True) if v is not None}, separators=(",", ":"), ensure_ascii=False) for found in product(*(v for _, v in names))]


def observed(df: DataFrame, name: str | Observation, sets: list[str], attributes_: Column, seconds: Column) -> DataFrame:
    """df, which tells its points by these sets as it runs; other rows are counted together as OTHER.

    The sets are configuration: models, agents and kinds of error that are known beforehand. Each takes 16 aggregates.
    """
    df = df.withColumns({"_attributes": attributes_, "_seconds": seconds})
    exprs = []
    for i, text in enumerate([*sets, OTHER]):
        here = F.col("_attributes") == text if text != OTHER else ~F.coalesce(F.col("_attributes").isin(sets), F.lit(False))
        exprs += [c.alias(f"{i}.{k}") for k, c in enumerate(_counts(F.col("_seconds"), here))]
        exprs.append(F.coalesce(F.sum(F.when(here, F.col("_seconds"))), F.lit(0.0)).alias(f"{i}.total"))
    return df.observe(name, *exprs).drop("_attributes", "_seconds")


def observed_points(found: dict, sets: list[str]) -> list[tuple]:
    """What observed() told, as points; sets that nothing was counted for have none."""
    out = []
    for i, text in enumerate([*sets, OTHER]):
        if found[f"{i}.{len(BUCKETS)}"]:
            out += [(text, le, found[f"{i}.{k}"], found[f"{i}.total"]) for k, le in enumerate(_LE)]
    return out


class PointListener(StreamingQueryListener):
    """Gives the points of each batch of a query that observed() under `name` to sink(query, batch_id, points) as it ends."""

    def __init__(self, name: str, sets: list[str], sink: Callable[[str, int, list[tuple]], None]):
        self.name, self.sets, self.sink = name, sets, sink

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.name)
        if row is not None:
            self.sink(str(event.progress.id), event.progress.batchId, observed_points(row.asDict(), self.sets))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def appended_points(spark: SparkSession, path: str) -> Callable[[str, int, list[tuple]], None]:
    """A sink that keeps a batch's points in a folder of its own: one that is told twice replaces itself."""

    def sink(query: str, batch: int, rows: list[tuple]) -> None:
        spark.createDataFrame(rows, POINT).coalesce(1).write.mode("overwrite").parquet(f"{path}/query={query}/batch={batch}")

    return sink


def summed(points_: DataFrame) -> DataFrame:
    """Points of several batches as one set: counts and sums add up."""
    return points_.groupBy("attributes", "le").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
