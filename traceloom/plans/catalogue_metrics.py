"""Queries of metrics: points of a table, and those that a running query tells."""

from __future__ import annotations

from pyspark.sql import Observation
from pyspark.sql import functions as F

from ..streaming import metrics as M
from .catalogue import query, r6, table

_BOUNDS = ", ".join(f"{b!r}::DOUBLE" for b in M.BUCKETS) + ", 'inf'::DOUBLE"
_SQL = f"""WITH e AS (SELECT '{{' || CASE WHEN event_type = 'error' THEN '"error.type":"' || CASE WHEN event_id % 2 = 0 THEN 'timeout' ELSE 'unavailable' END || '",' ELSE '' END || '"observer.agent":"a' || (user_id % 3) || '","observer.model":"m"}}' AS attributes, value / 10.0::DOUBLE AS s FROM events),
p AS (SELECT attributes, unnest([{_BOUNDS}]) AS le, s FROM e)
SELECT attributes, CASE WHEN isinf(le) THEN -1.0::DOUBLE ELSE le END AS le, count(*) FILTER (s <= le) AS n, round(sum(s), 6) AS total FROM p GROUP BY attributes, le"""


def _measured(spark, sf):
    e = table(spark, sf, "events")
    kind = F.when(F.col("event_type") == "error", F.when(F.col("event_id") % 2 == 0, "timeout").otherwise("unavailable"))
    return e, M.score_attributes(F.concat(F.lit("a"), (F.col("user_id") % 3).cast("string")), F.lit("m"), kind), F.col("value") / 10


def _shown(points):
    return points.select("attributes", F.when(F.col("le") < float("inf"), F.col("le")).otherwise(-1.0).alias("le"), "n", r6("total").alias("total"))


@query(_SQL)
def score_points(spark, sf):
    return _shown(M.points(*_measured(spark, sf)))


@query(_SQL)
def observed_score_points(spark, sf):
    """The same, told by the query as it runs over all rows."""
    e, attributes, seconds = _measured(spark, sf)
    sets = M.attribute_sets(observer__agent=["a0", "a1", "a2"], observer__model=["m"], error__type=[None, "timeout", "unavailable"])
    told = Observation("score_points")
    M.observed(e, told, sets, attributes, seconds).write.format("noop").mode("overwrite").save()
    return _shown(spark.createDataFrame(M.observed_points(told.get, sets), M.POINT))
