"""Queries of the comparison of models: margins over the best rule, resamples of exactly n, figures of logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compare as K
from .catalogue import _AUC, query, r6, table

_U = "(('0x' || substr(sha256('b|' || resample || '|' || i), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE)"


@query(f"""WITH k AS (SELECT event_id, row_number() OVER (ORDER BY sha256('b|' || event_id), event_id) - 1 AS i, count(*) OVER () AS n FROM events),
d AS (SELECT resample, floor({_U} * n)::BIGINT AS i, count(*) AS w FROM k, (SELECT unnest(range(1, 13)) AS resample) GROUP BY ALL),
s AS (SELECT event_id, user_id % 3 AS b, value AS p, event_type = 'error' AS y FROM events),
g AS (SELECT b, resample, p, sum(CASE WHEN y THEN w ELSE 0 END)::DOUBLE AS pos, sum(CASE WHEN y THEN 0 ELSE w END)::DOUBLE AS neg FROM d JOIN k USING (i) JOIN s USING (event_id) GROUP BY ALL),
v AS (SELECT b, resample, sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)) AS auroc FROM (SELECT *, coalesce(sum(neg) OVER (PARTITION BY b, resample ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g) GROUP BY b, resample HAVING sum(pos) > 0 AND sum(neg) > 0),
a AS (SELECT b, {_AUC} AS auroc FROM (SELECT b, y, rank() OVER (PARTITION BY b ORDER BY p) + (count(*) OVER (PARTITION BY b, p) - 1) / 2.0::DOUBLE AS r FROM s) GROUP BY b)
SELECT b, round(a.auroc, 6) AS auroc, round(quantile_cont(v.auroc, 0.025), 6) AS low, round(quantile_cont(v.auroc, 0.975), 6) AS high FROM v JOIN a USING (b) GROUP BY b, a.auroc""")
def exact_bootstrap(spark, sf):
    scores = table(spark, sf, "events").select("event_id", (F.col("user_id") % 3).alias("b"), F.col("value").cast("double").alias("p"), (F.col("event_type") == "error").alias("y"))
    return K.exact_bootstrap_auroc(scores, ["b"], "event_id", 12).select("b", *[r6(c).alias(c) for c in ("auroc", "low", "high")])


@query("""WITH r AS (SELECT user_id % 10 AS base, event_type AS rule, avg(value) / 500.0::DOUBLE AS v FROM events GROUP BY ALL),
s AS (SELECT base, arg_min(rule, (-v, rule)) AS best_rule, max(v) AS sv FROM r WHERE rule NOT IN ('error', 'view') GROUP BY base), c AS (SELECT base, v AS cv FROM r WHERE rule = 'view'), m AS (SELECT base, v + 0.08::DOUBLE AS value FROM r WHERE rule = 'error')
SELECT base, round(value, 6) AS value, best_rule, CASE WHEN cv >= sv THEN 'view' ELSE best_rule END AS best, round(value - greatest(cv, sv), 6) AS margin, value - greatest(cv, sv) >= 0.05::DOUBLE AS passed FROM m JOIN s USING (base) JOIN c USING (base)""")
def model_margins(spark, sf):
    """Mean values as stand-ins of recall: `error` events for the model, all other kinds for rules."""
    r = table(spark, sf, "events").groupBy((F.col("user_id") % 10).alias("base_rate"), F.col("event_type").alias("signal")).agg((F.avg("value") / 500.0).alias("v"))
    own = F.col("signal") == "error"
    results = r.select(F.when(own, "finetuned").otherwise("heuristic").alias("model"), "signal", "base_rate", F.lit(0.05).alias("sample_rate"), (F.col("v") + F.when(own, 0.08).otherwise(0.0)).alias("norm_recall_mean"))
    out = K.margins(results, "finetuned", "error", ["view"], 0.05, 0.05)
    return out.select(F.col("base_rate").alias("base"), r6("value").alias("value"), "best_rule", "best", r6("margin").alias("margin"), "passed")


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id % 50 + 100 ELSE 10 END::BIGINT AS records, CASE WHEN event_id % 3 = 0 THEN event_id % 50 ELSE 0 END::BIGINT AS dropped,
  round(CASE WHEN event_id % 3 = 0 THEN (event_id % 50)::DOUBLE / (event_id % 50 + 100) ELSE 0.0::DOUBLE END, 6) AS dropped_frac FROM events""")
def training_logs(spark, sf):
    i = F.col("event_id")
    log = F.when(i % 3 == 0, F.format_string("step 1\nWARN dropped %d of %d records\n%s", i % 50, i % 50 + 100, "event_type")).when(i % 3 == 1, F.concat(F.lit("dropped few records of "), F.col("event_type")))
    out = K.training_figures(table(spark, sf, "events").select("event_id", log.alias("log")), F.lit(10))
    return out.select("event_id", "records", "dropped", r6("dropped_frac").alias("dropped_frac"))
