"""More queries of the catalogue: runs, replies, comparison of models, intake and queue."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..operators import labels as L
from ..operators import runs as R
from ..operators import scoring as C
from ..operators import traces as T
from ..sources import generate, intake, sinks
from ..streaming import assembly as A
from .catalogue import _AUC, _scores, query, r6, table

_STEPS = " + ".join(f"(u >= {s!r}::DOUBLE)::INT" for s in E.POISSON_STEPS)
_MODELS = "unnest(['m1', 'm2', 'm3']) AS model, unnest([value, value + (event_id % 7) * 20, value - (event_id % 3) * 50]) AS p"


def _drawn(columns: str, of: str, n: int) -> str:
    """SQL of weighted AUROCs over resamples, ties averaged."""
    return f"""d AS (SELECT {columns}, resample, p, y, {_STEPS} AS w FROM (SELECT *, ('0x' || substr(sha256('b|' || resample || '|' || event_id), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u FROM {of}, (SELECT unnest(range(1, {n + 1})) AS resample))),
g AS (SELECT {columns}, resample, p, sum(CASE WHEN y THEN w ELSE 0 END)::DOUBLE AS pos, sum(CASE WHEN y THEN 0 ELSE w END)::DOUBLE AS neg FROM d WHERE w > 0 GROUP BY ALL),
v AS (SELECT {columns}, resample, sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)) AS auroc FROM (SELECT *, coalesce(sum(neg) OVER (PARTITION BY {columns}, resample ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g) GROUP BY {columns}, resample HAVING sum(pos) > 0 AND sum(neg) > 0)"""


def _models(spark, sf, resamples=0):
    """Scores of three models; with weights of the events, made once for all three, if there are resamples."""
    e, kept = table(spark, sf, "events"), ["weights"] * bool(resamples)
    e = E.with_weights(e, "event_id", resamples) if resamples else e
    v = [F.col("value"), F.col("value") + (F.col("event_id") % 7) * 20, F.col("value") - (F.col("event_id") % 3) * 50]
    each = F.explode(F.array(*[F.struct(F.lit(f"m{i + 1}").alias("model"), x.cast("double").alias("p")) for i, x in enumerate(v)]))
    return e.select("event_id", "user_id", (F.col("event_type") == "error").alias("y"), *kept, each.alias("s")).select("event_id", "user_id", "y", *kept, "s.*")


_LONG = f"s AS (SELECT event_id, event_type = 'error' AS y, {_MODELS} FROM events)"


@query(f"""WITH s AS (SELECT event_id, user_id % 4 AS b, value / 500.0::DOUBLE AS p, event_type = 'error' AS y FROM events), {_drawn('b', 's', 50)},
a AS (SELECT b, {_AUC} AS auroc FROM (SELECT b, y, rank() OVER (PARTITION BY b ORDER BY p) + (count(*) OVER (PARTITION BY b, p) - 1) / 2.0::DOUBLE AS r FROM s) GROUP BY b)
SELECT b, round(a.auroc, 6) AS auroc, round(quantile_cont(v.auroc, 0.025), 6) AS low, round(quantile_cont(v.auroc, 0.975), 6) AS high FROM v JOIN a USING (b) GROUP BY b, a.auroc""")
def bootstrap_auroc(spark, sf):
    out = E.bootstrap_auroc(_scores(spark, sf).withColumn("b", F.col("user_id") % 4).select("event_id", "b", "p", "y"), ["b"], "event_id", 50)
    return out.select("b", *[r6(c).alias(c) for c in ("auroc", "low", "high")])


@query(f"""WITH {_LONG}, {_drawn('model', 's', 20)}, w AS (SELECT model, {_AUC} AS auroc FROM (SELECT model, y, rank() OVER (PARTITION BY model ORDER BY p) + (count(*) OVER (PARTITION BY model, p) - 1) / 2.0::DOUBLE AS r FROM s) GROUP BY model),
q AS (SELECT x.model AS a, z.model AS b, quantile_cont(x.auroc - z.auroc, 0.025) AS low, quantile_cont(x.auroc - z.auroc, 0.975) AS high FROM v x JOIN v z ON x.resample = z.resample AND x.model < z.model GROUP BY ALL)
SELECT a, b, round(wa.auroc - wb.auroc, 6) AS diff, round(low, 6) AS low, round(high, 6) AS high, low > 0 OR high < 0 AS differs FROM q JOIN w wa ON wa.model = a JOIN w wb ON wb.model = b""")
def paired_bootstrap(spark, sf):
    out = E.paired_bootstrap(_models(spark, sf, 20).drop("user_id"), "model", "event_id", 20)
    return out.select("a", "b", *[r6(c).alias(c) for c in ("diff", "low", "high")], "differs")


@query("""WITH s AS (SELECT value AS p, event_type = 'error' AS y, CASE WHEN event_type = 'error' THEN user_id % 4 END AS kind FROM events), k AS (SELECT DISTINCT kind FROM s WHERE y),
e AS (SELECT k.kind, p, y FROM k JOIN s ON NOT y OR s.kind = k.kind), r AS (SELECT kind, y, rank() OVER (PARTITION BY kind ORDER BY p) + (count(*) OVER (PARTITION BY kind, p) - 1) / 2.0::DOUBLE AS r FROM e)
SELECT kind, count(*) FILTER (y) AS n, round((sum(CASE WHEN y THEN r END) - count(*) FILTER (y)::DOUBLE * (count(*) FILTER (y) + 1) / 2) / (count(*) FILTER (y)::DOUBLE * count(*) FILTER (NOT y)), 6) AS auroc FROM r GROUP BY kind""")
def auroc_by_failure(spark, sf):
    s = _scores(spark, sf).withColumn("kind", F.when(F.col("y"), F.col("user_id") % 4))
    return E.auroc_by_failure(s.select("kind", "p", "y"), [], "kind").select("kind", "n", r6("auroc").alias("auroc"))


_EVALUATED = f"""{_LONG}, t AS (SELECT event_id, event_type = 'error' AS y FROM events), c AS (SELECT count(*) FILTER (NOT y) AS c FROM t),
e AS (SELECT t.*, b.base_rate, r.resample, sha256('r|' || b.base_rate || '|' || r.resample || '|' || event_id) AS pos, round_even(b.base_rate * c / (1 - b.base_rate), 0) AS nw
  FROM t, c, (SELECT unnest([0.05::DOUBLE, 0.1::DOUBLE]) AS base_rate) b, (SELECT unnest([0, 1]) AS resample) r),
k AS (SELECT event_id, base_rate, resample, pos FROM (SELECT *, row_number() OVER (PARTITION BY base_rate, resample, y ORDER BY pos) AS n FROM e) WHERE NOT y OR n <= nw),
q AS (SELECT model, base_rate, resample, y, row_number() OVER (PARTITION BY model, base_rate, resample ORDER BY p DESC, pos) AS r, count(*) OVER (PARTITION BY model, base_rate, resample) AS n FROM k JOIN s USING (event_id)),
m AS (SELECT model, base_rate, resample, sample_rate, greatest(1, ceil(sample_rate * any_value(n))) / any_value(n)::DOUBLE AS rnd, count(*) FILTER (y) AS pos, greatest(1, ceil(sample_rate * any_value(n))) AS kk,
  count(*) FILTER (y AND r <= greatest(1, ceil(sample_rate * n))) / count(*) FILTER (y)::DOUBLE AS recall FROM q, (SELECT unnest([0.1::DOUBLE, 0.25::DOUBLE]) AS sample_rate) GROUP BY model, base_rate, resample, sample_rate),
ev AS (SELECT model, 'value' AS signal, base_rate, sample_rate, avg(recall) AS recall_mean, avg(rnd) AS random_recall, avg((recall - rnd) / (least(1.0::DOUBLE, kk / pos::DOUBLE) - rnd)) AS norm_recall_mean FROM m GROUP BY model, base_rate, sample_rate)"""


def _evaluated(spark, sf):
    return E.evaluated(_models(spark, sf).drop("user_id").withColumn("signal", F.lit("value")), ["model", "signal"], "event_id", [0.05, 0.1], [0.1, 0.25], 2)


@query(f"""WITH {_EVALUATED}, a AS (SELECT model, {_AUC} AS auroc FROM (SELECT model, y, rank() OVER (PARTITION BY model ORDER BY p) + (count(*) OVER (PARTITION BY model, p) - 1) / 2.0::DOUBLE AS r FROM s) GROUP BY model)
SELECT model, signal, base_rate, sample_rate, round(auroc, 6) AS auroc_full_test, round(recall_mean, 6) AS recall_mean, round(random_recall, 6) AS random_recall, round(norm_recall_mean, 6) AS norm_recall_mean FROM ev JOIN a USING (model) ORDER BY 3, 4, 1, 2""")
def evaluator(spark, sf):
    return E.in_order(_evaluated(spark, sf)).select("model", "signal", "base_rate", "sample_rate", *[r6(c).alias(c) for c in ("auroc_full_test", "recall_mean", "random_recall", "norm_recall_mean")])


@query(f"""WITH {_EVALUATED} SELECT o.model AS other, list(o.base_rate ORDER BY o.base_rate)::VARCHAR AS behind FROM ev o JOIN ev m ON m.model = 'm2' AND o.model <> 'm2' AND m.base_rate = o.base_rate AND m.sample_rate = o.sample_rate
WHERE o.sample_rate = 0.1 AND m.norm_recall_mean <= o.norm_recall_mean GROUP BY o.model""")
def not_better(spark, sf):
    out = E.not_better(_evaluated(spark, sf).where("sample_rate = 0.1"), "m2", ["m1", "m3"])
    return out.select("other", F.concat(F.lit("["), F.array_join("behind", ", "), F.lit("]")).alias("behind"))


@query("SELECT event_type = 'error' AS y, round(avg(value), 6) AS value, round(avg(event_id % 7), 6) AS seven FROM events GROUP BY 1")
def rule_means(spark, sf):
    e = table(spark, sf, "events").select((F.col("event_type") == "error").alias("y"), "value", (F.col("event_id") % 7).alias("seven"))
    return E.rule_means(e, ["value", "seven"]).select("y", r6("value").alias("value"), r6("seven").alias("seven"))


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) > 3 AS exhausted FROM conversations")
def run_budget(spark, sf):
    return R.budgeted(table(spark, sf, "conversations").select("conv_id", "turn"), "conv_id", "turn", 3).select("conv_id", "turn", "exhausted")


@query("""WITH c AS (SELECT user_id AS run_id, event_id AS "at", CASE WHEN event_id % 3 > 0 THEN 'c' || (event_id % 3) END AS call_id, event_type AS name FROM events),
k AS (SELECT *, row_number() OVER (PARTITION BY run_id, call_id, name ORDER BY "at") AS n FROM c), d AS (SELECT *, row_number() OVER (PARTITION BY run_id, call_id, name ORDER BY "at") AS n FROM c WHERE "at" % 4 > 0)
SELECT k."at", coalesce('ok' || d."at", 'bad_args') AS status, coalesce(substr(repeat('r' || d."at", 100), 1, 300), '') AS result_preview FROM k LEFT JOIN d ON k.run_id = d.run_id AND k.call_id IS NOT DISTINCT FROM d.call_id AND k.name = d.name AND k.n = d.n""")
def call_records(spark, sf):
    calls = table(spark, sf, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("at"), F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("c"), (F.col("event_id") % 3).cast("string"))).alias("call_id"), F.col("event_type").alias("name"))
    at = F.col("at").cast("string")
    records = calls.where("at % 4 > 0").withColumns({"status": F.concat(F.lit("ok"), at), "result": F.repeat(F.concat(F.lit("r"), at), 100)})
    return R.with_records(calls, records).select("at", "status", "result_preview")


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'search' WHEN 1 THEN 'lookup' END AS name, CASE event_id % 4 WHEN 0 THEN '{"q": ' || event_id || '}' WHEN 1 THEN '{"t": "' || event_type || '"}' END AS args_json FROM events""")
def text_calls(spark, sf):
    k, i = F.col("event_id") % 4, F.col("event_id").cast("string")
    asked, looked = F.concat(F.lit('{"q": '), i, F.lit("}")), F.concat(F.lit('{"t": "'), F.col("event_type"), F.lit('"}'))
    reply = F.when(k == 0, F.concat(F.lit("<tool_call> search("), asked, F.lit(") </tool_call>"))).when(k == 1, F.concat(F.lit("```json\nlookup: "), looked, F.lit("\n```"))).when(k == 2, F.concat(F.lit("I would search "), asked)).otherwise(F.concat(F.lit("search "), asked, F.lit(" now")))
    return table(spark, sf, "events").withColumn("c", R.text_call(reply)).select("event_id", "c.name", "c.args_json")


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 OR event_id % 7 = 6 THEN '' ELSE event_type END AS final_answer, CASE WHEN event_id % 5 = 0 THEN 'max_steps' WHEN event_id % 7 = 6 THEN 'no_answer' ELSE 'answered' END AS stop_reason, event_id % 2 = 0 AS used_search FROM events""")
def run_outcomes(spark, sf):
    i = F.col("event_id")
    runs = table(spark, sf, "events").select("event_id", F.when(i % 7 != 6, F.concat(F.lit("Answer: "), F.col("event_type"), F.lit("."))).alias("final_raw"), (i % 5 == 0).alias("hit_max_steps"), F.array(F.when(i % 2 == 0, "ok").otherwise("error")).alias("statuses"))
    return R.outcomes(runs).select("event_id", "final_answer", "stop_reason", "used_search")


@query("""SELECT event_id, CASE WHEN event_id % 4 < 2 THEN round(value / 500.0::DOUBLE, 6) END AS answer_wrong, CASE WHEN event_id % 4 = 0 THEN round(value / 600.0::DOUBLE, 6) END AS keep_or_drop, CASE WHEN event_id % 4 = 0 THEN 'served' ELSE 'asked' END AS model, CASE event_id % 4 WHEN 0 THEN 12.5 WHEN 1 THEN 7.25 ELSE 99.0 END::DOUBLE AS latency_ms, CASE WHEN event_id % 4 >= 2 THEN 'invalid' END AS error_kind FROM events""")
def scorer_replies(spark, sf):
    k, p = F.col("event_id") % 4, (F.col("value") / 500).cast("string")
    noul = lambda v, rest: F.concat(F.lit('{"answers": {"answer_wrong": {"noul": '), v, F.lit("}}"), F.lit(rest), F.lit("}"))
    body = F.when(k == 0, F.concat(F.lit('{"answers": {"answer_wrong": {"noul": '), p, F.lit('}, "keep_or_drop": {"probabilities": {"keep": '), (F.col("value") / 600).cast("string"), F.lit('}}}, "model": "served", "latency_ms": 12.5, "evaluation_time_ms": 3}'))).when(k == 1, noul(p, ', "model": "", "evaluation_time_ms": 7.25')).when(k == 2, noul(F.lit("1.5"), "")).otherwise(noul(F.lit('"0.5"'), ""))
    out = table(spark, sf, "events").withColumn("r", C.read_reply(body, "asked", F.lit(99.0)))
    return out.select("event_id", r6("r.answer_wrong").alias("answer_wrong"), r6("r.keep_or_drop").alias("keep_or_drop"), "r.model", "r.latency_ms", "r.error_kind")


@query("""SELECT event_type AS model, round(quantile_cont(value, 0.5), 6) AS latency_p50_ms, round(quantile_cont(value, 0.95), 6) AS latency_p95_ms, round(avg(t), 6) AS input_tokens_per_trace, count(*) AS traces_scored, coalesce(sum(t), 0)::BIGINT AS input_tokens_total, count(*) FILTER (value > 400) AS truncated
FROM (SELECT *, CASE WHEN event_type <> 'view' AND event_id % 3 > 0 THEN event_id % 1000 END AS t FROM events) GROUP BY event_type""")
def scoring_costs(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("model"), F.col("value").alias("latency_ms"), F.when((F.col("event_type") != "view") & (F.col("event_id") % 3 > 0), F.col("event_id") % 1000).alias("input_tokens"), (F.col("value") > 400).alias("truncated"))
    return C.costs(e).select("model", r6("latency_p50_ms").alias("latency_p50_ms"), r6("latency_p95_ms").alias("latency_p95_ms"), r6("input_tokens_per_trace").alias("input_tokens_per_trace"), "traces_scored", F.col("input_tokens_total").cast("long").alias("input_tokens_total"), "truncated")


@query("""SELECT user_id AS key, arg_max(event_type, event_id) AS model, max(event_id) AS at FROM events GROUP BY user_id""")
def answer_cache(spark, sf):
    return C.latest_answers(table(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("event_type").alias("model"), F.col("event_id").alias("at")))


@query("""SELECT user_id::VARCHAR AS trace_id, event_type AS span_id, arg_max(value, event_id) AS value, min(event_id) AS arrival_seq FROM events GROUP BY user_id, event_type""")
def span_dedup_last(spark, sf):
    return T.last_of_each_span(table(spark, sf, "events").select(F.col("user_id").cast("string").alias("trace_id"), F.col("event_type").alias("span_id"), "value", F.col("event_id").alias("arrival_seq"))).select("trace_id", "span_id", "value", "arrival_seq")


@query("""SELECT event_id AS request_id, CASE event_id % 6 WHEN 0 THEN 202 WHEN 1 THEN 200 WHEN 2 THEN 404 WHEN 3 THEN 415 WHEN 4 THEN 400 ELSE 415 END::INT AS http_status FROM events""")
def intake_status(spark, sf):
    k, i = F.col("event_id") % 6, F.col("event_id").cast("string")
    path = F.when(k == 1, intake.SPANS_PATH).when(k == 2, "/elsewhere").otherwise(intake.API_PATH)
    body = F.when(k == 4, F.concat(F.lit("["), i, F.lit("]"))).otherwise(F.concat(F.lit('{"question": "'), i, F.lit('"}')))
    requests = table(spark, sf, "events").select(F.col("event_id").alias("request_id"), path.alias("path"), F.when(k == 3, "text/plain").otherwise("application/json; charset=utf-8").alias("content_type"), F.when(k == 5, "br").alias("content_encoding"), F.encode(body, "UTF-8").alias("body"))
    return intake.received(requests).select("request_id", "http_status")


@query("""WITH m AS (SELECT event_id, user_id || ':' || (event_id % 5) AS id FROM events), f AS (SELECT id, min(event_id) AS "at" FROM m WHERE id NOT LIKE '7:%' GROUP BY id), q AS (SELECT id, "at", row_number() OVER (ORDER BY "at", id) AS r FROM f)
SELECT event_id, CASE WHEN q.id IS NULL OR (r <= 500 AND event_id > "at") THEN 'repeated' WHEN r <= 500 THEN 'queued' ELSE 'full' END AS outcome FROM m LEFT JOIN q USING (id)""")
def queue_publish(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.col("user_id").cast("string").alias("trace_id"), (F.col("event_id") % 5).alias("last_seq"), F.col("event_id").alias("at"))
    held = spark.range(5).select(F.concat(F.lit("7:"), F.col("id").cast("string")).alias("message_id"))
    return A.publish(e, held, 505).select("event_id", "outcome")


@query("""SELECT '{"doc_id":' || doc_id || ',"lang":' || coalesce('"' || lang || '"', 'null') || '}' AS value FROM documents""")
def dataset_export(spark, sf):
    return sinks.dataset_lines(table(spark, sf, "documents"), ["doc_id", "lang"])


@query("SELECT lang, count(*) AS n FROM documents WHERE lang IS NULL OR lang NOT IN ('en', 'de') GROUP BY lang")
def unknown_values(spark, sf):
    return L.unknown_values(table(spark, sf, "documents"), "lang", ["en", "de"])


@query("SELECT event_type, round_even(avg((event_id % 3 > 0)::INT), 2) AS share FROM events GROUP BY event_type")
def without_call(spark, sf):
    return R.without_call(table(spark, sf, "events").withColumn("used_search", F.col("event_id") % 3 == 0), "event_type")


@query()
def synthetic_traces(spark, sf):
    """As many made-up traces as there are turns of conversations."""
    return generate.labelled_traces(spark, table(spark, sf, "conversations").count()).groupBy("label", "failure_type").agg(F.count("*").alias("n"), F.count_distinct("qid").alias("questions"))
