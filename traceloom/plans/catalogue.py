"""Queries over the driver's tables, one for each operator that they can stand in for, with DuckDB SQL of the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import evaluate as E
from ..operators import labels as L
from ..operators import policy as P
from ..operators import retrieval as R
from ..operators import traces as T
from ..sources import sinks
from ..streaming import assembly as A
from .tables import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(x):
    return F.round(x, 6)


def traces_of(spark: SparkSession, sf: str) -> DataFrame:
    """A trace of each conversation: first user turn, later user turns as evidence, last assistant turn."""
    c = table(spark, sf, "conversations")
    g = c.groupBy("conv_id").agg(
        F.min_by("text", F.when(F.col("role") == "user", F.col("turn"))).alias("question"), F.max_by("text", F.when(F.col("role") == "assistant", F.col("turn"))).alias("final_answer"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == "user", F.struct("turn", "text")))), lambda x: x["text"]).alias("evidence"),
    )
    return g.select(F.col("conv_id").cast("string").alias("trace_id"), F.lit(None).cast("string").alias("agent"), F.coalesce("question", F.lit("")).alias("question"), F.array().cast(T.TOOL_CALLS).alias("tool_calls"), F.slice("evidence", 2, 1 << 20).alias("evidence"), F.coalesce("final_answer", F.lit("")).alias("final_answer"))


_TRACES = """traces AS (
  SELECT conv_id::VARCHAR AS trace_id, coalesce(arg_min(text, turn) FILTER (role = 'user'), '') AS question,
    coalesce(arg_max(text, turn) FILTER (role = 'assistant'), '') AS final_answer, coalesce((list(text ORDER BY turn) FILTER (role = 'user'))[2:], []) AS evidence
  FROM conversations GROUP BY conv_id)"""
_STATE = """state AS (SELECT *, 'USER QUESTION:' || chr(10) || question || chr(10) || chr(10) || 'TOOL CALLS:' || chr(10) || '(none)' || chr(10) || chr(10) || 'EVIDENCE:' || chr(10) ||
  CASE WHEN len(evidence) = 0 THEN '(none)' ELSE array_to_string(list_transform(evidence[:3], lambda e, i: '[' || i::VARCHAR || '] ' || substr(e, 1, 1500)), chr(10)) END
  || chr(10) || chr(10) || 'FINAL ANSWER:' || chr(10) || final_answer AS state FROM traces)"""


def _u(seed: str, key: str) -> str:
    return f"(('0x' || substr(sha256('{seed}|' || {key}), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE)"


@query(f"WITH {_TRACES} SELECT trace_id, question, final_answer, len(evidence)::INT AS n_evidence FROM traces")
def trace_from_conversation(spark, sf):
    return traces_of(spark, sf).select("trace_id", "question", "final_answer", F.size("evidence").alias("n_evidence"))


@query(f"WITH {_TRACES}, {_STATE} SELECT trace_id, state, sha256(state) AS state_id FROM state")
def build_state(spark, sf):
    return T.build_state(traces_of(spark, sf)).select("trace_id", "state", F.sha2("state", 256).alias("state_id"))


@query(f"""WITH {_TRACES} SELECT trace_id, array_to_string(list_filter([CASE WHEN trim(question) = '' THEN 'question is empty' END, CASE WHEN trace_id::BIGINT % 3 = 0 THEN 'agent is too long' END,
  CASE WHEN trace_id::BIGINT % 5 = 0 THEN 'a tool call without a name' END, CASE WHEN trace_id::BIGINT % 7 = 0 THEN 'final_answer is missing' END], lambda x: x IS NOT NULL), '; ') AS problems FROM traces""")
def trace_problems(spark, sf):
    i = F.col("trace_id").cast("long")
    calls = F.when(i % 5 == 0, F.array(F.struct(F.lit("").alias("name"), F.lit("{}").alias("args_json"), F.lit('"ok"').alias("status_json")))).otherwise(F.col("tool_calls"))
    odd = traces_of(spark, sf).withColumns({"agent": F.when(i % 3 == 0, F.repeat(F.lit("é"), 65)), "tool_calls": calls, "final_answer": F.when(i % 7 != 0, F.col("final_answer"))})
    return T.problems(odd).select("trace_id", F.array_join("problems", "; ").alias("problems"))


@query("SELECT event_id, '{\"k\":' || regexp_extract(props, '\"k\": ([0-9]+)', 1) || '}' AS compact FROM events")
def compact_args(spark, sf):
    return table(spark, sf, "events").select("event_id", S.compact_json("props").alias("compact"))


_SESS = """s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM (
  SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 3600000000 THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)))"""


@query(f"WITH {_SESS} SELECT user_id, session, count(*) AS n, count(DISTINCT event_type) AS kinds FROM s GROUP BY user_id, session")
def session_idle(spark, sf):
    s = A.idle_sessions(table(spark, sf, "events"), "user_id", "ts", 3600, ("event_id",))
    return s.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.count_distinct("event_type").alias("kinds"))


@query()
def session_idle_maxwait(spark, sf):
    return A.replayed_sessions(table(spark, sf, "events"), "user_id", "ts", 3600, 14_400)


def _spans(spark, sf):
    """Events as spans: a session is a trace, and a view's parent is the event before it."""
    from pyspark.sql import Window

    s = A.idle_sessions(table(spark, sf, "events"), "user_id", "ts", 3600, ("event_id",))
    order = Window.partitionBy("user_id", "session").orderBy("ts", "event_id")
    kind = F.when(F.col("event_type") == "click", "AGENT").when(F.col("event_type") == "view", "CHAIN").otherwise("TOOL")
    return s.select(F.concat_ws("-", "user_id", "session").alias("trace_id"), F.col("event_id").cast("string").alias("span_id"), F.when(F.col("event_type") == "view", F.lag("event_id").over(order).cast("string")).alias("parent_span_id"), F.col("event_type").alias("name"), F.unix_micros(F.col("ts").cast("timestamp")).alias("start_unix_nano"), F.create_map(F.lit("openinference.span.kind"), kind).alias("attributes"), F.col("event_id").alias("arrival_seq"))


@query(f"""WITH {_SESS}, p AS (SELECT user_id::VARCHAR || '-' || session::VARCHAR AS trace_id, event_id, event_type, ts,
  CASE WHEN event_type = 'view' THEN lag(event_id) OVER (PARTITION BY user_id, session ORDER BY ts, event_id) END AS parent FROM s)
SELECT trace_id, event_id::VARCHAR AS span_id, event_type AS name FROM (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY
  CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 ELSE 2 END, ts, event_id) AS r FROM p WHERE parent IS NULL) WHERE r = 1""")
def span_root_pick(spark, sf):
    return T.roots(_spans(spark, sf)).select("trace_id", "span_id", "name")


@query("SELECT user_id::VARCHAR AS trace_id, (event_id // 2)::VARCHAR AS span_id, arg_min(event_type, event_id) AS name, min(event_id) AS arrival_seq FROM events GROUP BY user_id, event_id // 2")
def span_dedup_first(spark, sf):
    e = table(spark, sf, "events")
    spans = e.select(F.col("user_id").cast("string").alias("trace_id"), F.floor(F.col("event_id") / 2).cast("string").alias("span_id"), F.col("event_type").alias("name"), F.col("event_id").alias("arrival_seq"))
    return T.first_of_each_span(spans.unionByName(spans)).select("trace_id", "span_id", "name", "arrival_seq")


@query("""WITH p AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM conversations), f AS (
  SELECT conv_id, trim(x) AS x, min(turn * 100000 + i) AS place FROM p WHERE trim(x) <> '' GROUP BY conv_id, trim(x))
SELECT conv_id, count(*)::INT AS n, sha256(string_agg(x, '|' ORDER BY place)) AS digest FROM f GROUP BY conv_id""")
def evidence_first_seen(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    lines = F.array_distinct(F.filter(F.transform(F.flatten(F.transform("t", lambda x: F.split(x["text"], "\n"))), lambda x: F.trim(x)), lambda x: x != ""))
    return c.select("conv_id", F.size(lines).alias("n"), F.sha2(F.array_join(lines, "|"), 256).alias("digest")).where("n > 0")


@query("""SELECT o_orderkey, CASE WHEN n_name IS NULL THEN 'other' ELSE n_name END AS agent_label, coalesce('model-' || n_regionkey::VARCHAR, 'base') AS model
FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 3 <> 0) n ON c_nationkey = n_nationkey""")
def agent_route(spark, sf):
    nation = table(spark, sf, "nation")
    models = nation.where("n_nationkey % 3 <> 0").select(F.col("n_name").alias("agent"), F.concat(F.lit("model-"), F.col("n_regionkey").cast("string")).alias("model"))
    named = table(spark, sf, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("agent"))  # nation has 25 rows
    orders = table(spark, sf, "orders").join(named, F.col("o_custkey") == F.col("c_custkey"))
    return P.route(orders, models, "base").select("o_orderkey", "agent_label", "model")


_P = "(value / 500.0::DOUBLE)"
_CAL = f"1 / (1 + exp(-ln(least(greatest({_P}, 1e-6::DOUBLE), (1 - 1e-6)::DOUBLE) / (1 - least(greatest({_P}, 1e-6::DOUBLE), (1 - 1e-6)::DOUBLE))) / 0.86::DOUBLE))"


def _scores(spark, sf):
    return table(spark, sf, "events").withColumn("p", F.col("value") / F.lit(500.0)).withColumn("y", F.col("event_type") == "error")


@query(f"SELECT event_id, round({_CAL}, 6) AS p_keep FROM events")
def calibrate(spark, sf):
    return _scores(spark, sf).select("event_id", r6(S.calibrate(F.col("p"), 0.86)).alias("p_keep"))


_DECIDED = f"""d AS (SELECT event_id, event_type, p, u, (p IS NOT NULL AND p >= 0.2::DOUBLE) OR u < 0.1::DOUBLE AS keep FROM (
  SELECT event_id, event_type, CASE WHEN event_type <> 'error' THEN {_CAL} END AS p, {_u('floor', 'event_id::VARCHAR')} AS u FROM events)),
e AS (SELECT *, CASE WHEN p IS NULL THEN 'fallback' WHEN p >= 0.2::DOUBLE THEN 'kev' WHEN u < 0.1::DOUBLE THEN 'random_floor' ELSE 'below_threshold' END AS reason,
  CASE WHEN NOT keep THEN 'none' WHEN p IS NOT NULL AND p >= 0.4::DOUBLE THEN 'high' ELSE 'normal' END AS severity FROM d)"""


def _decided(spark, sf):
    df = _scores(spark, sf).withColumn("p_keep", F.when(F.col("event_type") != "error", S.calibrate(F.col("p"), 0.86))).withColumn("u", S.uniform("floor", F.col("event_id")))
    return P.decide(df, keep_from=0.2, floor=0.1, high_from=0.4)


@query(f"WITH {_DECIDED} SELECT event_id, keep, reason, severity FROM e")
def decide_policy(spark, sf):
    return _decided(spark, sf).select("event_id", "keep", "reason", "severity")


@query(f"WITH {_DECIDED} SELECT reason, severity, count(*) AS n FROM e GROUP BY reason, severity")
def decision_counts(spark, sf):
    return _decided(spark, sf).groupBy("reason", "severity").agg(F.count("*").alias("n"))


@query(f"WITH {_DECIDED} SELECT event_id, CASE WHEN keep THEN 'keep' ELSE 'drop' END AS decision, reason, severity, round(p, 6) AS p_keep FROM e")
def result_projection(spark, sf):
    out = P.api_result(_decided(spark, sf).withColumns({"trace_id": F.col("event_id"), "p_keep_raw": F.col("p")}))
    return out.select(F.col("trace_id").alias("event_id"), "decision", "reason", "severity", r6("p_keep").alias("p_keep"))


@query("""SELECT event_id, CASE WHEN s BETWEEN 200 AND 299 THEN NULL WHEN s IN (400, 413, 422) THEN 'rejected' ELSE 'unavailable' END AS error_kind,
  coalesce(CASE WHEN s BETWEEN 200 AND 299 THEN NULL WHEN s IN (400, 413, 422) THEN 'rejected' ELSE 'unavailable' END IN ('unavailable', 'timeout', 'full'), false) AS retry
FROM (SELECT event_id, [200, 400, 413, 422, 429, 500, 503, 404][(event_id % 8 + 1)::INT] AS s FROM events)""")
def fallback_policy(spark, sf):
    s = F.element_at(F.array(*map(F.lit, (200, 400, 413, 422, 429, 500, 503, 404))), (F.col("event_id") % 8 + 1).cast("int"))
    df = table(spark, sf, "events").withColumn("error_kind", P.error_kind(s))
    return df.select("event_id", "error_kind", F.coalesce(F.col("error_kind").isin(*P.RETRYABLE), F.lit(False)).alias("retry"))


@query(f"""WITH {_DECIDED}, k AS (SELECT event_id, unnest(['review', 'archive']) AS sink FROM e WHERE keep) SELECT sink, count(*) AS n, min(event_id) AS first_id FROM k GROUP BY sink""")
def export_fanout(spark, sf):
    """Kept rows written by two sinks and read back; a third fails by itself."""
    path = f"{shared_dir(spark)}/fan-out-{uuid.uuid4().hex}"

    def fails(df):
        raise OSError("no such back end")

    written = {name: lambda df, name=name: sinks.export_records(df).select("event_id").write.parquet(f"{path}/{name}") for name in ("review", "archive")}
    said = sinks.fan_out(_decided(spark, sf), {"broken": fails, **written})
    got = [spark.read.parquet(f"{path}/{name}").select(F.lit(name).alias("sink"), "event_id") for name, error in said.items() if error is None]
    return got[0].unionByName(got[1]).groupBy("sink").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query("""SELECT doc_id::VARCHAR AS trace_id, CASE WHEN quality = 1 AND doc_id % 7 <> 0 THEN 'correct' WHEN doc_id % 7 = 0 AND toxic = 1 THEN 'wrong' WHEN doc_id % 7 = 0 THEN 'partial' ELSE 'wrong' END AS verdict FROM labels""")
def latest_annotation(spark, sf):
    lb = table(spark, sf, "labels")
    base = lambda label, at, seq: lb.select(F.lit("review").alias("name"), F.lit(None).cast("string").alias("trace_id"), F.col("doc_id").cast("string").alias("span_id"), label.alias("label"), F.lit(None).cast("double").alias("score"), F.lit("2024-01-01").alias("created_at"), F.lit(at).alias("updated_at"), F.lit(seq).alias("seq"), "doc_id")
    first = base(F.when(F.col("quality") == 1, "Good").otherwise("fail"), "", 1)
    later = base(F.when(F.col("toxic") == 1, "bad").otherwise("partially correct"), "2024-02-01", 2).where("doc_id % 7 = 0")
    junk = base(F.lit("no idea"), "2024-03-01", 3)
    spans = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("span_id"), F.col("doc_id").cast("string").alias("trace_id"))
    return L.latest_verdicts(first.unionByName(later).unionByName(junk), "review", spans)


@query("""SELECT l, CASE l WHEN 'Right ' THEN 'correct' WHEN 'PASS' THEN 'correct' WHEN 'partially_correct' THEN 'partial' WHEN 'fail' THEN 'wrong' END AS label, count(*) AS n
FROM (SELECT ['Right ', 'PASS', 'partially_correct', 'fail', 'dunno'][(doc_id % 5 + 1)::INT] AS l FROM labels) GROUP BY l, label""")
def label_normalize(spark, sf):
    raw = F.element_at(F.array(*map(F.lit, ("Right ", "PASS", "partially_correct", "fail", "dunno"))), (F.col("doc_id") % 5 + 1).cast("int"))
    return table(spark, sf, "labels").select(raw.alias("l")).withColumn("label", S.normalize_label(F.col("l"))).groupBy("l", "label").agg(F.count("*").alias("n"))


_TOK = r"""list_filter(regexp_split_to_array(regexp_replace(lower({0}), '[!-/:-@\[-`{{-~]', '', 'g'), '\s+'), lambda w: w NOT IN ('', 'a', 'an', 'the'))"""


@query(f"""WITH t AS (SELECT a.item_id, {_TOK.format('a.text')} AS p, {_TOK.format('b.text')} AS g FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id - a.item_id % 3),
c AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(p), lambda w: least(len(list_filter(p, lambda x: x = w)), len(list_filter(g, lambda x: x = w))))), 0)::DOUBLE AS same FROM t),
f AS (SELECT *, CASE WHEN same = 0 THEN 0.0::DOUBLE ELSE 2 * (same / len(p)) * (same / len(g)) / (same / len(p) + same / len(g)) END AS f1 FROM c)
SELECT item_id, CASE WHEN p = g THEN 'correct' WHEN f1 >= 0.8::DOUBLE THEN 'correct' WHEN f1 >= 0.3::DOUBLE THEN 'partial' ELSE 'wrong' END AS label, round(f1, 6) AS f1 FROM f""")
def label_from_reference(spark, sf):
    a = table(spark, sf, "benchmark")
    b = a.select(F.col("item_id").alias("_i"), F.col("text").alias("gold"))
    df = a.join(b, F.col("_i") == F.col("item_id") - F.col("item_id") % 3)
    return df.select("item_id", S.label_from_reference(F.col("text"), F.col("gold")).alias("label"), r6(S.answer_f1(F.col("text"), F.col("gold"))).alias("f1"))


_SPLIT = """k AS (SELECT conv_id FROM conversations GROUP BY conv_id), h AS (SELECT conv_id FROM k ORDER BY sha256('7-held|' || conv_id), conv_id LIMIT (SELECT round_even(count(*) * 0.2::DOUBLE, 0)::BIGINT FROM k)),
cal AS (SELECT conv_id FROM h ORDER BY sha256('7-calib|' || conv_id), conv_id LIMIT (SELECT round_even(count(*) * 0.5::DOUBLE, 0)::BIGINT FROM h)),
portions AS (SELECT conv_id, CASE WHEN conv_id IN (SELECT conv_id FROM cal) THEN 'calibration' WHEN conv_id IN (SELECT conv_id FROM h) THEN 'test' ELSE 'train' END AS portion FROM k)"""


def _portions(spark, sf):
    return L.split(table(spark, sf, "conversations").select("conv_id", "turn", "role"), "conv_id")


@query(f"WITH {_SPLIT} SELECT conv_id, portion FROM portions")
def question_split(spark, sf):
    return _portions(spark, sf).select("conv_id", "portion").distinct()


@query(f"WITH {_SPLIT} SELECT count(*) AS leaks FROM (SELECT conv_id FROM portions GROUP BY conv_id HAVING count(DISTINCT portion) > 1)")
def split_leak_check(spark, sf):
    return L.leaks(_portions(spark, sf), "conv_id").agg(F.count("*").alias("leaks"))


@query(f"WITH {_SPLIT} SELECT portion, count(*) AS traces, count(DISTINCT conv_id) AS questions, count(*) FILTER (role <> 'user') AS wrong FROM conversations JOIN portions USING (conv_id) GROUP BY portion")
def split_report(spark, sf):
    return L.split_report(_portions(spark, sf).withColumn("label", F.when(F.col("role") == "user", "correct").otherwise("wrong")), "conv_id")


@query("""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN text IS NULL THEN 'missing text' WHEN length(text) < 60 THEN 'short' WHEN length(text) > 20000 THEN 'long' END AS reason FROM documents) WHERE reason IS NOT NULL GROUP BY reason""")
def skip_reasons(spark, sf):
    from ..sources.traces import skip_reasons as count

    n = F.length("text")
    return count(table(spark, sf, "documents").select(F.when(n.isNull(), "missing text").when(n < 60, "short").when(n > 20000, "long").alias("reason")))


@query("""SELECT lang, quality, round_even(n / sum(n) OVER (PARTITION BY lang), 2) AS share FROM (SELECT lang, quality, count(*)::DOUBLE AS n FROM documents JOIN labels USING (doc_id) GROUP BY lang, quality)""")
def crosstab_rate(spark, sf):
    return L.crosstab(table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id"), "lang", "quality")


_AUC = "(sum(CASE WHEN y THEN r END) - sum(y::INT)::DOUBLE * (sum(y::INT) + 1) / 2) / (sum(y::INT)::DOUBLE * sum((NOT y)::INT))"


@query(f"""SELECT 1 AS part, round({_AUC}, 6) AS auroc FROM (SELECT event_type = 'error' AS y, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0::DOUBLE AS r FROM events)""")
def auroc(spark, sf):
    return E.auroc(_scores(spark, sf).withColumn("part", F.lit(1)), ["part"]).select("part", r6("auroc").alias("auroc"))


@query(f"""SELECT b, round({_AUC}, 6) AS auroc FROM (SELECT user_id % 4 AS b, event_type = 'error' AS y, rank() OVER (PARTITION BY user_id % 4 ORDER BY value) + (count(*) OVER (PARTITION BY user_id % 4, value) - 1) / 2.0::DOUBLE AS r FROM events) GROUP BY b""")
def auroc_by_type(spark, sf):
    return E.auroc(_scores(spark, sf).withColumn("b", F.col("user_id") % 4), ["b"]).select("b", r6("auroc").alias("auroc"))


@query("""WITH r AS (SELECT user_id % 4 AS b, event_type = 'error' AS y, row_number() OVER (PARTITION BY user_id % 4 ORDER BY value DESC, event_id) AS r, count(*) OVER (PARTITION BY user_id % 4) AS n FROM events),
m AS (SELECT b, rate, greatest(1, ceil(rate * n))::BIGINT AS k, y, r, n FROM r, (SELECT unnest([0.05::DOUBLE, 0.1::DOUBLE, 0.25::DOUBLE]) AS rate)),
a AS (SELECT b, rate, any_value(k) AS k, any_value(n) AS n, count(*) FILTER (y) AS pos, count(*) FILTER (y AND r <= k) AS hits FROM m GROUP BY b, rate)
SELECT b, rate, k, round(hits / pos::DOUBLE, 6) AS recall, round((hits / pos::DOUBLE - k / n::DOUBLE) / (least(1.0::DOUBLE, k / pos::DOUBLE) - k / n::DOUBLE), 6) AS normalized FROM a""")
def sampler_metrics(spark, sf):
    out = E.sampler_metrics(_scores(spark, sf).withColumn("b", F.col("user_id") % 4), ["b"], [0.05, 0.1, 0.25], pos="event_id")
    return out.select("b", "rate", F.col("k").cast("long").alias("k"), r6("recall").alias("recall"), r6("normalized").alias("normalized"))


@query("""WITH s AS (SELECT event_id, value, event_type = 'error' AS y FROM events), c AS (SELECT count(*) FILTER (NOT y) AS c FROM s),
e AS (SELECT s.*, b.base_rate, r.resample, sha256('r|' || b.base_rate || '|' || r.resample || '|' || event_id) AS pos, round_even(b.base_rate * c / (1 - b.base_rate), 0) AS nw
  FROM s, c, (SELECT unnest([0.05::DOUBLE, 0.1::DOUBLE]) AS base_rate) b, (SELECT unnest([0, 1, 2]) AS resample) r),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY base_rate, resample, y ORDER BY pos) AS n FROM e) WHERE NOT y OR n <= nw),
q AS (SELECT *, row_number() OVER (PARTITION BY base_rate, resample ORDER BY value DESC, pos) AS r, count(*) OVER (PARTITION BY base_rate, resample) AS t FROM k),
m AS (SELECT base_rate, resample, count(*) FILTER (y AND r <= greatest(1, ceil(0.1::DOUBLE * t))) / count(*) FILTER (y)::DOUBLE AS recall FROM q GROUP BY base_rate, resample)
SELECT base_rate, round(avg(recall), 6) AS recall_mean, round(stddev_pop(recall), 6) AS recall_std FROM m GROUP BY base_rate""")
def rebalanced_recall(spark, sf):
    sets = E.rebalanced(_scores(spark, sf).select("event_id", "p", "y"), [0.05, 0.1], 3, "event_id")
    out = E.summarised(E.sampler_metrics(sets, ["base_rate", "resample"], [0.1]), ["base_rate"], "recall")
    return out.select("base_rate", r6("recall_mean").alias("recall_mean"), r6("recall_std").alias("recall_std"))


@query("""WITH m AS (SELECT model, b, avg(v) AS v FROM (SELECT unnest(['m1', 'm2', 'm3']) AS model, user_id % 16 AS b, unnest([value, value * 1.1::DOUBLE - (event_id % 5), value * 0.9::DOUBLE + (event_id % 3)]) AS v FROM events) GROUP BY model, b)
SELECT x.model AS a, y.model AS b, round(avg(x.v - y.v), 6) AS mean, round(stddev_pop(x.v - y.v), 6) AS std, count(*) FILTER (x.v > y.v) AS wins FROM m x JOIN m y ON x.b = y.b AND x.model < y.model GROUP BY ALL""")
def paired_diff(spark, sf):
    v = [F.col("value"), F.col("value") * 1.1 - (F.col("event_id") % 5), F.col("value") * 0.9 + (F.col("event_id") % 3)]
    each = table(spark, sf, "events").select((F.col("user_id") % 16).alias("bucket"), F.explode(F.array(*[F.struct(F.lit(f"m{i + 1}").alias("model"), x.cast("double").alias("v")) for i, x in enumerate(v)])).alias("s")).select("bucket", "s.*")
    out = E.paired_difference(each.groupBy("model", "bucket").agg(F.avg("v").alias("v")), "model", ["bucket"], "v")
    return out.select("a", "b", r6("mean").alias("mean"), r6("std").alias("std"), "wins")


_EDGE = " + ".join(f"({_P} >= {e!r}::DOUBLE)::INT" for e in E.EDGES[1:])


@query(f"""WITH b AS (SELECT least(9, {_EDGE}) AS bin, count(*) AS n, avg({_P}) AS mp, avg((event_type = 'error')::INT) AS my FROM events GROUP BY 1) SELECT 1 AS part, round(sum(abs(mp - my) * n) / sum(n), 6) AS ece FROM b""")
def ece(spark, sf):
    return E.ece(_scores(spark, sf).withColumn("part", F.lit(1)), ["part"]).select("part", r6("ece").alias("ece"))


_CALT = _CAL.replace("0.86::DOUBLE", "t")


@query(f"""WITH g AS (SELECT t, {_CALT} AS q0, event_type = 'error' AS y, {_P} AS p FROM events, (SELECT unnest([0.5::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE, 4.0::DOUBLE]) AS t)),
h AS (SELECT t, y, least(greatest(CASE WHEN t = 1 THEN p ELSE q0 END, 1e-9::DOUBLE), (1 - 1e-9)::DOUBLE) AS q FROM g) SELECT t, round(avg(-CASE WHEN y THEN ln(q) ELSE ln(1 - q) END), 6) AS nll FROM h GROUP BY t""")
def nll_temperature_grid(spark, sf):
    return E.temperature_grid(_scores(spark, sf), [], [0.5, 1.0, 2.0, 4.0]).select("t", r6("nll").alias("nll"))


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type")
def latency_percentiles(spark, sf):
    return E.latency(table(spark, sf, "events"), ["event_type"], "value").select("event_type", r6("p50").alias("p50"), r6("p95").alias("p95"))


@query("""SELECT event_type, CASE WHEN s <= 0.001 THEN 0.001 WHEN s <= 0.005 THEN 0.005 WHEN s <= 0.01 THEN 0.01 WHEN s <= 0.025 THEN 0.025 WHEN s <= 0.05 THEN 0.05 WHEN s <= 0.1 THEN 0.1 WHEN s <= 0.25 THEN 0.25 WHEN s <= 0.5 THEN 0.5 ELSE 1.0 END::DOUBLE AS le, count(*) AS n
FROM (SELECT event_type, value / 1000.0::DOUBLE AS s FROM events) GROUP BY ALL""")
def duration_histogram(spark, sf):
    return E.histogram(table(spark, sf, "events").withColumn("s", F.col("value") / F.lit(1000.0)), ["event_type"], "s")


_WORDS = "regexp_extract_all(lower({0}), '[a-z0-9]+')"


@query(f"""WITH {_TRACES}, w AS (SELECT trace_id, {_WORDS.format('final_answer')} AS a, {_WORDS.format("array_to_string(evidence, ' ')")} AS e, len(evidence) AS n FROM traces)
SELECT trace_id, -len(a)::INT AS short_answer, -n::INT AS few_evidence, round(CASE WHEN len(a) = 0 THEN 1.0::DOUBLE ELSE 1 - len(list_filter(a, lambda x: list_contains(e, x)))::DOUBLE / len(a) END, 6) AS low_overlap,
  (NOT CASE WHEN trace_id::BIGINT % 3 = 0 THEN trace_id::BIGINT % 4 = 0 ELSE trace_id::BIGINT % 2 = 0 END)::INT::DOUBLE AS no_search, (trace_id::BIGINT % 4 = 0 AND trace_id::BIGINT % 8 <> 0)::INT::DOUBLE AS tool_error, (trace_id::BIGINT % 5 = 0)::INT::DOUBLE AS bad_stop FROM w""")
def heuristic_features(spark, sf):
    i = F.col("trace_id").cast("long")
    call = F.struct(F.lit("search").alias("name"), F.lit("{}").alias("args_json"), F.when(i % 8 != 0, '"error"').alias("status_json"))
    df = traces_of(spark, sf).withColumns({"used_search": F.when(i % 3 != 0, i % 2 == 0), "stop_reason": F.when(i % 5 == 0, "max_steps"), "tool_calls": F.when(i % 4 == 0, F.array(call)).otherwise(F.col("tool_calls"))})
    return L.heuristics(df).select("trace_id", "short_answer", "few_evidence", r6("low_overlap").alias("low_overlap"), "no_search", "tool_error", "bad_stop")


@query()
def heuristic_logreg(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("a"), F.col("embedding")[1].cast("double").alias("b"), (F.col("label") < 5).alias("y"))
    held = F.col("vec_id") % 2 == 1  # the stated split: even ids train, all rows are scored
    return L.logistic(e.where(~held), e, ["a", "b"], "y").select("vec_id", held.alias("held_out"), "p")


_PICKS = """p AS (SELECT * FROM (SELECT model, event_id, row_number() OVER (PARTITION BY model ORDER BY v DESC, sha256('tie|' || event_id)) AS r FROM (
  SELECT unnest(['m1', 'm2', 'm3']) AS model, event_id, unnest([value, value + (event_id % 7) * 20, value - (event_id % 3) * 50]) AS v FROM events)) WHERE r <= 200)"""


def _picked(spark, sf):
    v = [F.col("value"), F.col("value") + (F.col("event_id") % 7) * 20, F.col("value") - (F.col("event_id") % 3) * 50]
    each = table(spark, sf, "events").select("event_id", F.explode(F.array(*[F.struct(F.lit(f"m{i + 1}").alias("model"), x.cast("double").alias("p")) for i, x in enumerate(v)])).alias("s")).select("event_id", "s.*")
    return E.picks(each, "model", 200, "event_id")


@query(f"WITH {_PICKS} SELECT a.model AS a, b.model AS b, round(count(*) / (400.0::DOUBLE - count(*)), 6) AS jaccard FROM p a JOIN p b ON a.event_id = b.event_id AND a.model < b.model GROUP BY ALL")
def pick_overlap(spark, sf):
    return E.pick_overlap(_picked(spark, sf), "model", "event_id").select("a", "b", r6("jaccard").alias("jaccard"))


@query(f"WITH {_PICKS} SELECT DISTINCT a.model AS a, b.model AS b FROM (SELECT DISTINCT model FROM p) a JOIN (SELECT DISTINCT model FROM p) b ON a.model < b.model")
def model_pairs(spark, sf):
    return E.pick_overlap(_picked(spark, sf), "model", "event_id").select("a", "b")


@query(r"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}\p{Pc}]+') AS ts FROM documents), s AS (SELECT count(*)::DOUBLE AS n, avg(len(ts)) AS mean FROM d),
w AS (SELECT q, t, count(*) AS times FROM (SELECT item_id AS q, unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}\p{Pc}]+')) AS t FROM benchmark) GROUP BY q, t),
tf AS (SELECT doc_id, any_value(len) AS len, t, count(*) AS tf FROM (SELECT doc_id, len(ts) AS len, unnest(ts) AS t FROM d) WHERE t IN (SELECT t FROM w) GROUP BY doc_id, t),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
x AS (SELECT q, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * len / mean)) * times) AS score FROM tf JOIN df USING (t) JOIN w USING (t), s GROUP BY q, doc_id)
SELECT q AS query_id, doc_id, r AS rank, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, doc_id) AS r FROM x) WHERE r <= 3""")
def bm25_topk(spark, sf):
    out = R.bm25(table(spark, sf, "documents"), table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text"))
    return out.select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), F.round("score", 4).alias("score"))


@query("""WITH w AS (SELECT DISTINCT CASE WHEN p_partkey % 7 = 0 THEN p_name || '~' WHEN p_partkey % 7 = 1 THEN repeat('~', 9) || p_partkey WHEN p_partkey % 2 = 0 THEN p_name ELSE upper(p_name) END AS wanted FROM part)
SELECT DISTINCT wanted, p_name AS found, CASE WHEN wanted = p_name THEN 'exact' WHEN lower(wanted) = lower(p_name) THEN 'case' ELSE 'similar' END AS how FROM w JOIN part ON p_name = wanted OR upper(p_name) = wanted OR p_name || '~' = wanted""")
def title_lookup(spark, sf):
    part, name, k = table(spark, sf, "part"), F.col("p_name"), F.col("p_partkey") % 7
    wanted = F.when(k == 0, F.concat(name, F.lit("~"))).when(k == 1, F.concat(F.lit("~" * 9), F.col("p_partkey").cast("string"))).when(F.col("p_partkey") % 2 == 0, name).otherwise(F.upper(name))
    return R.lookup(part.select(name.alias("title")), part.select(wanted.alias("title")))


@query("SELECT o_orderkey, substr(sha256(o_orderkey || '|natural'), 1, 16) AS run_key FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = 3)")
def resume_anti(spark, sf):
    key = lambda c: S.run_key(F.col(c).cast("string"), F.lit("natural")).alias("run_key")
    planned = table(spark, sf, "orders").select("o_orderkey", key("o_orderkey"))
    return R.resume(planned, table(spark, sf, "lineitem").where("l_linenumber = 3").select(key("l_orderkey")))


@query("""WITH q AS (SELECT item_id AS qid, CASE item_id % 9 WHEN 0 THEN 'Yes' WHEN 1 THEN upper(text) ELSE text END AS answer FROM benchmark),
u AS (SELECT lower(answer) AS low, min(answer) AS answer FROM q WHERE lower(answer) NOT IN ('yes', 'no') GROUP BY 1),
r AS (SELECT low, coalesce(lead(answer) OVER o, first_value(answer) OVER o) AS decoy FROM u WINDOW o AS (ORDER BY sha256('decoy|' || low))),
f AS (SELECT arg_min(answer, sha256('decoy|' || low)) AS any_one FROM u)
SELECT qid, CASE WHEN lower(coalesce(decoy, any_one)) <> lower(answer) THEN coalesce(decoy, any_one) END AS decoy FROM q LEFT JOIN r ON low = lower(answer), f""")
def decoy_theta(spark, sf):
    i = F.col("item_id")
    q = table(spark, sf, "benchmark").select(i.alias("qid"), F.when(i % 9 == 0, "Yes").when(i % 9 == 1, S.simple_upper(F.col("text"))).otherwise(F.col("text")).alias("answer"))
    return R.decoys(q, q).select("qid", "decoy")


@query(f"""SELECT qid, condition, substr(sha256(qid || '|' || condition), 1, 16) AS run_key FROM (SELECT item_id AS qid, unnest(CASE WHEN {_u('plan', 'item_id::VARCHAR')} < 0.5 THEN ['natural', CASE WHEN {_u('plan-mix', 'item_id::VARCHAR')} < 0.4::DOUBLE THEN 'missing_evidence' WHEN {_u('plan-mix', 'item_id::VARCHAR')} < 0.7::DOUBLE THEN 'contradiction'
  WHEN {_u('plan-mix', 'item_id::VARCHAR')} < 0.9::DOUBLE THEN 'early_stop' ELSE 'weak_model' END] ELSE ['natural'] END) AS condition FROM benchmark)""")
def run_plan(spark, sf):
    return R.plan_runs(table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"))).select("qid", "condition", "run_key")


@query("""SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256('pick|' || doc_id), doc_id) AS r, dense_rank() OVER (ORDER BY lang) AS v, (SELECT count(DISTINCT lang) FROM documents) AS n FROM documents)
WHERE r <= 41 // n + (CASE WHEN v <= 41 % n THEN 1 ELSE 0 END)""")
def stratified_pick(spark, sf):
    return L.stratified_pick(table(spark, sf, "documents").select("lang", "doc_id"), "lang", "doc_id", 41, "pick")


@query("""SELECT event_id, CASE WHEN k IS NULL THEN 'sent' WHEN k = 'invalid' OR d >= 5 THEN 'dead' ELSE 'retried' END AS outcome, CASE WHEN k = 'unavailable' AND d < 5 THEN [5.0, 30.0, 120.0, 300.0][least(d, 4)::INT]::DOUBLE END AS wait_s
FROM (SELECT event_id, (event_id % 6 + 1) AS d, CASE event_type WHEN 'error' THEN 'invalid' WHEN 'view' THEN 'unavailable' END AS k FROM events)""")
def retry_dead_letter(spark, sf):
    df = table(spark, sf, "events").select("event_id", (F.col("event_id") % 6 + 1).cast("int").alias("deliveries"), F.when(F.col("event_type") == "error", "invalid").when(F.col("event_type") == "view", "unavailable").alias("error_kind"))
    return A.settle(df).select("event_id", "outcome", "wait_s")


@query("""SELECT epoch_us(date_trunc('day', ts)) AS day_us, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def ext_windows(spark, sf):
    e = table(spark, sf, "events").withColumn("t", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("t", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.unix_micros("w.start").alias("day_us"), "event_type", "n", "total")


@query(f"""WITH {_TRACES}, {_STATE}, p AS (SELECT trace_id, sha256(state) AS state_id, ('0x' || substr(sha256(state), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS p, {_u('floor', 'trace_id')} AS u FROM state),
q AS (SELECT *, 1 / (1 + exp(-ln(least(greatest(p, 1e-6::DOUBLE), (1 - 1e-6)::DOUBLE) / (1 - least(greatest(p, 1e-6::DOUBLE), (1 - 1e-6)::DOUBLE))) / 0.86::DOUBLE)) AS c FROM p)
SELECT trace_id, state_id, 'base' AS model, 'none' AS agent_label, round(p, 9) AS p_keep_raw, round(c, 9) AS p_keep, c >= 0.5::DOUBLE OR u < 0.02::DOUBLE AS keep, CASE WHEN c >= 0.5::DOUBLE THEN 'kev' WHEN u < 0.02::DOUBLE THEN 'random_floor' ELSE 'below_threshold' END AS reason,
  CASE WHEN c >= 0.8::DOUBLE THEN 'high' WHEN c >= 0.5::DOUBLE OR u < 0.02::DOUBLE THEN 'normal' ELSE 'none' END AS severity FROM q""")
def engine_pipeline(spark, sf):
    models = spark.createDataFrame([("none", "m")], "agent string, model string")
    out = P.run_engine(traces_of(spark, sf), models, temperature=0.86)
    return out.select("trace_id", F.sha2("state", 256).alias("state_id"), "model", "agent_label", F.round("p_keep_raw", 9).alias("p_keep_raw"), F.round("p_keep", 9).alias("p_keep"), "keep", "reason", "severity")


@query(f"WITH {_TRACES} SELECT trace_id, question, final_answer FROM traces WHERE trim(question) <> ''")
def span_round_trip(spark, sf):
    t = traces_of(spark, sf)
    spans = T.to_spans(t.withColumn("trace_id", F.md5("trace_id"))).withColumns({"status_code": F.lit(None).cast("string"), "resource_attributes": F.create_map().cast("map<string,string>")})
    back = T.assemble(spans).where("reason IS NULL").withColumnRenamed("trace_id", "id")
    return back.join(t.select("trace_id", F.md5("trace_id").alias("id")), "id").select("trace_id", "question", "final_answer")


from . import catalogue_compare, catalogue_finetune, catalogue_metrics, catalogue_runs, catalogue_sources, catalogue_tools  # noqa: E402, F401  register their queries
