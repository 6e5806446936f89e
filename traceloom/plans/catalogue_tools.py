"""Queries of tool results and training windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import control
from ..operators import runs as R
from ..operators import scoring as C
from .catalogue import query, table


@query(r"""WITH t AS (SELECT doc_id, regexp_replace(replace(text, ' the ', ' <|' || lang || '|> '), '<\|([A-Za-z0-9_]+)\|>', '<¦\1¦>', 'g') AS state FROM documents), n AS (SELECT *, ceil(length(state) / 4.0::DOUBLE)::BIGINT + 1 AS n FROM t)
SELECT doc_id, sha256(state) AS state_id, n AS state_tokens, n > 500 AS over_state, n + 40 > 530 AS over_branch, n + 70 > 590 AS over_packed, NOT (n > 500 OR n + 40 > 530 OR n + 70 > 590) AS fits FROM n""")
def training_window(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", control.rewritten(F.replace("text", F.lit(" the "), F.concat(F.lit(" <|"), F.col("lang"), F.lit("|> ")))).alias("state"))
    out = C.training_window(d, F.ceil(F.length("state") / 4) + 1, [40, 30], 500, 530, 590)
    return out.select("doc_id", F.sha2("state", 256).alias("state_id"), "state_tokens", "over_state", "over_branch", "over_packed", "fits")


@query("""WITH c AS (SELECT user_id AS run_id, event_id AS "at", CASE event_id % 3 WHEN 0 THEN 'search' WHEN 1 THEN 'lookup' ELSE 'browse' END AS name, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE event_type END AS asked, value FROM events),
t AS (SELECT user_id AS run_id, string_agg(DISTINCT event_type, '; ' ORDER BY event_type) AS titles FROM events WHERE user_id % 4 > 0 GROUP BY user_id),
s AS (SELECT c.*, coalesce(titles, '(none)') AS titles, CASE WHEN n > 60 THEN 'budget_exhausted' WHEN name = 'browse' OR coalesce(asked, '') = '' THEN 'bad_args' WHEN value > 40 THEN 'not_found' ELSE 'ok' END AS status FROM c LEFT JOIN t USING (run_id))
SELECT "at", status, CASE status WHEN 'budget_exhausted' THEN 'no more calls' WHEN 'bad_args' THEN CASE name WHEN 'search' THEN 'Invalid arguments: `query` must be a non-empty string of keywords.' WHEN 'lookup' THEN 'Invalid arguments: `title` must be a non-empty paragraph title.' ELSE 'unknown tool' END
  WHEN 'not_found' THEN CASE name WHEN 'search' THEN 'No paragraphs matched the query. Try different keywords. Available titles: ' || titles ELSE 'No paragraph titled ''' || asked || '''. Available titles: ' || titles END
  WHEN 'ok' THEN CASE name WHEN 'search' THEN '[a] first' || chr(10) || chr(10) || '[b] second ' || "at" ELSE '[a] first' END END AS result, CASE WHEN status <> 'ok' THEN 0 WHEN name = 'search' THEN 2 ELSE 1 END::INT AS shown FROM s""")
def tool_results(spark, sf):
    e, k = table(spark, sf, "events"), F.col("event_id")
    name = F.when(k % 3 == 0, "search").when(k % 3 == 1, "lookup").otherwise("browse")
    asked = F.when(k % 5 == 0, F.lit("")).when(k % 5 != 1, F.col("event_type"))
    args = F.when(k % 5 == 1, F.lit('{"query": 1, "title": ["x"]}')).otherwise(F.to_json(F.struct(F.when(k % 3 == 0, asked).alias("query"), F.when(k % 3 == 1, asked).alias("title"))))
    titles = e.where("user_id % 4 > 0").groupBy(F.col("user_id").alias("run_id")).agg(F.array_sort(F.collect_set("event_type")).alias("titles"))
    calls = R.budgeted(e.select(F.col("user_id").alias("run_id"), k.alias("at"), name.alias("name"), args.alias("args_json")), "run_id", "at", 60).join(titles, "run_id", "left").withColumn("titles", F.coalesce("titles", F.array().cast("array<string>")))
    pair = F.array(F.struct(F.lit(2).alias("rank"), F.lit("b").alias("title"), F.concat(F.lit("second "), k.cast("string")).alias("text")), F.struct(F.lit(1).alias("rank"), F.lit("a").alias("title"), F.lit("first").alias("text")))
    hits = e.where("value <= 40").select(F.col("user_id").alias("run_id"), k.alias("at"), F.explode(F.when(k % 3 == 0, pair).otherwise(F.slice(pair, 2, 1))).alias("h")).select("run_id", "at", "h.*")
    return R.tool_results(calls, hits, "no more calls").select("at", "status", "result", F.size("paragraphs").alias("shown"))
