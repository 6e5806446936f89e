"""Queries that write the given tables as files of traces, in the shared folder, and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources import folders
from ..sources import traces as R
from .catalogue import query, table
from .tables import shared_dir


def _folder(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("""WITH l AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS n FROM documents)
SELECT 'line-' || n AS trace_id, CASE WHEN doc_id % 5 < 3 THEN CASE WHEN n_chars % 2 = 0 THEN 'correct' ELSE 'wrong' END END AS label,
  CASE WHEN doc_id % 5 = 3 THEN 'not JSON' WHEN doc_id % 5 = 4 THEN 'missing final_answer' END AS reason FROM l WHERE doc_id % 11 <> 0""")
def line_numbers(spark, sf):
    """Documents as labelled lines in many files, some blank, some with text after the object, some without an answer."""
    d, path = table(spark, sf, "documents"), _folder(spark, "labelled")
    row = F.to_json(F.struct(F.col("doc_id").cast("string").alias("user_input"), F.when(F.col("doc_id") % 5 < 4, F.col("lang")).alias("response"), F.when(F.col("n_chars") % 2 == 0, "Right").otherwise("incorrect").alias("label")))
    line = F.when(F.col("doc_id") % 11 == 0, "  ").when(F.col("doc_id") % 5 == 3, F.concat(row, F.lit(" and more"))).otherwise(row)
    d.repartitionByRange(8, "doc_id").sortWithinPartitions("doc_id").select(line.alias("value")).write.text(path)
    return R.read_labelled(spark, path).select("trace_id", F.when(F.col("reason").isNull(), F.col("label")).alias("label"), "reason")


@query("""SELECT md5(doc_id::VARCHAR) AS trace_id, 'document ' || doc_id AS question, lang AS final_answer, CASE WHEN toxic = 1 THEN 'partial' WHEN quality = 1 THEN 'correct' ELSE 'wrong' END AS label
FROM documents JOIN labels USING (doc_id) WHERE doc_id % 7 <> 0 AND lang IS NOT NULL""")
def folder_labels(spark, sf):
    """Documents as spans and labels as annotations of traces and spans in one folder, with lines that are neither."""
    docs, said, path = table(spark, sf, "documents"), table(spark, sf, "labels"), _folder(spark, "mixed")
    trace, span = F.md5(F.col("doc_id").cast("string")), F.substring(F.md5(F.concat(F.lit("s"), F.col("doc_id").cast("string"))), 1, 16)
    text = lambda k, v: F.struct(F.lit(k).alias("key"), F.struct(v.alias("stringValue")).alias("value"))
    values = F.array(text("input.value", F.concat(F.lit("document "), F.col("doc_id").cast("string"))), text("output.value", F.col("lang")))
    one = F.struct(trace.alias("traceId"), span.alias("spanId"), F.lit("root").alias("name"), values.alias("attributes"))
    docs.where("doc_id % 7 <> 0 AND lang IS NOT NULL").select(F.to_json(F.struct(F.array(F.struct(F.array(F.struct(F.array(one).alias("spans"))).alias("scopeSpans"))).alias("resourceSpans"))).alias("value")).write.text(path)
    verdict = F.when(F.col("quality") == 1, "good").otherwise("bad").alias("label")
    whose = [F.when(F.col("doc_id") % 2 == 0, trace).alias("trace_id"), F.when(F.col("doc_id") % 2 == 1, span).alias("span_id")]
    flat = F.to_json(F.struct(F.lit("review").alias("name"), *whose, verdict, F.lit("2024-01-01").alias("created_at")))
    nested = F.to_json(F.struct(F.lit("review").alias("name"), *whose, F.struct(verdict).alias("result"), F.lit("2024-01-01").alias("created_at")))
    late = F.to_json(F.struct(F.lit("review").alias("name"), trace.alias("trace_id"), F.lit(0.5).alias("label"), F.lit("2024-02-01").alias("updated_at")))
    said.select(F.when(F.col("doc_id") % 3 == 0, nested).otherwise(flat).alias("value")).write.mode("append").text(path)
    said.where("toxic = 1").select(late.alias("value")).write.mode("append").text(path)
    said.where("doc_id % 5 = 0").select(F.to_json(F.struct(F.lit("other").alias("name"), trace.alias("trace_id"), F.lit("bad").alias("label"), F.lit("2025-01-01").alias("created_at"))).alias("value")).write.mode("append").text(path)
    docs.where("doc_id % 13 = 0").select(F.lit("{").alias("value")).write.mode("append").text(path)
    found = folders.read_folder(spark, path)
    return folders.labelled_folder(found, "review").select("trace_id", "question", "final_answer", "label")
