"""Readers: labelled JSON lines, OTLP JSON lines with annotations, a paged REST store, and the choice between them."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

from ..functions import scalars as S
from ..operators.labels import label_column
from ..operators.traces import TOOL_CALLS

#: Other names of the fields.
ALIASES = {
    "question": ("question", "user_input", "input"),
    "evidence": ("evidence", "retrieved_contexts", "contexts"),
    "final_answer": ("final_answer", "response", "actual_output"),
    "reference": ("reference", "expected_output", "gold_answer", "ground_truth"),
}
PLAIN = ("label", "qid", "split", "stop_reason", "failure_type", "trace_id")


_CALL = StructType([StructField(n, StringType()) for n in ("name", "args_json", "status_json")])


@F.pandas_udf(StructType([StructField("calls", ArrayType(_CALL)), StructField("bad", BooleanType())]))
def read_calls(text):
    """Tool calls with args and status as the JSON that stands there (null: absent)."""
    from ..functions.scalars import _reject, _Written

    def show(x):
        if isinstance(x, _Written):
            return str(x)
        if isinstance(x, str):
            return json.dumps(x, ensure_ascii=False)
        if isinstance(x, dict):
            return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{show(v)}" for k, v in x.items()) + "}"
        return "[" + ",".join(map(show, x)) + "]" if isinstance(x, list) else json.dumps(x)

    def one(line):
        try:
            calls = json.loads(line, parse_float=_Written, parse_int=_Written, parse_constant=_reject).get("tool_calls") or []
        except (ValueError, AttributeError):
            return {"calls": [], "bad": False}
        if not isinstance(calls, list) or not all(isinstance(c, dict) and c.get("name") for c in calls):
            return {"calls": [], "bad": True}
        return {"calls": [{"name": str(c["name"]), "args_json": show(c["args"]) if "args" in c else None, "status_json": show(c["status"]) if "status" in c else None} for c in calls], "bad": False}

    return pd.DataFrame([one(x) for x in text], columns=["calls", "bad"])


def labelled_lines(lines: DataFrame) -> DataFrame:
    """Rows of (line_id, value) as labelled traces with `reason` where a row can't be used. Blank lines are left out."""
    rows = lines.where(F.trim("value") != "")
    names = [x for found in ALIASES.values() for x in found if x not in ("evidence", "retrieved_contexts", "contexts")]
    flat = ", ".join(f"`{n}` string" for n in (*names, *PLAIN)) + ", `used_search` boolean, " + ", ".join(f"`{n}` array<string>" for n in ALIASES["evidence"])
    rows = rows.withColumn("r", F.from_json("value", flat)).withColumn("c", read_calls("value"))
    pick = lambda field: F.coalesce(*[F.col(f"r.{n}") for n in ALIASES[field]])
    parsed = F.try_parse_json("value")
    whole = S.is_json_object(F.col("value"))  # nothing may follow the object
    kind = F.schema_of_variant(F.try_variant_get(parsed, "$.label", "variant"))  # only what is a number in JSON is a score
    scored = F.when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), S.label_of_score(F.col("r.label").try_cast("double")))
    label = F.coalesce(scored, label_column(F.when(kind == "STRING", F.col("r.label")), pick("final_answer"), pick("reference")))
    out = rows.select(
        F.coalesce("r.trace_id", F.concat(F.lit("line-"), F.col("line_id").cast("string"))).alias("trace_id"), F.lit(None).cast("string").alias("agent"), pick("question").alias("question"),
        F.col("c.calls").cast(TOOL_CALLS).alias("tool_calls"), F.coalesce(pick("evidence"), F.array().cast("array<string>")).alias("evidence"), pick("final_answer").alias("final_answer"),
        label.alias("label"), "r.qid", "r.split", "r.used_search", "r.stop_reason", "r.failure_type", F.col("c.bad").alias("_bad"), whole.alias("_json"),
    )
    reason = F.when(~F.col("_json"), "not JSON").when(F.col("question").isNull(), "missing question").when(F.col("final_answer").isNull(), "missing final_answer").when(F.col("label").isNull(), "no readable label or reference").when(F.col("_bad"), "a tool call without a name")
    return out.withColumn("reason", reason).drop("_bad", "_json")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, line_id, value) of a text file or folder, blank lines too: a line's number in its file, from 1, and in all files in order of their names.

    A file may be read in many splits. A task knows a line's place in its split; lines are counted by split, splits are
    summed within their file and files among themselves, and a split's offset meets its lines again: a row for each split.
    """
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at"), "value")
    splits = rows.groupBy("file", "_start").agg(F.count("*").alias("n"), F.min("_at").alias("_from"))
    sum_of = lambda w: F.coalesce(F.sum("n").over(w), F.lit(0))
    files = splits.groupBy("file").agg(F.sum("n").alias("n"))
    files = files.withColumn("_before", sum_of(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))).drop("n")  # a row for each file
    splits = splits.withColumn("_offset", sum_of(Window.partitionBy("file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1))).drop("n").join(files, "file")
    line = F.col("_offset") + F.col("_at") - F.col("_from") + 1
    return rows.join(splits, ["file", "_start"]).select("file", line.alias("line"), (F.col("_before") + line).alias("line_id"), "value")


def usable(rows: DataFrame, where: str) -> DataFrame:
    """Rows that can be used (reason null), without the reason; an error that counts the reasons where none can."""
    good = rows.where("reason IS NULL").drop("reason")
    if not good.head(1):
        said = ", ".join(f"{r['n']} x {r['reason']}" for r in skip_reasons(rows).limit(20).collect()) or "empty"
        raise ValueError(f"{where}: no usable traces ({said})")
    return good


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """A JSON-lines file or folder; a row without an id is called line-N by its number, see numbered_lines. usable() refuses a source without any."""
    return labelled_lines(numbered_lines(spark, path).select("line_id", "value"))


def skip_reasons(rows: DataFrame) -> DataFrame:
    return rows.where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")


_VALUE = "struct<stringValue:string,string_value:string,boolValue:boolean,bool_value:boolean,intValue:string,int_value:string,doubleValue:double,double_value:double>"
_KV = f"array<struct<key:string,value:{_VALUE}>>"
_SPAN = f"array<struct<traceId:string,trace_id:string,spanId:string,span_id:string,parentSpanId:string,parent_span_id:string,name:string,startTimeUnixNano:string,start_time_unix_nano:string,status:struct<code:string>,attributes:{_KV}>>"
_SCOPE = f"array<struct<spans:{_SPAN}>>"
_RESOURCE = f"array<struct<resource:struct<attributes:{_KV}>,scopeSpans:{_SCOPE},scope_spans:{_SCOPE}>>"
OTLP = f"resourceSpans {_RESOURCE}, resource_spans {_RESOURCE}"


def _map(pairs: Column) -> Column:
    """Attributes as a map of text; of a repeated key the first; arrays and lists read as empty."""
    firsts = F.filter(pairs, lambda kv, i: F.array_position(F.transform(pairs, lambda x: x["key"]), kv["key"]) == i + 1)

    def text(v: Column) -> Column:
        fields = ("stringValue", "string_value", "boolValue", "bool_value", "intValue", "int_value", "doubleValue", "double_value")
        return F.coalesce(*[v[f].cast("string") for f in fields], F.lit(""))

    return F.coalesce(F.map_from_entries(F.transform(firsts, lambda kv: F.struct(kv["key"].alias("key"), text(kv["value"]).alias("value")))), F.create_map().cast("map<string,string>"))


def otlp_spans(lines: DataFrame) -> DataFrame:
    """Flat spans of OTLP JSON lines (line_id, value), camelCase or snake_case.

    arrival_seq orders by line, then by place in the line: up to 10**5 resources, 10**5 scopes of each and 10**8 spans of
    each of those. It is a decimal, as line_id may take all 63 bits.
    """
    both = lambda a, b: F.coalesce(F.col(a), F.col(b))
    df = lines.withColumn("j", F.from_json("value", OTLP)).select("line_id", F.posexplode(both("j.resourceSpans", "j.resource_spans")).alias("rs_at", "rs"))
    df = df.select("line_id", "rs_at", _map(F.col("rs.resource.attributes")).alias("resource_attributes"), F.posexplode(both("rs.scopeSpans", "rs.scope_spans")).alias("ss_at", "ss"))
    df = df.select("line_id", "rs_at", "ss_at", "resource_attributes", F.posexplode("ss.spans").alias("at", "s"))
    return span_columns(df.select(
        "line_id", "rs_at", "ss_at", "at", F.lower(both("s.traceId", "s.trace_id")).alias("trace_id"), F.lower(both("s.spanId", "s.span_id")).alias("span_id"), F.nullif(F.lower(both("s.parentSpanId", "s.parent_span_id")), F.lit("")).alias("parent_span_id"),
        "s.name", F.coalesce(both("s.startTimeUnixNano", "s.start_time_unix_nano").cast("long"), F.lit(0)).alias("start_unix_nano"), F.col("s.status.code").alias("status_code"), _map(F.col("s.attributes")).alias("attributes"), "resource_attributes",
    ))


def span_columns(df: DataFrame) -> DataFrame:
    """Spans with arrival_seq for their places: line_id, then rs_at, ss_at and at within it."""
    place = F.col("rs_at").cast("long") * F.lit(10**13) + F.col("ss_at").cast("long") * F.lit(10**8) + F.col("at")
    seq = F.col("line_id").cast("decimal(19,0)") * F.lit(10**18).cast("decimal(19,0)") + place
    return df.select("trace_id", "span_id", "parent_span_id", "name", "start_unix_nano", "status_code", "attributes", "resource_attributes", seq.alias("arrival_seq"))


def read_otlp(spark: SparkSession, path: str) -> DataFrame:
    return otlp_spans(spark.read.text(path).withColumn("line_id", F.monotonically_increasing_id()))


def open_source(spark: SparkSession, uri: str, ids: list[str] | None = None) -> DataFrame:
    """By URI: a REST store, perhaps only some ids of it, else lines, which are spans if the first one is OTLP and labelled traces if not."""
    if uri.startswith(("http://", "https://")):
        from .store import read_store

        return read_store(spark, uri, ids)
    first = spark.read.text(uri).where(F.trim("value") != "").first()
    if first is None:
        raise ValueError(f"{uri}: no rows")
    return read_otlp(spark, uri) if "resourceSpans" in first[0] or "resource_spans" in first[0] else read_labelled(spark, uri)


def questions(raw: DataFrame) -> DataFrame:
    """Question rows (id, question, answer, titles, sentences, gold) with paragraphs (title, text) and distinct sorted gold_titles."""
    paragraphs = F.transform(F.arrays_zip("titles", "sentences"), lambda z: F.struct(z["titles"].alias("title"), F.array_join(z["sentences"], "").alias("text")))
    return raw.select(F.col("id").alias("qid"), "question", "answer", paragraphs.alias("paragraphs"), F.array_sort(F.array_distinct("gold")).alias("gold_titles"))


def corpus(questions_: DataFrame) -> DataFrame:
    """title, text of all paragraphs; of a title the text of the least (qid, place)."""
    each = questions_.select("qid", F.posexplode("paragraphs").alias("at", "p"))
    return each.groupBy(F.col("p.title").alias("title")).agg(F.min_by("p.text", F.struct("qid", "at")).alias("text"))


def array_corpus(spark: SparkSession, path: str) -> DataFrame:
    """title, text of a corpus that is one JSON array of paragraphs; what a paragraph lacks is empty. A file is read by one task."""
    rows = spark.read.schema("title string, text string").option("multiLine", True).json(path)
    return rows.select(F.coalesce("title", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("text"))
