"""Traces: validation, the text slice a model reads, assembly from spans, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

TOOL_CALLS = "array<struct<name:string,args_json:string,status_json:string>>"
TRACE = f"trace_id string, agent string, question string, tool_calls {TOOL_CALLS}, evidence array<string>, final_answer string"
#: Evidence that a slice shows: items, and code points of each.
EVIDENCE_ITEMS, EVIDENCE_CHARS = 3, 1500
AGENT_BYTES = 128


def problems(df: DataFrame) -> DataFrame:
    """Adds `problems`, what keeps a trace from being scored; empty if nothing does."""
    found = F.array(
        F.when(F.trim(F.coalesce("question", F.lit(""))) == "", F.lit("question is empty")),
        F.when(F.octet_length("agent") > AGENT_BYTES, F.lit("agent is too long")),
        F.when(F.exists(F.coalesce("tool_calls", F.array().cast(TOOL_CALLS)), lambda c: F.coalesce(c["name"], F.lit("")) == ""), F.lit("a tool call without a name")),
        F.when(F.col("final_answer").isNull(), F.lit("final_answer is missing")),
    )
    return df.withColumn("problems", F.array_compact(found))


def numbered(items: Column, text) -> Column:
    none = F.size(F.coalesce(items, F.array())) == 0
    return F.when(none, F.lit("(none)")).otherwise(F.array_join(F.transform(items, text), "\n"))


def build_state(df: DataFrame) -> DataFrame:
    """Adds `state`: question, numbered tool calls, the first pieces of evidence, answer. Calls are shown as rendered() has them."""
    if "rendered_calls" not in df.columns:
        return build_state(rendered(df)).drop("rendered_calls")
    call = lambda c, i: F.concat((i + 1).cast("string"), F.lit(". "), F.coalesce(c["name"], F.lit("")), F.lit("("), F.coalesce(c["args"], F.lit("")), F.lit(") -> "), c["status"])
    item = lambda e, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), S.truncate(e, EVIDENCE_CHARS))
    calls = F.col("rendered_calls")
    return df.withColumn("state", F.concat(
        F.lit("USER QUESTION:\n"), "question", F.lit("\n\nTOOL CALLS:\n"), numbered(calls, call),
        F.lit("\n\nEVIDENCE:\n"), numbered(F.slice("evidence", 1, EVIDENCE_ITEMS), item), F.lit("\n\nFINAL ANSWER:\n"), "final_answer",
    ))


def rendered(df: DataFrame) -> DataFrame:
    """Adds rendered_calls, (name, args, status) with args and statuses as the slice shows them, in one pass of Python over the JSON."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("array<struct<name:string,args:string,status:string>>")
    def render(calls):
        import json

        def status(text):
            if text is None:
                return "ok"
            made = S.compact(text)
            return json.loads(made) if made.startswith('"') else made

        return calls.map(lambda x: None if x is None else [{"name": c["name"], "args": S.compact(c["args_json"]), "status": status(c["status_json"])} for c in x])

    return df.withColumn("rendered_calls", render("tool_calls"))


def valid_spans(spans: DataFrame) -> DataFrame:
    """Spans whose ids are 16 and 8 bytes in hex, not all zero."""
    return spans.where(F.col("trace_id").rlike("^[0-9a-f]{32}$") & ~F.col("trace_id").rlike("^0+$") & F.col("span_id").rlike("^[0-9a-f]{16}$") & ~F.col("span_id").rlike("^0+$"))


def first_of_each_span(spans: DataFrame) -> DataFrame:
    """Re-sent spans once: of (trace_id, span_id) the first to arrive."""
    rest = [c for c in spans.columns if c not in ("trace_id", "span_id")]
    kept = spans.groupBy("trace_id", "span_id").agg(F.min_by(F.struct(*rest), "arrival_seq").alias("s"))
    return kept.select("trace_id", "span_id", "s.*")


def last_of_each_span(spans: DataFrame) -> DataFrame:
    """Re-sent spans once, as they were last sent, at the place of their first arrival. Spans without an id are left out."""
    rest = [c for c in spans.columns if c not in ("trace_id", "span_id", "arrival_seq")]
    known = spans.where("trace_id <> '' AND span_id <> ''")
    kept = known.groupBy("trace_id", "span_id").agg(F.max_by(F.struct(*rest), "arrival_seq").alias("s"), F.min("arrival_seq").alias("arrival_seq"))
    return kept.select("trace_id", "span_id", "s.*", "arrival_seq")


def _attr(key: str) -> Column:
    return F.try_element_at("attributes", F.lit(key))


def roots(spans: DataFrame) -> DataFrame:
    """Of each trace one root: no parent in the trace; an agent before a chain before others, then by start, then by arrival."""
    ids = spans.select("trace_id", F.col("span_id").alias("parent_span_id"))
    tops = spans.join(ids, ["trace_id", "parent_span_id"], "left_anti")
    kind = F.coalesce(_attr("openinference.span.kind"), F.lit(""))
    rank = F.when(kind == "AGENT", 0).when(kind == "CHAIN", 1).otherwise(2)
    order = Window.partitionBy("trace_id").orderBy(rank, "start_unix_nano", "arrival_seq")
    return tops.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def _by_start(a: Column, b: Column) -> Column:
    later = lambda k: F.when(a[k] < b[k], -1).when(a[k] > b[k], 1)
    return F.coalesce(later("start_unix_nano"), later("arrival_seq"), F.lit(0))


def assemble(spans: DataFrame, agent_keys: tuple[str, ...] = ("agent.name", "service.name"), evidence_prefix: str = "trace.evidence.", status_key: str = "trace.tool.status") -> DataFrame:
    """Traces of spans (trace_id, span_id, parent_span_id, name, start_unix_nano, status_code, attributes, resource_attributes,
    arrival_seq), and `reason` why one can't be scored. One shuffle by trace_id gathers what a trace has; a trace's spans are bounded by its collector.

    Blank answers are empty; tools and documents come in order of start; evidence is what the root names, else documents of
    retrievers, else paragraphs of what tools that ended well gave, each trimmed and once.
    """
    spans = first_of_each_span(valid_spans(spans))
    root = roots(spans).select("trace_id", F.struct("name", "attributes", "resource_attributes").alias("root"))
    kind = F.coalesce(_attr("openinference.span.kind"), F.lit(""))
    status = F.coalesce(_attr(status_key), F.when(F.col("status_code").isin("STATUS_CODE_ERROR", "2"), "error").otherwise("ok"))
    output = S.message_udf(S.OUTPUT_KEYS)(F.coalesce(_attr("output.value"), F.lit("")))
    given, declared = F.coalesce(_attr("input.value"), F.lit("")), F.coalesce(_attr("tool.parameters"), F.lit(""))
    is_json = lambda x: (x != "") & F.try_parse_json(x).isNotNull()
    args = F.when(is_json(given), given).when(is_json(declared), declared).when(given != "", F.to_json(F.struct(given.alias("x"))).substr(F.lit(6), F.length(F.to_json(F.struct(given.alias("x")))) - 6))
    seen = F.struct("start_unix_nano", "arrival_seq", F.coalesce(F.nullif(_attr("tool.name"), F.lit("")), "name").alias("name"), args.alias("args_json"), status.alias("status"), F.when((kind == "TOOL") & (status == "ok"), output).alias("output"), kind.alias("kind"), F.col("attributes"))
    parts = spans.where(kind.isin("TOOL", "RETRIEVER")).groupBy("trace_id").agg(F.array_sort(F.collect_list(seen), _by_start).alias("parts"))
    df = root.join(parts, "trace_id", "left").withColumn("parts", F.coalesce("parts", F.expr(f"cast(array() as array<struct<start_unix_nano:bigint,arrival_seq:{spans.schema['arrival_seq'].dataType.simpleString()},name:string,args_json:string,status:string,output:string,kind:string,attributes:map<string,string>>>)")))

    def indexed(attributes: Column, prefix: str, suffix: str = "") -> Column:
        """Attributes prefix + 0, 1, ... + suffix until one is missing."""
        places = F.sequence(F.lit(0), F.size(attributes))
        values = F.transform(places, lambda i: F.try_element_at(attributes, F.concat(F.lit(prefix), i.cast("string"), F.lit(suffix))))
        gap = F.array_min(F.filter(places, lambda i: F.get(values, i).isNull()))
        return F.slice(values, F.lit(1), gap)

    clean = lambda xs: F.filter(F.array_distinct(F.transform(xs, lambda x: F.trim(x))), lambda x: x != "")
    named = indexed(F.col("root.attributes"), evidence_prefix)
    documents = clean(F.flatten(F.transform(F.filter("parts", lambda p: p["kind"] == "RETRIEVER"), lambda p: indexed(p["attributes"], "retrieval.documents.", ".document.content"))))
    paragraphs = clean(F.flatten(F.transform(F.filter("parts", lambda p: p["output"].isNotNull()), lambda p: F.split(p["output"], "\n\n"))))
    question = S.message_udf(S.QUESTION_KEYS)(F.coalesce(F.try_element_at("root.attributes", F.lit("input.value")), F.lit("")))
    raw = F.try_element_at("root.attributes", F.lit("output.value"))
    answer = S.message_udf(S.ANSWER_KEYS)(F.coalesce(raw, F.lit("")))
    agents = [F.nullif(F.try_element_at(m, F.lit(k)), F.lit("")) for k in agent_keys for m in ("root.attributes", "root.resource_attributes")]
    calls = F.transform(F.filter("parts", lambda p: p["kind"] == "TOOL"), lambda p: F.struct(p["name"].alias("name"), p["args_json"].alias("args_json"), F.concat(F.lit('"'), p["status"], F.lit('"')).alias("status_json")))
    df = df.withColumns({"named": named, "documents": documents, "paragraphs": paragraphs, "answer": answer, "question": question})
    evidence = F.when(F.size("named") > 0, F.col("named")).when(F.size("documents") > 0, F.col("documents")).otherwise(F.col("paragraphs"))
    reason = F.when(F.trim("question") == "", "no question").when(raw.isNull(), "no answer")
    return df.select("trace_id", S.cut_bytes(F.coalesce(*agents)).alias("agent"), "question", calls.alias("tool_calls"), evidence.alias("evidence"), F.when(F.trim("answer") == "", "").otherwise(F.col("answer")).alias("final_answer"), reason.alias("reason"))


def to_spans(traces: DataFrame, evidence_prefix: str = "trace.evidence.", status_key: str = "trace.tool.status") -> DataFrame:
    """Spans rebuilt from traces: an agent span and a child for each tool call."""
    root_id = F.substring(F.sha2(F.concat("trace_id", F.lit(":root")), 256), 1, 16)
    shown = F.map_from_entries(F.transform("evidence", lambda e, i: F.struct(F.concat(F.lit(evidence_prefix), i.cast("string")).alias("key"), e.alias("value"))))
    base = F.create_map(F.lit("openinference.span.kind"), F.lit("AGENT"), F.lit("input.value"), F.col("question"), F.lit("output.value"), F.col("final_answer"))
    root = F.struct(root_id.alias("span_id"), F.lit(None).cast("string").alias("parent_span_id"), F.lit("agent").alias("name"), F.map_concat(base, F.coalesce(shown, F.create_map().cast("map<string,string>"))).alias("attributes"))

    def tool(c: Column, i: Column) -> Column:
        attributes = F.create_map(F.lit("openinference.span.kind"), F.lit("TOOL"), F.lit("tool.name"), c["name"], F.lit("input.value"), c["args_json"], F.lit(status_key), F.coalesce(F.regexp_replace(c["status_json"], '^"|"$', ""), F.lit("ok")))
        return F.struct(F.substring(F.sha2(F.concat(F.col("trace_id"), F.lit(":"), i.cast("string")), 256), 1, 16).alias("span_id"), root_id.alias("parent_span_id"), c["name"].alias("name"), F.map_filter(attributes, lambda _, v: v.isNotNull()).alias("attributes"))

    every = F.concat(F.array(root), F.transform(F.coalesce("tool_calls", F.array().cast(TOOL_CALLS)), tool))
    return traces.select("trace_id", F.posexplode(every).alias("arrival_seq", "s")).select("trace_id", "s.*", F.col("arrival_seq").cast("long"), F.col("arrival_seq").cast("long").alias("start_unix_nano"))


def with_decision(spans: DataFrame, decisions: DataFrame) -> DataFrame:
    """Original spans forwarded with eval.* attributes on the root."""
    marks = F.map_filter(F.create_map(F.lit("eval.decision"), F.when(F.col("keep"), "keep").otherwise("drop"), F.lit("eval.reason"), F.col("reason"), F.lit("eval.severity"), F.col("severity"), F.lit("eval.p_keep"), F.col("p_keep").cast("string")), lambda _, v: v.isNotNull())
    root = roots(spans).select("trace_id", F.col("span_id").alias("root_id"))
    joined = spans.join(root, "trace_id").join(decisions.select("trace_id", marks.alias("marks")), "trace_id")
    old = F.map_filter("attributes", lambda k, _: ~F.map_contains_key(F.col("marks"), k))
    return joined.withColumn("attributes", F.when(F.col("span_id") == F.col("root_id"), F.map_concat(old, F.col("marks"))).otherwise(F.col("attributes"))).drop("marks", "root_id")
