"""Intake of requests that a collector landed as rows: what a receiver would answer, and the traces and spans of those accepted.

Spark hosts no HTTP. Landed requests have request_id, path, content_type, content_encoding and body (binary), from files
or a stream; every function here is a row-by-row projection, so the same code runs on both.
"""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..functions.scalars import is_json_object

#: Paths, and the bytes that a body may have once it is unpacked.
API_PATH, SYNC_PATH, SPANS_PATH = "/v1/traces", "/v1/traces:score", "/otlp/v1/traces"
MOST_BYTES = {API_PATH: 8 << 20, SYNC_PATH: 8 << 20, SPANS_PATH: 16 << 20}


@F.pandas_udf(BinaryType())
def unpacked(bodies: pd.Series, most: pd.Series) -> pd.Series:
    """A gzip body, all its members, at most a byte more than `most` of it; null if it is damaged or cut short."""

    def one(body: bytes, limit: int) -> bytes | None:
        out, rest = b"", body
        while rest or not out:
            reader = zlib.decompressobj(31)
            try:
                out += reader.decompress(rest, limit + 1 - len(out))
            except zlib.error:
                return None
            if len(out) > limit:
                return out
            if not reader.eof:
                return None
            if not reader.unused_data:
                break
            rest = reader.unused_data
        return out

    return pd.Series([None if b is None else one(bytes(b), int(m)) for b, m in zip(bodies, most, strict=True)], dtype=object)


def received(requests: DataFrame) -> DataFrame:
    """requests with http_status, reason (null when accepted) and value, the body's text.

    404 for other paths, 413 for a body beyond its path's limit, packed or not, 415 for what isn't JSON by its type or is
    packed in another way than gzip, 400 for a damaged body, one that isn't UTF-8 or isn't a JSON object. Accepted: 202 for
    traces that are queued, 200 otherwise.
    """
    limit = F.coalesce(*[F.when(F.col("path") == p, F.lit(n)) for p, n in MOST_BYTES.items()])
    kind = F.lower(F.trim(F.split_part(F.coalesce("content_type", F.lit("")), F.lit(";"), F.lit(1))))
    packing = F.lower(F.trim(F.coalesce("content_encoding", F.lit(""))))
    df = requests.withColumns({"_limit": limit, "_kind": kind, "_packing": packing})
    packed = F.when((F.col("_packing") == "gzip") & (F.octet_length("body") <= F.col("_limit")), F.col("body"))
    df = df.withColumn("_plain", F.when(F.col("_packing") == "gzip", unpacked(packed, F.coalesce("_limit", F.lit(0)))).otherwise(F.col("body")))
    df = df.withColumn("value", F.expr("try_validate_utf8(cast(_plain AS string))"))
    status = (
        F.when(F.col("_limit").isNull(), 404)
        .when((F.octet_length("body") > F.col("_limit")) | (F.octet_length("_plain") > F.col("_limit")), 413)
        .when((F.col("_kind") != "application/json") | ~F.col("_packing").isin("", "identity", "gzip"), 415)
        .when(~is_json_object(F.col("value")), 400).when(F.col("path") == API_PATH, 202).otherwise(200)
    )
    df = df.withColumn("http_status", status)
    says = {404: "no such path", 413: "body too large", 415: "unsupported type or packing", 400: "not a JSON object"}
    reason = F.coalesce(*[F.when(F.col("http_status") == s, F.lit(t)) for s, t in says.items()])
    return df.withColumn("reason", reason).withColumn("value", F.when(F.col("reason").isNull(), F.col("value"))).drop("_limit", "_kind", "_packing", "_plain")


def api_traces(requests: DataFrame) -> DataFrame:
    """Traces of the accepted requests of the JSON API, with request_id and `problems`; original spans in a body are ignored."""
    from ..operators.traces import TOOL_CALLS, problems
    from .traces import read_calls

    rows = requests.where(F.col("reason").isNull() & F.col("path").isin(API_PATH, SYNC_PATH))
    rows = rows.withColumn("r", F.from_json("value", "trace_id string, agent string, question string, evidence array<string>, final_answer string")).withColumn("c", read_calls("value"))
    made = F.substring(F.sha2(F.concat_ws(":", F.lit("request"), F.col("request_id").cast("string")), 256), 1, 32)
    return problems(rows.select("request_id", F.coalesce(F.nullif("r.trace_id", F.lit("")), made).alias("trace_id"), "r.agent", "r.question", F.col("c.calls").cast(TOOL_CALLS).alias("tool_calls"), F.coalesce("r.evidence", F.array().cast("array<string>")).alias("evidence"), "r.final_answer"))


def request_spans(requests: DataFrame) -> DataFrame:
    """Flat spans of the accepted span requests; request_id (a long) gives the order of arrival."""
    from .traces import otlp_spans

    return otlp_spans(requests.where(F.col("reason").isNull() & (F.col("path") == SPANS_PATH)).select(F.col("request_id").cast("long").alias("line_id"), "value"))


def score_now(requests: DataFrame, models: DataFrame, **engine) -> DataFrame:
    """What the callers of the synchronous path see: request_id with a decision, for each trace without problems."""
    from ..operators.policy import api_result, run_engine

    asked = api_traces(requests.where(F.col("path") == SYNC_PATH)).where(F.size("problems") == 0).drop("problems")
    ids = asked.select("trace_id", "request_id").dropDuplicates(["request_id"])
    return api_result(run_engine(asked.drop("request_id").dropDuplicates(["trace_id"]), models, **engine)).join(ids, "trace_id")
