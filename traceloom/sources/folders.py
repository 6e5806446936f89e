"""A folder of mixed files, read once: spans, annotations and labelled traces told apart by what a line holds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.labels import latest_verdicts
from ..operators.traces import assemble
from .traces import ALIASES, labelled_lines, numbered_lines, otlp_spans

#: Fields of an annotation; label and score may stand under `result`.
ANNOTATION = "name string, trace_id string, span_id string, label string, score double, created_at string, updated_at string, result struct<label:string,score:double>"
SHOWN = 200


@dataclass(frozen=True)
class Folder:
    """What a folder holds. rejects: file, line, reason, shown (the line's first characters)."""

    spans: DataFrame
    annotations: DataFrame
    traces: DataFrame
    rejects: DataFrame


def annotations_of(lines: DataFrame) -> DataFrame:
    """Annotations from (line_id, value), in the shape of latest_verdicts(): a number as label is a score; file order breaks ties."""
    a = lines.select("line_id", F.from_json("value", ANNOTATION).alias("a"), F.try_parse_json("value").alias("v"))
    nested = F.col("a.result").isNotNull()
    kind = F.schema_of_variant(F.when(nested, F.try_variant_get("v", "$.result.label", "variant")).otherwise(F.try_variant_get("v", "$.label", "variant")))
    label = F.when(nested, F.col("a.result.label")).otherwise(F.col("a.label"))
    score = F.when(nested, F.col("a.result.score")).otherwise(F.col("a.score"))
    number = kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    return a.select("a.name", "a.trace_id", "a.span_id", F.when(kind == "STRING", label).alias("label"), F.when(number, label.try_cast("double")).otherwise(score).alias("score"), "a.created_at", "a.updated_at", F.col("line_id").alias("seq"))


def read_folder(spark: SparkSession, path: str) -> Folder:
    """Every line of every file is one JSON object: an export request, an annotation (a name, and a trace_id or span_id), or a labelled trace.

    Blank lines are nothing; a line that is none of these, or an annotation that says nothing readable, is rejected with
    its file and number. Files of one kind may be split, and kinds may share a file.
    """
    lines = numbered_lines(spark, path).where(F.trim("value") != "")
    keys = F.coalesce(F.json_object_keys("value"), F.array().cast("array<string>"))
    has = lambda *names: F.arrays_overlap(keys, F.array(*map(F.lit, names)))
    kind = (
        F.when(~S.is_json_object(F.col("value")), "not a JSON object").when(has("resourceSpans", "resource_spans"), "spans")
        .when(has(*ALIASES["question"]), "trace").when(has("name") & has("trace_id", "span_id"), "annotation").otherwise("neither spans nor an annotation nor a trace")
    )
    lines = lines.withColumn("kind", kind)
    of = lambda name: lines.where(F.col("kind") == name)
    said = annotations_of(of("annotation"))
    verdict = F.coalesce(S.normalize_label(F.col("label")), S.label_of_score(F.col("score")))
    traces = labelled_lines(of("trace").select("line_id", "value"))
    shown = F.substring("value", 1, SHOWN).alias("shown")
    mute = of("annotation").join(said.where(verdict.isNull()).select(F.col("seq").alias("line_id")), "line_id", "left_semi").select("file", "line", F.lit("an annotation without a readable label or score").alias("reason"), shown)
    other = lines.where(~F.col("kind").isin("spans", "trace", "annotation")).select("file", "line", F.col("kind").alias("reason"), shown)
    return Folder(otlp_spans(of("spans").select("line_id", "value")), said, traces, other.unionByName(mute))


def labelled_folder(folder: Folder, name: str, **assembling: str) -> DataFrame:
    """Traces of the folder's spans with the verdict of the latest annotation `name` on them or their spans, as `label`.

    Traces without one are left out, and those that can't be scored (reason); labelled lines aren't among them.
    """
    spans = folder.spans.select("trace_id", "span_id")
    verdicts = latest_verdicts(folder.annotations, name, spans)
    return assemble(folder.spans, **assembling).where("reason IS NULL").join(verdicts.withColumnRenamed("verdict", "label"), "trace_id")
