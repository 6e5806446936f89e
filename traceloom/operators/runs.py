"""Agent runs: calls written as text, the budget of calls, records of calls, outcomes, and reports on finished runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

#: Tools of a run, calls a run may make, shown characters of a result.
TOOLS = ("search", "lookup")
MOST_CALLS, PREVIEW_CHARS = 8, 300


#: What may stand around a call that is written out.
_OPENED, _CLOSED = ("<tool_call>", "```json", "```"), ("</tool_call>", "```")


def _spaced(text: Column) -> Column:
    """Marks and words of a text, one space between them."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(</?tool_call>|```(?:json)?|[:()])", " $1 "), r"\s+", " "))


def text_call(reply: Column, tools: tuple[str, ...] = TOOLS) -> Column:
    """struct(name, args_json) of a reply that is one call written out as text and nothing else, null for every other reply.

    The arguments reach from the first curly bracket to the last and must be one JSON object. What stands before them is
    looked up among the ways to name a tool: in call tags, a code fence or neither, then the name, then a round bracket, a
    colon or nothing; what stands after them, among the ways to end that.
    """
    first, last = F.instr(reply, "{"), F.length(reply) - F.instr(F.reverse(reply), "}") + 1
    args = F.substring(reply, first, last - first + 1)
    names = {" ".join(filter(None, (opened, tool, mark))): tool for opened in ("", *_OPENED) for tool in tools for mark in ("", ":", "(")}
    ends = [" ".join(filter(None, (mark, closed))) for mark in ("", ")") for closed in ("", *_CLOSED)]
    name = F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), _spaced(F.substring(reply, F.lit(1), first - 1)))
    ended = _spaced(F.substring(reply, last + 1, F.length(reply))).isin(ends)
    return F.when((first > 0) & ended & name.isNotNull() & S.is_json_object(args), F.struct(name.alias("name"), args.alias("args_json")))


def budgeted(calls: DataFrame, run: str, at: str, most: int = MOST_CALLS) -> DataFrame:
    """Adds call_no, from 1, and exhausted: calls of a run beyond its budget. A run's calls are bounded by its steps."""
    return calls.withColumn("call_no", F.row_number().over(Window.partitionBy(run).orderBy(at))).withColumn("exhausted", F.col("call_no") > most)


def with_records(calls: DataFrame, records: DataFrame, run: str = "run_id", at: str = "at") -> DataFrame:
    """calls (run, at, call_id, name) with the status and result_preview of their records (run, at, call_id, name, status, result).

    The n-th call of a run with one call_id and name takes the n-th such record; a null call_id is one of its own. A call
    without a record was refused before a tool ran: bad_args and an empty preview.
    """
    key = Window.partitionBy(run, "call_id", "name").orderBy(at)
    left = calls.withColumn("_n", F.row_number().over(key))
    right = records.withColumn("_n", F.row_number().over(key)).select(*[F.col(c).alias(f"_{c}") for c in (run, "call_id", "name", "status", "result")], F.col("_n").alias("_m"))
    same = F.col(run).eqNullSafe(F.col(f"_{run}")) & F.col("call_id").eqNullSafe(F.col("_call_id")) & F.col("name").eqNullSafe(F.col("_name")) & (F.col("_n") == F.col("_m"))
    joined = left.join(right, same, "left")
    return joined.select(*calls.columns, F.coalesce("_status", F.lit("bad_args")).alias("status"), S.truncate(F.coalesce("_result", F.lit("")), PREVIEW_CHARS).alias("result_preview"))


#: Statuses of a call and what a call that gives nothing says.
OK, NOT_FOUND, BAD_ARGS, EXHAUSTED = "ok", "not_found", "bad_args", "budget_exhausted"
ARGUMENT = {"search": "query", "lookup": "title"}
BAD_ARGUMENT = {"search": "Invalid arguments: `query` must be a non-empty string of keywords.", "lookup": "Invalid arguments: `title` must be a non-empty paragraph title."}


def tool_results(calls: DataFrame, hits: DataFrame, exhausted: str, unknown: str = "unknown tool") -> DataFrame:
    """calls (run_id, at, name, args_json, exhausted, titles) with status, result and paragraphs, as the model sees them.

    hits (run_id, at, rank, title, text): what a search found, best first, or the one paragraph that a lookup did. A call
    beyond its budget says `exhausted` and nothing else; one of no tool, or whose argument isn't a text that says
    something, is bad_args; one without hits lists the titles there are. Paragraphs are shown as "[title] text", a blank
    line between them. Hits of a call, and titles of its run, are a handful.
    """
    found = hits.groupBy("run_id", "at").agg(F.array_sort(F.collect_list(F.struct("rank", "title", "text"))).alias("_hits"))
    df = calls.join(found, ["run_id", "at"], "left")
    given = F.try_parse_json("args_json")
    argument = F.coalesce(*[F.when((F.col("name") == tool) & (F.schema_of_variant(F.try_variant_get(given, f"$.{arg}", "variant")) == "STRING"), F.try_variant_get(given, f"$.{arg}", "string")) for tool, arg in ARGUMENT.items()])
    df = df.withColumn("_asked", F.trim(argument))
    none, known = F.col("_hits").isNull(), F.col("name").isin(*ARGUMENT)
    titles = F.coalesce(F.nullif(F.array_join("titles", "; "), F.lit("")), F.lit("(none)"))
    status = F.when(F.col("exhausted"), EXHAUSTED).when(~known | (F.coalesce("_asked", F.lit("")) == ""), BAD_ARGS).when(none, NOT_FOUND).otherwise(OK)
    missed = F.when(F.col("name") == "search", F.concat(F.lit("No paragraphs matched the query. Try different keywords. Available titles: "), titles)).otherwise(F.concat(F.lit("No paragraph titled '"), F.col("_asked"), F.lit("'. Available titles: "), titles))
    wrong = F.coalesce(*[F.when(F.col("name") == tool, F.lit(text)) for tool, text in BAD_ARGUMENT.items()], F.lit(unknown))
    df = df.withColumn("status", status)
    is_ = lambda x: F.col("status") == x
    shown = F.array_join(F.transform("_hits", lambda h: F.concat(F.lit("["), h["title"], F.lit("] "), h["text"])), "\n\n")
    result = F.when(is_(EXHAUSTED), exhausted).when(is_(BAD_ARGS), wrong).when(is_(NOT_FOUND), missed).otherwise(shown)
    texts = F.when(is_(OK), F.transform("_hits", lambda h: h["text"])).otherwise(F.array().cast("array<string>"))
    return df.withColumns({"result": result, "paragraphs": texts}).drop("_hits", "_asked")


def run_evidence(paragraphs: Column) -> Column:
    """Distinct texts of an array of calls' arrays of paragraphs, in the order first seen; null arrays have none."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.flatten(F.transform(F.coalesce(paragraphs, F.array(none)), lambda x: F.coalesce(x, none))))


def outcomes(runs: DataFrame) -> DataFrame:
    """Adds final_answer, stop_reason and used_search to runs (final_raw, hit_max_steps, statuses array<string> of the calls).

    No final reply, or one that is empty once cleaned, is no_answer; a run that met its limit of steps answers nothing.
    """
    limit = F.coalesce("hit_max_steps", F.lit(False))
    df = runs.withColumn("final_answer", F.when(limit | F.col("final_raw").isNull(), "").otherwise(S.cleaned_answer("final_raw")))
    stop = F.when(limit, "max_steps").when(F.col("final_answer") == "", "no_answer").otherwise("answered")
    return df.withColumn("stop_reason", stop).withColumn("used_search", F.coalesce(F.array_contains("statuses", "ok"), F.lit(False)))


def without_call(runs: DataFrame, by: str) -> DataFrame:
    """by, share of runs that used no tool, half-even to two decimals; a null used_search isn't counted."""
    return runs.groupBy(by).agg(F.bround(F.avg((~F.col("used_search")).cast("int")), 2).alias("share"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """column, n, the most frequent first."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def verbose_suspects(runs: DataFrame, answer: str = "final_answer", gold: str = "reference") -> DataFrame:
    """Runs labelled wrong whose normalised answer holds the normalised reference."""
    said, wanted = (S.normalize_answer(F.coalesce(F.col(c), F.lit(""))) for c in (answer, gold))
    return runs.where((F.col("label") == "wrong") & said.contains(wanted))


def ungraded(questions: DataFrame, model: str) -> DataFrame:
    """Questions still to grade: no label, or one given for another model."""
    return questions.where(F.col("label").isNull() | ~F.col("graded_model").eqNullSafe(F.lit(model)))


def agreement(decisions: DataFrame, truth: str = "y") -> DataFrame:
    """n and the share of decisions (keep) that agree with the truth, on the rows where both are known."""
    return decisions.where(F.col("keep").isNotNull() & F.col(truth).isNotNull()).agg(F.count("*").alias("n"), F.avg((F.col("keep") == F.col(truth)).cast("int")).alias("agreement"))
