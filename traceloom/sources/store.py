"""A REST store of traces as a Spark source: lists whose pages follow a cursor, read as a table or as a stream.

    spark.read.format("trace_store").option("id_param", "trace_ids").load(url)

gives (id, at, value): a row of JSON each, its id and its time. Filters on id and at go into the request: ids in chunks of
100, a partition for each; times as start_time (inclusive) and end_time (exclusive). Pushing filters down needs
spark.sql.python.filterPushdown.enabled, which read_store() sets. As a stream, an offset is a cursor and the rows of its
page that are done with, so an open last page goes on where it stood.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from datetime import UTC, date, datetime
from urllib.error import HTTPError
from urllib.parse import urlencode
from urllib.request import urlopen

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "id string, at timestamp, value string"
#: Rows of a page, ids of a request.
PAGE, CHUNK = 1000, 100


class NoSuchProject(ValueError):
    """The store answers, but has no such list."""


def page(url: str, query: list[tuple[str, str]], timeout: float = 30) -> tuple[list[dict], str | None]:
    """One page: its rows, and the cursor of the next page if there is one."""
    try:
        with urlopen(f"{url}?{urlencode(query)}", timeout=timeout) as reply:
            found = json.load(reply)
    except HTTPError as e:
        if e.code == 404:
            raise NoSuchProject(f"NoSuchProject: {url} isn't there") from None
        raise
    return found.get("data", []), found.get("next_cursor") or None


def pages(url: str, query: list[tuple[str, str]], timeout: float = 30) -> Iterator[dict]:
    """The rows of all pages."""
    cursor: str | None = None
    while True:
        rows, cursor = page(url, [*query, *([("cursor", cursor)] if cursor else [])], timeout)
        yield from rows
        if not cursor:
            return


class _Settings:
    def __init__(self, options: dict):
        self.url = options["path"]
        self.id_field, self.at_field = options.get("id_field", "trace_id"), options.get("at_field", "start_time")
        self.id_param = options.get("id_param", "id")
        self.timeout, self.size = float(options.get("timeout", "30")), options.get("page_rows", str(PAGE))
        self.ids = [x for x in options.get("ids", "").split(",") if x] if "ids" in options else None
        self.pages = int(options.get("pages_per_batch", "10"))

    def row(self, found: dict) -> tuple:
        at = found.get(self.at_field)
        try:
            time = datetime.fromisoformat(at) if isinstance(at, str) else None
        except ValueError:
            time = None
        return None if found.get(self.id_field) is None else str(found[self.id_field]), time, json.dumps(found, ensure_ascii=False)


class _Query(InputPartition):
    def __init__(self, query: list[tuple[str, str]], skip: int = 0, until: int | None = None):
        super().__init__(query)
        self.skip, self.until = skip, until


class StoreReader(DataSourceReader):
    def __init__(self, settings: _Settings):
        self.settings, self.ids, self.times = settings, settings.ids, {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Ids and times go into the request; what the store answers more coarsely than asked is left to Spark as well."""
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            wanted = [f.value] if isinstance(f, EqualTo) else list(f.value) if isinstance(f, In) else None
            if column == "id" and wanted is not None:
                held = set(map(str, wanted))
                self.ids = sorted(held if self.ids is None else held & set(self.ids))
            elif column == "at" and isinstance(f, GreaterThan | GreaterThanOrEqual):
                self._narrow("start_time", f.value, max)
                yield from [f] if isinstance(f, GreaterThan) else []
            elif column == "at" and isinstance(f, LessThan):
                self._narrow("end_time", f.value, min)
            else:
                yield f  # LessThanOrEqual too: the store's end isn't part of what it gives

    def _narrow(self, name: str, value: datetime | date, choose) -> None:
        self.times[name] = choose(self.times[name], value) if name in self.times else value

    def partitions(self) -> list[_Query]:
        text = lambda t: (t if t.tzinfo else t.astimezone()).astimezone(UTC).isoformat()
        base = [("limit", self.settings.size), *((k, text(t)) for k, t in sorted(self.times.items()))]
        if self.ids is None:
            return [_Query(base)]
        return [_Query([*base, *((self.settings.id_param, x) for x in self.ids[i : i + CHUNK])]) for i in range(0, len(self.ids), CHUNK)]

    def read(self, partition: _Query | None) -> Iterator[tuple]:
        if partition is None:  # no ids, no partitions: Spark asks once all the same
            return
        yield from map(self.settings.row, pages(self.settings.url, partition.value, self.settings.timeout))


class StoreStream(DataSourceStreamReader):
    """Each page is a partition of a batch; the driver follows cursors, pages_per_batch at most, and keeps no rows."""

    def __init__(self, settings: _Settings):
        self.settings, self.at = settings, {"cursor": "", "skip": 0}

    def initialOffset(self) -> dict:
        return {"cursor": "", "skip": 0}

    def _steps(self, offset: dict) -> Iterator[tuple[dict, dict, int]]:
        """(from, to, rows of the page), a page a step, until the store has no more."""
        while True:
            rows, following = page(self.settings.url, self._query(offset["cursor"]), self.settings.timeout)
            to = {"cursor": following, "skip": 0} if following else {"cursor": offset["cursor"], "skip": max(len(rows), offset["skip"])}
            if to == offset:
                return
            yield offset, to, len(rows)
            if not following:
                return
            offset = to

    def _query(self, cursor: str) -> list[tuple[str, str]]:
        return [("limit", self.settings.size), *([("cursor", cursor)] if cursor else [])]

    def latestOffset(self) -> dict:
        for n, (_, to, _) in enumerate(self._steps(self.at), 1):
            self.at = to
            if n >= self.settings.pages:
                break
        return self.at

    def partitions(self, start: dict, end: dict) -> list[_Query]:
        """The pages between two offsets, found again from the first: a restart has nothing but the offsets."""
        self.at = max(self.at, end, key=lambda x: x == end)
        out = []
        if start == end:
            return out
        for since, to, n in self._steps(start):
            last = since["cursor"] == end["cursor"] and end["skip"]
            out.append(_Query(self._query(since["cursor"]), since["skip"], end["skip"] if last else n))
            if last or to == end:
                break
        return out

    def read(self, partition: _Query | None) -> Iterator[tuple]:
        if partition is None:
            return
        rows, _ = page(self.settings.url, partition.value, self.settings.timeout)
        yield from map(self.settings.row, rows[partition.skip : partition.until])


class TraceStore(DataSource):
    """Options: path, ids, id_param, id_field, at_field, page_rows, timeout, pages_per_batch."""

    @classmethod
    def name(cls) -> str:
        return "trace_store"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return StoreReader(_Settings(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return StoreStream(_Settings(self.options))


def _source(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TraceStore)


def read_store(spark: SparkSession, url: str, ids: list[str] | None = None, **options: str) -> DataFrame:
    """(id, at, value) of a store's list, of all rows or those of ids (none: no rows). A list that isn't there is NoSuchProject, at once."""
    _source(spark)
    page(url, [("limit", "1")], float(options.get("timeout", "30")))
    reader = spark.read.format("trace_store").options(**options)
    return (reader if ids is None else reader.option("ids", ",".join(ids))).load(url)


def stream_store(spark: SparkSession, url: str, **options: str) -> DataFrame:
    """read_store() as a stream, for lists that rows are only added to, at their end."""
    _source(spark)
    page(url, [("limit", "1")], float(options.get("timeout", "30")))
    return spark.readStream.format("trace_store").options(**options).load(url)


def rows_of(ids: DataFrame, url: str, param: str, more: list[tuple[str, str]] | None = None, timeout: float = 30) -> DataFrame:
    """(value): the list's rows for a column of ids, asked for 100 at a time where they are. Each distinct id is asked for once."""

    def ask(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in found:
            wanted = part["id"].tolist()
            for i in range(0, len(wanted), CHUNK):
                query = [("limit", str(PAGE)), *(more or []), *((param, x) for x in wanted[i : i + CHUNK])]
                yield pd.DataFrame({"value": [json.dumps(x, ensure_ascii=False) for x in pages(url, query, timeout)]}, dtype="object")

    column = ids.columns[0]
    return ids.select(F.col(column).cast("string").alias("id")).where("id IS NOT NULL").distinct().mapInPandas(ask, "value string")


def labelled_store(spark: SparkSession, base: str, name: str, **assembling: str) -> DataFrame:
    """Traces of a project (base: its URL) with the verdicts of the annotations `name` on their spans and on themselves."""
    from ..operators.labels import all_annotations, latest_verdicts
    from ..operators.traces import assemble
    from .folders import annotations_of
    from .traces import otlp_spans

    numbered = lambda df: df.withColumn("line_id", F.monotonically_increasing_id())
    wrapped = F.concat(F.lit('{"resourceSpans":[{"scopeSpans":[{"spans":['), F.col("value"), F.lit("]}]}]}"))
    spans = otlp_spans(numbered(read_store(spark, f"{base}/spans/otlpv1").select(wrapped.alias("value"))))
    wanted = [("include_annotation_names", name)]
    of_spans = annotations_of(numbered(rows_of(spans.select("span_id"), f"{base}/span_annotations", "span_ids", wanted)))
    of_traces = annotations_of(numbered(rows_of(spans.select("trace_id"), f"{base}/trace_annotations", "trace_ids", wanted)))
    verdicts = latest_verdicts(all_annotations(of_spans, of_traces), name, spans.select("trace_id", "span_id"))
    return assemble(spans, **assembling).where("reason IS NULL").join(verdicts.withColumnRenamed("verdict", "label"), "trace_id")
