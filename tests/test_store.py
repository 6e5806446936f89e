"""The REST store against a server of this test: pages, pushed filters, missing projects, streams that go on."""

import json
import threading
from datetime import datetime
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from traceloom.sources import store
from traceloom.sources.traces import open_source


@pytest.fixture
def server():
    lists, asked = {}, []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            at = urlparse(self.path)
            q = parse_qs(at.query)
            asked.append((at.path, q))
            if at.path not in lists:
                self.send_error(404)
                return
            rows = lists[at.path]
            for param, field in (("id", "trace_id"), ("trace_ids", "trace_id"), ("span_ids", "span_id")):
                if param in q:
                    rows = [r for r in rows if r.get(field) in q[param]]
            if "include_annotation_names" in q:
                rows = [r for r in rows if r.get("name") in q["include_annotation_names"]]
            if "start_time" in q:
                rows = [r for r in rows if datetime.fromisoformat(r["start_time"]) >= datetime.fromisoformat(q["start_time"][0])]
            if "end_time" in q:
                rows = [r for r in rows if datetime.fromisoformat(r["start_time"]) < datetime.fromisoformat(q["end_time"][0])]
            n, first = int(q["limit"][0]), int(q.get("cursor", ["0"])[0])
            body = json.dumps({"data": rows[first : first + n], "next_cursor": str(first + n) if first + n < len(rows) else None}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    made = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=made.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{made.server_port}", lists, asked
    made.shutdown()


def items(n, first=0):
    return [{"trace_id": f"t{i}", "start_time": f"2024-01-{1 + i % 28:02d}T00:00:00+00:00", "n": i} for i in range(first, first + n)]


def numbers(df):
    return sorted(json.loads(r["value"])["n"] for r in df.collect())


def test_all_pages(spark, server):
    url, lists, _ = server
    lists["/a"] = items(25)
    assert numbers(store.read_store(spark, f"{url}/a", page_rows="10")) == list(range(25))
    assert numbers(open_source(spark, f"{url}/a", ids=["t3", "t7", "none"])) == [3, 7]
    assert numbers(open_source(spark, f"{url}/a", ids=[])) == []


def test_filters_go_into_the_request(spark, server):
    url, lists, asked = server
    lists["/a"] = items(300)
    rows = store.read_store(spark, f"{url}/a")
    asked.clear()
    assert numbers(rows.where(F.col("id").isin([f"t{i}" for i in range(150)]))) == list(range(150))
    assert sorted(len(q["id"]) for _, q in asked) == [50, 100]
    asked.clear()
    low, high = F.lit("2024-01-03T00:00:00Z").cast("timestamp"), F.lit("2024-01-05T00:00:00Z").cast("timestamp")
    assert numbers(rows.where((F.col("at") >= low) & (F.col("at") < high) & (F.col("id") != "t2"))) == [i for i in range(300) if i % 28 in (2, 3) and i != 2]
    assert {(q["start_time"][0], q["end_time"][0]) for _, q in asked} == {("2024-01-03T00:00:00+00:00", "2024-01-05T00:00:00+00:00")}
    assert numbers(rows.where((F.col("at") > low) & (F.col("at") <= high))) == [i for i in range(300) if i % 28 in (3, 4)]
    assert numbers(rows.where((F.col("id") == "t5") & (F.col("id") == "t6"))) == []


def test_a_missing_project_is_named(spark, server):
    url, _, _ = server
    with pytest.raises(store.NoSuchProject, match="/gone"):
        open_source(spark, f"{url}/gone")


def test_rows_of_a_column_of_ids(spark, server):
    url, lists, asked = server
    lists["/a"] = items(500)
    ids = spark.range(450).select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("x")).unionByName(spark.createDataFrame([("t1",), (None,)], "x string")).coalesce(1)
    assert numbers(store.rows_of(ids, f"{url}/a", "trace_ids")) == list(range(450))
    assert max(len(q["trace_ids"]) for _, q in asked) <= 100


def test_labelled_project(spark, server):
    url, lists, _ = server
    traces, spans = [c * 32 for c in "123"], [c * 16 for c in "123"]
    value = lambda k, v: {"key": k, "value": {"string_value": v}}
    lists["/p/spans/otlpv1"] = [{"trace_id": t, "span_id": s, "name": "root", "attributes": [value("input.value", f"q{s[0]}"), value("output.value", "a")]} for t, s in zip(traces, spans, strict=True)]
    lists["/p/span_annotations"] = [{"name": "review", "span_id": spans[0], "result": {"label": "correct"}, "created_at": "1"}, {"name": "other", "span_id": spans[1], "result": {"label": "correct"}}]
    lists["/p/trace_annotations"] = [{"name": "review", "trace_id": traces[1], "result": {"score": 0.1}, "created_at": "1"}, {"name": "review", "trace_id": traces[0], "result": {"label": "wrong"}, "created_at": "1"}]
    out = store.labelled_store(spark, f"{url}/p", "review")
    assert sorted((r["question"], r["label"]) for r in out.collect()) == [("q1", "wrong"), ("q2", "wrong")]  # of a tie the trace's own


def test_a_stream_follows_cursors_and_goes_on_after_a_restart(spark, server, tmp_path):
    url, lists, _ = server
    lists["/s"] = items(25)
    path, marks = str(tmp_path / "out"), str(tmp_path / "marks")

    def turn():
        stream = store.stream_store(spark, f"{url}/s", page_rows="10", pages_per_batch="2")
        query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", marks).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None

    for more in (0, 3, 0, 30):  # the open last page grows, nothing comes, several pages come
        lists["/s"] += items(more, len(lists["/s"]))
        for _ in range(4):
            turn()
        assert numbers(spark.read.parquet(path)) == list(range(len(lists["/s"])))
