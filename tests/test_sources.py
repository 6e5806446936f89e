"""Files of traces: line numbers over splits, sources without anything usable, folders of mixed files."""

import json

import pytest

from traceloom.sources import folders
from traceloom.sources import traces as R


def write(folder, name, lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(x + "\n" for x in lines), encoding="utf-8")
    return str(folder)


def test_line_numbers_of_files_in_many_splits(spark, tmp_path):
    """Each split is a few lines long; blank lines count, long lines span splits."""
    first = [f"a{k}" * (1 + 50 * (k % 17 == 0)) if k % 6 else "" for k in range(400)]
    path = write(tmp_path / "t", "a.txt", first)
    write(tmp_path / "t", "b.txt", [])
    write(tmp_path / "t", "c.txt", [f"c{k}" for k in range(90)])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        lines = R.numbered_lines(spark, path)
        assert spark.read.text(path).rdd.getNumPartitions() > 20
        rows = lines.orderBy("line_id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert [r["value"] for r in rows] == first + [f"c{k}" for k in range(90)]
    assert [r["line_id"] for r in rows] == list(range(1, 491))
    assert [r["line"] for r in rows] == [*range(1, 401), *range(1, 91)]


def test_labelled_file(spark, tmp_path):
    good = {"question": "q", "final_answer": "a", "label": "pass"}
    path = write(tmp_path / "l", "x.jsonl", ["", json.dumps(good), json.dumps(good) + " trailing", "", json.dumps(good | {"trace_id": "own"}), "[1]", json.dumps({"question": "q"})])
    rows = R.read_labelled(spark, path)
    assert {(r["trace_id"], r["reason"]) for r in rows.collect()} == {("line-2", None), ("line-3", "not JSON"), ("own", None), ("line-6", "not JSON"), ("line-7", "missing final_answer")}
    assert R.usable(rows, path).count() == 2 and "reason" not in R.usable(rows, path).columns


def test_a_source_without_anything_usable_is_an_error(spark, tmp_path):
    path = write(tmp_path / "n", "x.jsonl", ["{}", "nothing", "more"])
    with pytest.raises(ValueError, match="2 x not JSON, 1 x missing question"):
        R.usable(R.read_labelled(spark, path), "x.jsonl")
    with pytest.raises(ValueError, match="empty"):
        R.usable(R.read_labelled(spark, write(tmp_path / "e", "x.jsonl", ["", " "])), "x.jsonl")


def span(trace, span_id, question, answer):
    attributes = [{"key": k, "value": {"stringValue": v}} for k, v in (("input.value", question), ("output.value", answer)) if v is not None]
    return {"traceId": trace, "spanId": span_id, "name": "root", "attributes": attributes}


def test_folder_of_spans_annotations_and_traces(spark, tmp_path):
    t1, t2, t3, t4 = (c * 32 for c in "1234")
    s1, s2, s3, s4 = (c * 16 for c in "1234")
    spans = [span(t1, s1, "q1", "a1"), span(t2, s2, "q2", "a2"), span(t3, s3, "q3", None), span(t4, s4, "q4", "a4")]
    path = write(tmp_path / "m", "spans.jsonl", [json.dumps({"resourceSpans": [{"scopeSpans": [{"spans": spans[:2]}]}]}), "", json.dumps({"resource_spans": [{"scope_spans": [{"spans": spans[2:]}]}]})])
    said = [
        {"name": "review", "trace_id": t1, "label": "correct", "created_at": "2024-01-02"}, {"name": "review", "trace_id": t1, "label": "wrong", "created_at": "2024-01-01"},
        {"name": "review", "span_id": s2, "result": {"label": None, "score": 0.5}, "created_at": "2024-01-01"}, {"name": "review", "trace_id": t3, "label": 1, "created_at": "x"},
        {"name": "other", "trace_id": t4, "label": "correct"}, {"name": "review", "trace_id": t4, "label": "no idea"}, {"name": "review", "label": "good"},
    ]
    write(tmp_path / "m", "said.jsonl", [*map(json.dumps, said), "{", '{"a": 1} x'])
    write(tmp_path / "m", "traces.jsonl", [json.dumps({"input": "q", "actual_output": "a", "expected_output": "a"})])
    found = folders.read_folder(spark, path)
    out = {r["trace_id"]: (r["question"], r["final_answer"], r["label"]) for r in folders.labelled_folder(found, "review").collect()}
    assert out == {t1: ("q1", "a1", "correct"), t2: ("q2", "a2", "partial")}
    assert [(r["question"], r["label"]) for r in found.traces.collect()] == [("q", "correct")]
    rejects = {(r["file"].rsplit("/", 1)[1], r["line"], r["reason"]) for r in found.rejects.collect()}
    unread, no_object, unknown = "an annotation without a readable label or score", "not a JSON object", "neither spans nor an annotation nor a trace"
    assert rejects == {("said.jsonl", 6, unread), ("said.jsonl", 7, unknown), ("said.jsonl", 8, no_object), ("said.jsonl", 9, no_object)}


def test_an_empty_folder_holds_nothing(spark, tmp_path):
    found = folders.read_folder(spark, write(tmp_path / "z", "x.jsonl", []))
    assert found.spans.count() == found.annotations.count() == found.traces.count() == found.rejects.count() == 0
