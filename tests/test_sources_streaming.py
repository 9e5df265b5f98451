import base64
import json
import os

import numpy as np
from pyspark.sql import functions as F

from tracelode.operators import book as B
from tracelode.sources import readers as R
from tracelode.sources import writers as W
from tracelode.streaming import incremental as I


def test_book_round_trip(spark, tmp_path, rows):
    b = spark.createDataFrame([("a", "b", 2), ("NONE", "a||b", 1)], B.BOOK)
    W.book(b, str(tmp_path / "book"))
    got = rows(R.book(spark, str(tmp_path / "book" / "*.txt")))
    assert got == rows(b)
    assert R.book(spark, str(tmp_path / "missing")).count() == 0


def test_book_keeps_pending_marks_and_snapshot(spark, tmp_path, rows):
    b = spark.createDataFrame([("a", "b", 2)], B.BOOK)
    marks = spark.createDataFrame([("a", "b", -1)], "src string, dst string, dec bigint")
    W.book(b, str(tmp_path / "book"), marks, b)
    path = str(tmp_path / "book" / "*.txt")
    assert rows(R.book(spark, path)) == rows(R.book(spark, path, "round_snapshot")) == [("a", "b", 2)] and rows(R.book(spark, path, "pending_discards")) == [("a", "b", -1)]
    W.book(b, str(tmp_path / "plain"))
    assert rows(R.book(spark, str(tmp_path / "plain" / "*.txt"), "pending_discards")) == []


def test_corpus_there_and_back(spark, tmp_path):
    ev = spark.createDataFrame([(10, "{}"), (2, '{"a":1}')], "example_id int, evaluator_json string")
    prompts = spark.createDataFrame([(2, "p")], "example_id int, prompt string")
    meta = spark.createDataFrame([("b", "B"), ("a", "A")], "file string, text string")
    agent = spark.createDataFrame([(10, "[]")], "example_id int, agent_data_json string")
    packed = W.corpus(ev, prompts, meta, agent)
    assert [tuple(r) for r in packed.collect()] == [(2, '{"a":1}', "p", "A", None), (10, "{}", None, "A", "[]")]
    W.materialise(packed, str(tmp_path / "out"))
    back = spark.read.text(str(tmp_path / "out" / "evaluators")).collect()
    assert sorted((r.example_id, r.value) for r in back) == [(2, '{"a":1}'), (10, "{}")] and spark.read.text(str(tmp_path / "out" / "metadata")).first().value == "A"
    import pytest

    with pytest.raises(ValueError):
        W.corpus(ev.where("false"), prompts, meta, agent)


def test_runs_and_call_logs(spark, tmp_path):
    diffs = spark.createDataFrame([(1, "a", "b", 2)], "idx int, src string, dst string, occ bigint")
    W.runs(spark, str(tmp_path / "runs"), "r1", "{}", "{}", diffs)
    W.runs(spark, str(tmp_path / "runs"), "r2", "{}", "{}", diffs)
    assert spark.read.parquet(str(tmp_path / "runs")).groupBy("run_id").count().count() == 2
    calls = spark.createDataFrame([("c1", 1, "modify", 2.0, 10, 5), ("c1", 2, "repair", 4.0, 20, 5), ("c2", 1, "modify", 3.0, 5, 5)], "case_id string, round int, label string, latency double, prompt_tokens bigint, completion_tokens bigint")
    W.call_log(calls, str(tmp_path / "log"))
    one = spark.read.json(str(tmp_path / "log" / "summary")).first()
    assert (one.calls, one.cases, one.rounds, one.mean_latency, one.prompt_tokens, one.labels.modify) == (3, 2, 2, 3.0, 35, 2)


def test_book_from_a_stream(spark, sf_dir, tmp_path, rows):
    events = spark.read.parquet(os.path.join(sf_dir, "events.parquet"))
    events.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = I.keep_book(I.transitions(stream), str(tmp_path / "book"), str(tmp_path / "state"))
    query.processAllAvailable()
    query.stop()
    want = B.count_pairs(B.transition_pairs(events, "user_id", "event_type", ["ts", "event_id"]).select("src", "dst"))
    first = rows(W.current(spark, str(tmp_path / "book")))
    assert sum(r[2] for r in first) == events.count() and {r[:2] for r in first} == {r[:2] for r in rows(want)}


def test_nested_speeches(spark, rows):
    df = spark.createDataFrame([(1, '{"a":[{"is_speech":true,"text":"x"},{"text":"no"}],"b":{"c":{"is_speech":true,"text":"y"}}}')], "id long, j string")
    assert [(r.node_path, r.speech.text) for r in R.nested_speeches(df, "id", "j").orderBy("node_path").collect()] == [("$.a[0]", "x"), ("$.b.c", "y")]
    s = spark.createDataFrame([("x", "v", 0.5, 0.5, 0.0, 16.0)], "text string, voice_name string, stability double, similarity_boost double, style double, duration double").select(F.struct("*", F.lit(None).cast("array<struct<name:string,params:map<string,string>>>").alias("transitions")).alias("s"))
    assert R.speeches(s.select(W.speech_wire(F.col("s")).alias("t")), "t").first().speech.voice_name == "v"


def test_evaluator_files(spark, tmp_path):
    for n in (2, 10):
        (tmp_path / f"evaluator_{n}.json").write_text(json.dumps({"test_cases": [{"result": {"a": 1}, "state_oracle": None, "program_info": {"init_local_str": "x"}, "program": "p"}] * 2}))
    (tmp_path / "other.json").write_text("{}")
    got = R.evaluators(spark, str(tmp_path)).collect()
    assert {(r.eval_id, r.case_no) for r in got} == {(2, 0), (2, 1), (10, 0), (10, 1)} and json.loads(got[0].program_info) == {"init_local_str": "x"}
    assert [r.eval_id for r in R.indices(spark, str(tmp_path)).collect()] == [2, 10] and R.indices(spark, str(tmp_path / "no")).count() == 0
    W.evaluators(R.evaluators(spark, str(tmp_path)), str(tmp_path / "out"))
    assert {x for x in os.listdir(tmp_path / "out") if "=" in x} == {"eval_id=2", "eval_id=10"}


def test_summaries_metadata_agents(spark, tmp_path):
    (tmp_path / "1.json").write_text('{"id": "7", "summary": "s"}')
    (tmp_path / "2.json").write_text('{"summary": "t"}')
    (tmp_path / "3.json").write_text('{"summary": " "}')
    (tmp_path / "4.json").write_text("broken")
    assert sorted((r.id, r.summary) for r in R.summaries(spark, str(tmp_path)).collect()) == [(2, "t"), (7, "s")]
    (tmp_path / "b_metadata.json").write_text("B")
    (tmp_path / "a_metadata.json").write_text("A")
    assert R.first_metadata(spark, str(tmp_path)).first().text == "A"
    (tmp_path / "agents").mkdir()
    (tmp_path / "agents" / "d.json").write_text(json.dumps({"3": {"generator": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}}))
    agents = R.agent_data(spark, str(tmp_path / "agents" / "d.json"))
    stored = spark.createDataFrame([(3, "old"), (4, "kept")], "idx int, prompt string")
    assert sorted((r.idx, r.prompt) for r in R.prompts(agents, stored).collect()) == [(3, "a"), (4, "kept")]


def test_jsonl_versions_and_checkpoints(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "idx int, value string")
    W.jsonl(df, str(tmp_path / "j"))
    assert sorted((r.idx, r.value, r._corrupt) for r in R.jsonl(spark, str(tmp_path / "j"), "idx int, value string").collect()) == [(1, "a", None), (2, None, None)]
    for rows in (df, df.where("idx = 1")):
        W.version(rows, str(tmp_path / "v"))
    assert W.current(spark, str(tmp_path / "v")).count() == 1
    assert W.append_once(df, str(tmp_path / "c"), "idx").count() == 2 and W.append_once(df, str(tmp_path / "c"), "idx").count() == 0
    assert R.resume(spark, str(tmp_path / "c")).count() == 2 and R.resume(spark, str(tmp_path / "none")).count() == 0
    W.parquet(df, str(tmp_path / "p"), order=["idx"])
    assert [r.idx for r in R.parquet(spark, str(tmp_path / "p"), "idx").collect()] == [1, 2]


def test_tensor_wire_form(spark):
    a = np.arange(6, dtype="<f4")
    df = spark.createDataFrame([(json.dumps({"__tensor__": True, "shape": [2, 3], "dtype": "<f4", "data_b64": base64.b64encode(a.tobytes()).decode()}),), ("[[1, 2], [3, -4.5]]",), (None,), ('{"__tensor__":true,"dtype":"<f4","data_b64":"%%%"}',)], "t string")
    got = [r["values"] for r in R.tensors(df, "t").collect()]
    assert got == [[0, 1, 2, 3, 4, 5], [1, 2, 3, -4.5], None, None]
    assert [r["shape"] for r in R.tensors(df, "t").collect()][:2] == [[2, 3], [2, 2]]
    wire = spark.createDataFrame([([2, 3], bytearray(a.tobytes()))], "s array<int>, d binary").select(W.tensor_wire(F.col("s"), "<f4", F.col("d")).alias("t"))
    assert R.tensors(wire, "t").first()["values"] == [0, 1, 2, 3, 4, 5]
    s = spark.createDataFrame([('{"is_speech":true,"text":"x"}',), ('{"text":"x"}',)], "t string")
    assert [r.speech.text if r.speech else None for r in R.speeches(s, "t").collect()] == ["x", None]


def test_batch_lines(spark, tmp_path):
    df = spark.createDataFrame([(1, [("user", "q")])], "id int, m array<struct<role:string,content:string>>")
    for endpoint, field in (("/v1/chat/completions", "messages"), ("/v1/responses", "input")):
        line = json.loads(W.batch_requests(df, F.concat(F.lit("request-"), F.col("id").cast("string")), F.col("m"), "model", endpoint, 9).first().value)
        assert line["custom_id"] == "request-1" and line["body"][field][0]["content"] == "q"
    (tmp_path / "r.jsonl").write_text('{"custom_id": "a", "response": {"body": {"x": 1}}}\nbroken\n')
    assert [(r.custom_id, json.loads(r.body)) for r in R.batch_responses(spark, str(tmp_path / "r.jsonl")).collect()] == [("a", {"x": 1})]


def run(df, tmp_path, name):
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(300)
    return df.sparkSession.table(name)


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(os.path.join(sf_dir, "events.parquet"))
    events.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    got = B.count_pairs(run(I.transitions(stream), tmp_path, "pairs").select("src", "dst")).collect()
    want = B.transition_pairs(events, "user_id", "event_type", ["ts", "event_id"]).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_windows(spark, sf_dir, tmp_path):
    events = spark.read.parquet(os.path.join(sf_dir, "events.parquet"))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    got = {(str(r.start), r.event_type): r.n for r in run(I.windowed_counts(stream, size="1 day"), tmp_path, "days").collect()}
    want = {(str(r.d), r.event_type): r.n for r in events.groupBy(F.date_trunc("day", "ts").alias("d"), "event_type").agg(F.count("*").alias("n")).collect()}
    assert got and all(want[k] == v for k, v in got.items()) and len(got) >= len(want) - 5
    assert run(I.session_lengths(stream), tmp_path, "sessions").count() > 0
