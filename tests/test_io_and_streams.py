"""Readers and writers as round trips, streams against their batch results, providers and configuration."""

import base64
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from knotwork import providers
from knotwork.config import Settings, condition, domain, domains, schema_errors
from knotwork.sources import readers, writers
from knotwork.streaming import ingest as streams


def test_json_and_lines(spark, tmp_path):
    (tmp_path / "kv.json").write_text('﻿{"a": {"x": 1}, "b": "t"}', encoding="utf-8")
    assert dict(readers.kv_json(spark, str(tmp_path / "kv.json")).collect()) == {"a": '{"x":1}', "b": "t"}
    assert readers.kv_json(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "l.jsonl").write_text('{"context": "x"}\n\nbroken {\n{"context": "y"}\n{"context": "x"}\n')
    assert [r.context for r in readers.unique_contexts(spark, str(tmp_path / "l.jsonl")).orderBy("place").collect()] == ["x", "y"]


def test_corpus_and_uploads(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("alpha")
    (tmp_path / "sub" / "b.txt").write_text("beta")
    (tmp_path / "c.bin").write_text("no")
    got = {r.name: r.content for r in readers.corpus(spark, str(tmp_path)).collect()}
    assert got == {"a.md": "# Source File: a.md\n\nalpha", "b.txt": "# Source File: b.txt\n\nbeta"}
    assert {r.name: r.content for r in readers.uploads(spark, str(tmp_path)).collect()} == {"a.md": "alpha", "b.txt": "beta"}


def test_graphml(spark, tmp_path):
    (tmp_path / "g.graphml").write_text('<graphml><key id="d0" for="node" attr.name="entity_type"/><key id="d1" for="edge" attr.name="weight"/><graph><node id="&quot;A&quot;"><data key="d0">"T"</data></node><node id="B"/><edge source="A" target="B"><data key="d1">2.0</data></edge></graph></graphml>')
    nodes, edges = readers.graphml(spark, str(tmp_path / "g.graphml"))
    assert {r.id: r.data for r in nodes.collect()} == {"A": {"entity_type": "T"}, "B": {}}
    assert [(r.source, r.target, r.data) for r in edges.collect()] == [("A", "B", {"weight": "2.0"})]


def test_small_files(spark, tmp_path):
    (tmp_path / "r.yaml").write_text("entities:\n  - canonical_id: a:b\n    canonical_name: B\n    entity_type: A\n    aliases: [bee]\n")
    assert readers.registry(spark, [str(tmp_path / "r.yaml"), str(tmp_path / "none.yaml")]).first().aliases == ["bee"]
    for i, data in enumerate(([{"question": "q", "answer": "a"}], {"answers": [{"question": "q", "answer": "a"}]}, {"q": "a"}, {"q": {"answer": "a"}})):
        (tmp_path / f"{i}.json").write_text(json.dumps(data))
        assert [(r.question, r.answer) for r in readers.answers(spark, str(tmp_path / f"{i}.json")).collect()] == [("q", "a")]
    (tmp_path / "g.json").write_text(json.dumps({"gold_facts": [{"fact_id": "f", "claim": "c", "required_entities": ["e"]}]}))
    assert readers.gold_facts(spark, str(tmp_path / "g.json")).first().required[0].element == "e"
    matrix = base64.b64encode(np.arange(4, dtype="<f4").tobytes()).decode()
    (tmp_path / "v.json").write_text(json.dumps({"data": [{"__id__": "x"}, {"__id__": "y"}], "matrix": matrix}))
    assert dict(readers.vectors(spark, str(tmp_path / "v.json")).collect()) == {"x": [0.0, 1.0], "y": [2.0, 3.0]}


def test_commit_reads_its_own_target(spark, tmp_path):
    path = str(tmp_path / "t")
    writers.commit_table(spark.range(3), path)
    writers.commit_table(spark.read.parquet(path).unionByName(spark.range(3, 5)), path)
    assert spark.read.parquet(path).count() == 5
    assert [p.name for p in tmp_path.iterdir()] == ["t"]
    writers.commit_all({"edges": spark.range(2), "vertices": spark.range(1)}, str(tmp_path / "db"))
    assert readers.databases(str(tmp_path)) == ["db"]


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([(1, None), (2, "bad")], "id int, error string")
    writers.split_errors(rows, "error", str(tmp_path / "o"))
    assert spark.read.json(str(tmp_path / "o" / "errors")).first().id == 2
    writers.summary_csv(spark.createDataFrame([(None,)], "a int"), ["b", "a"], str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).first().asDict() == {"b": "0", "a": "0"}
    writers.run_config({"api_key": "s", "deep": [{"token": "t", "n": 1}]}, str(tmp_path / "run.json"))
    assert json.loads((tmp_path / "run.json").read_text()) == {"api_key": "***", "deep": [{"token": "***", "n": 1}]}


def test_ingest_is_incremental(spark, tmp_path):
    folder, root = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, "a b c"), (2, "a b c"), (3, None)], "doc_id bigint, text string").write.parquet(folder)
    seen = []
    run = lambda: streams.ingest(streams.stream_documents(spark, folder, "doc_id bigint, text string"), root, 2, 1, lambda c, n: seen.append(c.count())).awaitTermination()
    run()
    spark.createDataFrame([(4, "d e"), (5, "a b c ")], "doc_id bigint, text string").write.mode("append").parquet(folder)
    run()
    assert spark.read.parquet(f"{root}/documents").count() == 2
    assert spark.read.parquet(f"{root}/chunks").count() == 5 and sum(seen) == 5


def test_streamed_rate_limit_equals_batch(spark, tmp_path):
    from knotwork.operators.service import greedy_windows

    rows = spark.createDataFrame([(i, i % 2, 1_700_000_000 + (i * i) % 37) for i in range(40)], "event_id bigint, user_id bigint, s bigint").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    rows.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "e"))
    query = streams.rate_limited(stream, 5, 2).writeStream.format("memory").queryName("limited").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    want = {(r.event_id, r.allowed) for r in greedy_windows(rows, "user_id", "ts", 5, 2, "event_id").collect()}
    assert {(r.event_id, r.allowed) for r in spark.table("limited").collect()} == want


def test_windows_over_a_stream(spark, tmp_path, data):
    events = spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    query = streams.tumbling_counts(streams.deduplicated(stream), late=None).writeStream.format("memory").queryName("counts").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("counts").agg(F.sum("n")).first()[0] > 0.9 * events.count()


def test_providers(spark):
    rows = spark.createDataFrame([(1, "One. Two."), (2, "One. Two."), (3, None)], "id int, prompt string")
    cache = spark.createDataFrame([], "args_hash string, answer string")
    out, new = providers.cached_complete(rows, "prompt", cache, lambda: providers.offline_completer)
    assert {r.id: r.answer for r in out.collect()} == {1: "One", 2: "One", 3: None} and new.count() == 1
    calls = []

    def fails(prompt, system=None, history=None):
        calls.append(1)
        raise OSError

    assert providers.Rotation([fails, providers.offline_completer])("A. B") == "A" and len(calls) == 1
    with pytest.raises(RuntimeError):
        providers.Rotation([fails], attempts=2)("x")
    assert "".join(providers.stream_text("x" * 70)) == "x" * 70


def test_configuration(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "config.json").write_text('{"entity_types": ["T"]}')
    assert domains(str(tmp_path)) == ["d"] and domain(str(tmp_path), "other", "d") == {"entity_types": ["T"]}
    assert Settings().with_(mode="graph").mode == "graph"
    with pytest.raises(ValueError):
        condition("__import__('os')")
    fields = [{"name": "name", "required": True}, {"name": "unit", "required": "conditional", "condition": "type in ['M', 'C']"}, {"name": "strength", "type": "integer", "range": [0, 10]}]
    rows = spark.createDataFrame([("a", "M", None, 3.0), ("", "X", None, 12.5)], "name string, type string, unit string, strength double")
    got = [r.e for r in rows.select(schema_errors(fields).alias("e")).collect()]
    assert got == [["unit is required"], ["name is required", "strength is out of range", "strength is not whole"]]


def test_commits_swap_one_manifest(spark, tmp_path):
    root = str(tmp_path / "db")
    writers.commit_all({"edges": spark.range(2), "vertices": spark.range(1)}, root)
    writers.commit_all({"edges": writers.committed(spark, root, "edges").unionByName(spark.range(2, 5))}, root)
    assert writers.committed(spark, root, "edges").count() == 5 and writers.committed(spark, root, "vertices").count() == 1
    assert len(list((tmp_path / "db" / "_versions").glob("*/edges"))) == 1


def test_gold_facts_are_read_whole(spark, tmp_path):
    fact = {"fact_id": "f", "claim": "c", "required_entities": ["e"], "required_conditions": [{"quantity_type": "current density", "value": 120, "unit": "mA/cm2"}, {"quantity_type": "condition:x"}], "required_metrics": [{"metric_type": "CE", "value": "97"}], "required_mechanisms": ["degradation:m"]}
    (tmp_path / "g.json").write_text(json.dumps([fact, {"claim": "none"}]))
    got = {r.fact_id: [tuple(x) for x in r.required] for r in readers.gold_facts(spark, str(tmp_path / "g.json")).collect()}
    assert got == {"f": [("entities", "e"), ("conditions", "condition:current_density_120_ma_cm2"), ("conditions", "condition:x"), ("measurements", "measurement:ce_97_0_percent"), ("mechanisms", "degradation:m")], "1": []}


def test_events_and_limits():
    import threading
    import time

    from knotwork import providers

    assert list(providers.events({"mode": "naive"}, lambda: iter(["a", "ü"]))) == ['event: meta\ndata: {"mode": "naive"}\n\n', 'event: token\ndata: {"text": "a"}\n\n', 'event: token\ndata: {"text": "ü"}\n\n', 'event: done\ndata: {"success": true}\n\n']
    assert list(providers.events({}, lambda: 1 / 0))[-1].startswith("event: error")
    assert "".join(providers.streamed("llm", "p", cached="x" * 70)) == "x" * 70 and list(providers.streamed("hyper", "p", streamer=lambda p: iter("ab"))) == ["a", "b"]
    with pytest.raises(ValueError):
        list(providers.streamed("graph", "p"))
    assert providers.converted('{"a": 1}') == {"a": 1} and providers.converted("a=1", lambda t: t.split("=")) == ["a", "1"] and providers.converted("x") is None
    now, most = [], []

    def slow(prompt, system=None, history=None):
        now.append(1)
        most.append(len(now))
        time.sleep(0.02)
        now.pop()
        return prompt

    limited = providers.Limited(slow, 2)
    threads = [threading.Thread(target=limited, args=("p",)) for _ in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert max(most) <= 2 and len(most) == 8


def test_presets():
    from knotwork.config import PRESETS, preset

    assert len(PRESETS) == 9 and preset("final_no_repair").repair is False and preset("graph_final").mode == "graph"
    with pytest.raises(ValueError):
        preset("none")
