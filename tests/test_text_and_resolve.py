"""Chunking, parsing, references, the resolve cascade, evaluation and vectors on small inputs."""

import base64

import numpy as np
import pytest
from pyspark.sql import functions as F

from knotwork.functions import text as x
from knotwork.functions.lookalike import fold, fold_py
from knotwork.functions.units import number, parse, unit_of
from knotwork.operators.instances import number_slug
from knotwork.operators import chunking, evaluate, parsing, references, resolve, retrieval, service, vectors


def _one(spark, expression):
    return spark.range(1).select(expression.alias("v")).first().v


def test_windows_overlap_and_refuse(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (2, ""), (3, None)], "doc_id int, text string")
    got = [(r.chunk_order_index, r.tokens, r.content) for r in chunking.windows(docs, 3, 1).orderBy("chunk_order_index").collect()]
    assert got == [(0, 3, "a b c"), (1, 3, "c d e"), (2, 1, "e")]
    with pytest.raises(ValueError):
        chunking.windows(docs, 3, 3)


def test_heading_chunks_drop_the_front(spark):
    docs = spark.createDataFrame([(1, "front\n## Chunk a1\nbody one\n# Chunk b\n\nbody two\n### Chunk c\n")], "doc_id int, text string")
    got = sorted((r.source_chunk_id, r.content) for r in chunking.by_heading(docs).collect())
    assert got == [("a1", "body one"), ("b", "body two")]


def test_chunk_keys_collide_by_content(spark):
    rows = spark.createDataFrame([(1, "p 1", "x"), (2, "p1", "x"), (3, "p1", "y"), (4, None, "z")], "o int, s string, t string")
    keys = {r.o: r.chunk_key for r in chunking.chunk_keys(rows, "s", "t", "o").collect()}
    assert keys[1] == keys[2] == "p1" and keys[3].startswith("p1-") and keys[4].startswith("chunk-")


def test_json_repairs(spark):
    raw = '```json\n[{"name": "a", "type": "T",},]\n```'
    assert [tuple(r) for r in _one(spark, parsing.json_rows(F.lit(raw), "struct<name:string,type:string>"))] == [("a", "T")]
    assert [r.name for r in _one(spark, parsing.json_rows(F.lit('x {"name": "b"} y'), "struct<name:string,type:string>"))] == ["b"]
    assert _one(spark, parsing.json_rows(F.lit("nothing"), "struct<name:string,type:string>")) == []
    assert _one(spark, parsing.json_rows(F.lit("[{broken"), "struct<name:string,type:string>")) == []


def test_edge_weight_defaults(spark):
    rows = spark.createDataFrame([('("Low-order Hyperedge" | a | b | d | k | heavy)',), ('("Low-order Hyperedge" | a | b)',)], "r string")
    assert [r.weight for r in parsing.edge_records(rows, "r", [], parsing.LOW, 3).collect()] == [0.75]


def test_scalar_functions(spark):
    assert _one(spark, x.match_key(F.lit("Ion Exchange–Capacity (IEC)_"))) == "ionexchange-capacityiec"
    assert _one(spark, x.normalise(F.lit("80 mA cm−2, 1 mol L-1"))) == "80 ma/cm2 1 mol/l"
    assert _one(spark, number_slug(F.lit(-1.50).cast("double"))) == "minus_1_5"
    assert _one(spark, x.compared_unit_slug(F.lit("mA cm-2"))) == "ma_cm2"
    assert _one(spark, x.redact(F.lit('token: "abc" x'))) == 'token: "***" x'
    assert _one(spark, x.clean(F.lit(" a&amp;b\x01 "))) == "a&b"
    assert _one(spark, x.match_key(F.lit(None).cast("string"))) is None


@pytest.mark.parametrize("text", ["Ｗеx​o  ﬁ 5 ℃\xa0Ⅱ", "plain", "", "   ", "cа­fe"])
def test_fold_agrees_in_both_forms(spark, text):
    assert _one(spark, fold(F.lit(text))) == fold_py(text)


def test_reference_lookup_drops_ambiguous_keys(spark):
    names = spark.createDataFrame([("e1", ["A-1", "B"]), ("e2", ["b", "C₂"])], "id string, names array<string>")
    keys = references.lookup(names, "id", "names")
    assert dict(keys.select("key", "id").collect()) == {"a1": "e1", "c2": "e2"}
    relations = spark.createDataFrame([(1, ["a 1", "c2", "C2"]), (2, ["a1", "x"])], "edge_id int, vertices array<string>")
    got = {r.edge_id: (r.vertices, r.accepted) for r in references.known_relations(relations, keys, "id", 2).collect()}
    assert got == {1: (["e1", "e2"], True), 2: (["e1"], False)}


def test_repair_adds_the_only_one(spark):
    edges = spark.createDataFrame([(1, "c", ["m1", "x", "y"]), (2, "c", ["s1", "m1", "x"]), (3, "d", ["m1", "m2", "x"])], "edge_id int, source_id string, vertices array<string>")
    kinds = spark.createDataFrame([("s1", "SYSTEM"), ("m1", "METRIC"), ("m2", "METRIC")], "vertex_id string, entity_type string")
    got = {r.edge_id: (r.vertices, r.rules) for r in references.repair_edges(edges, kinds, "source_id", ["SYSTEM", "METRIC"]).collect()}
    assert got == {1: (["m1", "x", "y", "s1"], ["add_system"]), 2: (["s1", "m1", "x"], []), 3: (["m1", "m2", "x"], [])}


def _registry(spark):
    rows = [(1, "mem:n117", "Membrane 117", "MEMBRANE", "g", "mem:n", ["N-117"]), (2, "mem:n212", "Membrane 212", "MEMBRANE", "g", "mem:n", ["N-212"]), (3, "sys:a", "alphabetic redox flow battery", "SYSTEM", "s", None, []), (4, "metric:ce", "coulombic efficiency", "METRIC", "e", None, ["CE"])]
    return spark.createDataFrame(rows, "entity_no bigint, canonical_id string, canonical_name string, entity_type string, semantic_group string, parent_id string, aliases array<string>")


def test_cascade_decides(spark):
    rows = [(1, "n 117", "MEMBRANE"), (2, "alphabetic redox flow batery", "SYSTEM"), (3, "Membrane 118", "MEMBRANE"), (4, "something else", "SYSTEM"), (5, None, "SYSTEM"), (6, "CE", "PERFORMANCE_METRIC"), (7, "qqq", None)]
    got = {r.mention_id: (r.decision, r.canonical_id) for r in resolve.cascade(spark.createDataFrame(rows, "mention_id bigint, name string, entity_type string"), _registry(spark), []).collect()}
    assert got[1][0] == "NEED_REVIEW" or got[1] == ("CREATE_NEW", None) or got[1][1] == "mem:n117"
    assert got[2] == ("MERGE", "sys:a")
    assert got[3][0] == "NEED_REVIEW" and got[4] == ("CREATE_NEW", None) and got[5] == ("CREATE_NEW", None)
    assert got[6] == ("MERGE", "metric:ce") and got[7] == ("CREATE_NEW", None)


def test_siblings_are_blocked(spark):
    names = resolve.registry(_registry(spark))
    pairs = spark.createDataFrame([("Membrane 212", "mem:n117"), ("Membrane 117", "mem:n117"), ("Membrane 117/C", "mem:n117")], "name string, canonical_id string")
    got = {r.name: r.reason for r in resolve.blocked(pairs, names, []).collect()}
    assert got == {"Membrane 212": "high_risk_group", "Membrane 117": None, "Membrane 117/C": "component_or_variant"}


def test_similarity_scores():
    assert resolve.lcs("abcde", "ace") == 3 and resolve.ratio("", "") == 100.0
    assert resolve.partial_ratio("flow", "a flow cell") == 100.0
    assert resolve.token_set_ratio("flow battery", "battery flow cell") == 100.0


def test_chase_follows_and_stops_in_cycles(spark):
    rows = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("y", "x")], "source string, target string")
    got = dict(resolve.chase(rows).collect())
    assert (got["a"], got["b"], got["c"]) == ("d", "d", "d") and set(got) == {"a", "b", "c", "x", "y"}


def test_rank_cuts_before_dropping_zero(spark):
    facts = spark.createDataFrame([(1, "stirring raises yield")], "fact_id bigint, claim string")
    edges = spark.createDataFrame([(1, ["a:yield", "b"], "R", "stirring raises the yield"), (2, ["a:q", "b"], "R", "nothing here")], "ord bigint, vertices array<string>, relation_type string, description string")
    got = evaluate.rank(facts, evaluate.evidence_text(edges), 1).collect()
    assert [(r.evidence_id, r["rank"]) for r in got] == [(1, 1)]


def test_judge_labels(spark):
    evidence = evaluate.evidence_text(spark.createDataFrame([(1, ["m:a", "condition:t"], "R", "the b part")], "ord bigint, vertices array<string>, relation_type string, description string"))
    ranked = spark.createDataFrame([(1, 1)], "fact_id bigint, evidence_id bigint")
    need = spark.createDataFrame([(1, "entities", "m:a"), (1, "entities", "m:b_part"), (1, "conditions", "condition:t"), (2, "entities", "m:q")], "fact_id bigint, kind string, element string")
    got = {r.fact_id: (r.label, r.missing) for r in evaluate.judge(need, ranked, evidence).collect()}
    assert got == {1: ("SUPPORTED", []), 2: ("UNSUPPORTED", ["entities:m:q"])}


def test_vector_search_in_blocks_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BASE_BLOCK", 30)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 4)
    rng = np.random.default_rng(1)
    points = rng.normal(size=(100, 8))
    rows = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)] + [(100, [0.0] * 8), (101, None)], "vec_id bigint, embedding array<float>")
    got = vectors.top_k_many(rows, rows.where("vec_id % 10 = 0"), 3).collect()
    unit = (points / np.linalg.norm(points, axis=1, keepdims=True)).astype(np.float64)
    for q in range(0, 100, 10):
        s = unit[q] @ unit.T
        want = [i for i in np.argsort(-s)[:3] if s[i] >= 0.2]
        assert [r.id for r in sorted((r for r in got if r.query == q), key=lambda r: r["rank"])] == want


def test_decode_float32(spark):
    text = base64.b64encode(np.array([1.5, -2.0], dtype="<f4").tobytes()).decode()
    assert spark.createDataFrame([(text,), (None,)], "t string").select(vectors.decode_float32("t").alias("v")).collect()[0].v == [1.5, -2.0]


def test_engine_modes(spark):
    v = spark.createDataFrame([("a", "A", "T"), ("b", "B", "T"), ("c", "C", "T")], "vertex_id string, canonical_name string, entity_type string")
    e = spark.createDataFrame([("e1", ["a", "b"], 3, "one two"), ("e2", ["a", "b", "c"], 5, "three")], "edge_id string, vertices array<string>, strength int, description string")
    src = spark.createDataFrame([("a", "k1"), ("b", "k1"), ("c", "k2")], "vertex_id string, chunk_id string")
    esrc = spark.createDataFrame([("e1", "k1"), ("e2", "k2")], "edge_id string, chunk_id string")
    chunks = spark.createDataFrame([("k1", "first chunk"), ("k2", "second")], "chunk_id string, content string")
    engine = retrieval.Engine(v, e, src, esrc, chunks)
    hits = spark.createDataFrame([("a", 0)], "vertex_id string, place int")
    both = engine.context("hyper", hits, spark.createDataFrame([("e1",), ("e2",)], "edge_id string"))
    assert [r.edge_id for r in both["relations"].orderBy("place").collect()] == ["e2", "e1"]
    assert [(r.vertex_id, r.degree) for r in both["entities"].collect()] == [("a", 2)]
    assert [(r.chunk_id, r.shared) for r in both["entity_units"].collect()] == [("k1", 4)]
    graph = engine.context("graph", edge_hits=spark.createDataFrame([("e1",), ("e2",)], "edge_id string"))
    assert [r.edge_id for r in graph["relations"].collect()] == ["e1"]
    assert engine.context("hyper") == {}
    with pytest.raises(ValueError):
        engine.context("other")


def test_moving_average_equals_the_fold(spark):
    values = [3.0, 1.0, 4.0, 1.0, 5.0]
    rows = spark.createDataFrame([("k", i, v) for i, v in enumerate(values)] + [("k", 9, None), ("j", 0, 2.0)], "k string, i int, v double")
    want = values[0]
    for v in values[1:]:
        want = 0.8 * want + 0.2 * v
    got = {r.k: r.ema for r in service.moving_average(rows, "k", ["i"], "v").collect()}
    assert got["k"] == pytest.approx(want) and got["j"] == 2.0


def test_visibility(spark):
    rows = spark.createDataFrame([(1, "u"), (2, None), (3, "w")], "id int, owner string")
    see = lambda user, legacy: sorted(r.id for r in rows.where(service.visible(F.col("owner"), F.lit(user).cast("string"), legacy)).collect())
    assert see("u", True) == [1, 2] and see("u", False) == [1] and see(None, False) == [1, 2, 3]


@pytest.mark.parametrize("text, value", [("4,7", 4.7), ("19,431", 19431.0), ("2.2×10^1", 22.0), ("3.2 × 10^2", 320.0), ("8E+2", 800.0), ("-7,9", -7.9), ("twelve", 12.0), ("1.234,5", 1234.5), ("0,412", 0.412)])
def test_numbers(text, value):
    assert number(text)[0] == pytest.approx(value)


@pytest.mark.parametrize("raw, low, high, unit", [("after 42 cycles the peak power was 8.9 kW/m2", 8.9, 8.9, "kW/m2"), ("631 mW cm⁻² to 1210 mW cm⁻²", 631, 1210, "mW/cm2"), ("-12 to -5.0 degC", -12, -5, "C"), ("EE as a fraction: 0.412 to 0.657", 0.412, 0.657, "fraction"), ("pH: between 1,6 and 7", 1.6, 7, "pH"), ("３０１．４ ｍｉｎｓ", 301.4, 301.4, "min"), ("at most 1 × 10⁻¹ A/cm2", 0.1, 0.1, "A/cm2"), ("five h", 5, 5, "h"), ("720 ± 2 millivolts", 720, 720, "mV"), ("1.6 Ｍ [13]", 1.6, 1.6, "mol/L"), ("Søren cell no. 9: > 2665 A/m²", 2665, 2665, "A/m2"), ("90 °c", 90, 90, "C")])
def test_quantities(raw, low, high, unit):
    got = parse(raw)
    assert (got["lo"], got["hi"], got["unit"]) == (pytest.approx(low), pytest.approx(high), unit)


def test_no_quantity():
    assert parse("see SI")["lo"] is None and parse(None)["unit"] is None and unit_of("furlong") is None
