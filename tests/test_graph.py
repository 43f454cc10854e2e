"""Graph and merge operators on small graphs with answers worked out by hand."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from knotwork.operators import graph as g
from knotwork.operators import merge as m
from knotwork.operators.prefix import running_total

EDGES = [["a", "b", "c"], ["b", "a"], ["c", "d"], ["a", "b", None, "b"], ["e"], [], None]


def _edges(spark):
    rows = spark.createDataFrame([(v,) for v in EDGES], "vertices array<string>")
    return g.encode_edges(rows).dropDuplicates(["edge_id"])


def _vertices(spark):
    return spark.createDataFrame([(v, "T") for v in "abcdz"], "vertex_id string, entity_type string")


def _lists(df, column="vertices"):
    return sorted(r[0] for r in df.select(column).collect())


def test_encoding_sorts_and_drops_repetitions(spark):
    assert _lists(_edges(spark)) == [["a", "b"], ["a", "b", "c"], ["c", "d"], ["e"]]


def test_degree_counts_isolated_vertices(spark):
    got = dict(g.vertex_degree(_vertices(spark), _edges(spark)).collect())
    assert got == {"a": 2, "b": 2, "c": 2, "d": 1, "z": 0}


def test_degrees_sum_to_arities(spark):
    edges = _edges(spark)
    total = g.incidence(edges).count()
    assert total == edges.agg(F.sum(F.size("vertices"))).first()[0]


def test_neighbours_and_reach(spark):
    seed = spark.createDataFrame([("a",), ("z",)], "vertex_id string")
    assert sorted(map(tuple, g.neighbours(_edges(spark), seed).collect())) == [("a", "b"), ("a", "c")]
    assert dict(g.reach(_edges(spark), seed, 2).collect()) == {"a": 0, "z": 0, "b": 1, "c": 1, "d": 2}


def test_removal_shrinks_merges_and_drops(spark):
    out = g.remove_vertices(_edges(spark), spark.createDataFrame([("c",)], "vertex_id string"))
    assert _lists(out) == [["a", "b"]]


def test_induced_and_cliques(spark):
    keep = spark.createDataFrame([("a",), ("b",)], "vertex_id string")
    assert _lists(g.induced(_edges(spark), keep)) == [["a", "b"]]
    assert g.clique_pairs(_edges(spark)).count() == 5


def test_known_edges(spark):
    got = {tuple(r.vertices): r.complete for r in _edges(spark).join(g.known_edges(_edges(spark), _vertices(spark)), "edge_id").collect()}
    assert got == {("a", "b"): True, ("a", "b", "c"): True, ("c", "d"): True, ("e",): False}


def test_upsert_is_idempotent_and_nulls_replace(spark):
    stored = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, v string")
    new = spark.createDataFrame([("b", None), ("c", "n")], "id string, v string")
    once = g.upsert(stored, new, "id", ["v"])
    assert dict(once.collect()) == {"a": "x", "b": None, "c": "n"} == dict(g.upsert(once, new, "id", ["v"]).collect())
    assert dict(g.update_given(stored, new, "id", ["v"]).collect()) == {"a": "x", "b": "y"}


def test_empty_graph(spark):
    none = _edges(spark).limit(0)
    assert g.graph_stats(_vertices(spark), none).first().n_edges == 0
    assert g.remove_vertices(none, _vertices(spark)).count() == 0
    assert g.page(none.select("edge_id"), "edge_id", 1, 5).count() == 0


def test_majority_prefers_first_seen_on_ties(spark):
    rows = spark.createDataFrame([("n", 1, "b"), ("n", 2, "a"), ("n", 3, "a"), ("n", 4, "b"), ("n", 5, None), ("o", 6, None)], "k string, ord int, t string")
    assert dict(m.majority(rows, "k", "t", "ord").collect()) == {"n": "b"}


def test_structured_single_and_range(spark):
    rows = spark.createDataFrame([("x", "u", 1.0), ("y", "u", 2.0), ("y", "w", 5.0), ("z", None, None), ("e", "u", 3.0), ("e", "u", 3.0)], "k string, unit string, value double")
    got = {r.k: (r.unit, r.value, r.value_min, r.value_max) for r in m.structured(rows, "k", ["unit"], "value").collect()}
    assert got == {"x": (["u"], 1.0, None, None), "y": (["u", "w"], None, 2.0, 5.0), "z": ([], None, None, None), "e": (["u"], None, 3.0, 3.0)}


def test_longest_description(spark):
    rows = spark.createDataFrame([("k", "aa<SEP>zz<SEP> b"), ("k", None)], "k string, d string")
    assert m.longest(rows, "k", "d").first().d == "zz"


def test_insert_only_and_by_ids(spark):
    stored = spark.createDataFrame([(1, "a")], "id int, v string")
    new = spark.createDataFrame([(1, "b"), (2, "c"), (2, "c")], "id int, v string")
    assert [tuple(r) for r in m.insert_only(stored, new, "id").collect()] == [(2, "c")]
    ids = spark.createDataFrame([(0, 1), (1, 9), (2, 1)], "pos int, id int")
    assert [tuple(r) for r in m.by_ids(stored, ids, "id", ["v"]).orderBy("pos").collect()] == [(0, 1, "a"), (1, 9, None), (2, 1, "a")]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("xy"), st.integers(0, 9)), max_size=40))
def test_running_total_equals_a_loop(spark, rows):
    frame = spark.createDataFrame([(g_, i, v) for i, (g_, v) in enumerate(rows)], "g string, i int, v int").withColumn("part", F.lit(1))
    got = {r.i: r.before for r in running_total(frame, "g", ["i"], "v", "before").collect()}
    sums, want = {}, {}
    for i, (key, v) in enumerate(rows):
        want[i] = sums.get(key, 0)
        sums[key] = want[i] + v
    assert got == want


def test_token_prefix_ends_at_first_overflow(spark):
    rows = spark.createDataFrame([("g", 1, 3), ("g", 2, 9), ("g", 3, 1), ("h", 1, 20)], "g string, o int, t int")
    assert [tuple(r)[:2] for r in m.token_prefix(rows, "g", ["o"], "t", 10).select("g", "o").collect()] == [("g", 1)]
