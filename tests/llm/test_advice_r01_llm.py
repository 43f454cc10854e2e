"""What the first round's advice found missing in the training-data operators: each test fails on the code before."""

import numpy as np

from knotwork.llm import neighbours, queries_vectors
from knotwork.llm.names import UNRESOLVED, resolve_names
from knotwork.llm.quality import classify


def test_copies_of_a_table_stay_a_table(spark):
    table = "\n".join(f"{i} | {i * 7}.5 | {i * 3}" for i in range(1, 9))
    schema = "doc_id bigint, text string, lang string"
    for n in (1, 49, 60, 200):
        rows = [(i, table, None) for i in range(n)] + [(1000 + i, "The pump was stopped after the second run, and the level in both tanks was read twice. It is not clear why the level fell. " * (1 + i % 3), "en") for i in range(2 * n)]
        got = {r.doc_id: r.doc_class for r in classify(spark.createDataFrame(rows, schema)).collect()}
        assert {k: v for k, v in got.items() if k < 1000} == {i: "table" for i in range(n)}
        assert {v for k, v in got.items() if k >= 1000} == {"prose"}


def test_namespaces_without_a_sample_are_searched(spark, monkeypatch):
    points = np.random.default_rng(3).normal(size=(1_300, 96))
    rows = [(i, "large" if i < 1_000 else f"small {i // 10}", p.tolist()) for i, p in enumerate(points)]
    fit = neighbours.fit
    # The sample of a table so large that it holds no row of the small namespaces, then one with no usable row at all.
    for kept in ("large", "none"):
        monkeypatch.setattr(neighbours, "fit", lambda names, x, sizes, dim: fit(names[names == kept], x[names == kept], sizes, dim))
        got = {}
        for r in neighbours.most_similar(spark.createDataFrame(rows, "vec_id bigint, namespace string, embedding array<float>"), 3).collect():
            got.setdefault(r.query, set()).add(r.other)
        unit = points / np.linalg.norm(points, axis=1, keepdims=True)
        assert set(got) == set(range(1_300))
        for i in range(1_000, 1_300):
            mates = [j for j in range(i // 10 * 10, i // 10 * 10 + 10) if j != i]
            assert got[i] == set(sorted(mates, key=lambda j: -unit[i] @ unit[j])[:3])


def test_shards_prefer_whole_names_as_one_tree(spark):
    entries = spark.createDataFrame([("a", "Fenaricade carbon paper"), ("b", "Fenaricade carbon paperboard"), *[(f"x{i}", f"Other{'abcdefghij'[i]}stuff") for i in range(10)]], "canonical_id string, entry string")
    names = spark.createDataFrame([("Fenaricade carbon papr",), ("nothing like it",), ("Otherastuff",)], "name string")
    whole = sorted(map(tuple, resolve_names(names, entries).select("name", "canonical_id").collect()))
    assert whole == [("Fenaricade carbon papr", "a"), ("Otherastuff", "x0"), ("nothing like it", UNRESOLVED)]
    for size in (1, 2, 5):
        assert sorted(map(tuple, resolve_names(names, entries, size).select("name", "canonical_id").collect())) == whole


def test_ten_nearest_however_far(spark, monkeypatch):
    rng = np.random.default_rng(6)
    points = rng.normal(size=(3_600, 96))
    rows = spark.createDataFrame([(i, "s", p.tolist()) for i, p in enumerate(points)], "vec_id bigint, namespace string, embedding array<float>")
    monkeypatch.setattr(queries_vectors, "table", lambda *_: rows)
    got = {}
    for r in queries_vectors.p4_neighbours(spark, "").collect():
        got.setdefault(r.query, set()).add(r.other)
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    s = unit @ unit.T
    np.fill_diagonal(s, -2)
    assert np.mean([len(got[i] & set(np.argsort(-s[i])[:10])) for i in range(len(points))]) >= 9


def test_any_number_of_shards_decides_as_one_tree(spark, data):
    from knotwork.llm.names import spellings, typed_names

    read = lambda n: spark.read.parquet(f"{data}/{n}.parquet")
    names, entries = typed_names(read("alias_match"), read("rewritten_hyperedge")), spellings(read("canonical_entity"))
    whole = sorted(map(tuple, resolve_names(names, entries).select("name", "canonical_id").collect()))
    for size in (40, 150):
        assert sorted(map(tuple, resolve_names(names, entries, size).select("name", "canonical_id").collect())) == whole
