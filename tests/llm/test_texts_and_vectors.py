"""Chunks, quality classes, packing, mixing and neighbours: invariants and brute force."""

import math
from fractions import Fraction
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from knotwork.llm import neighbours
from knotwork.llm.chunks import boundaries, cut_points, split_oversized
from knotwork.llm.mixing import mix, pfair, shares
from knotwork.llm.packing import best_fit, local_search, pack
from knotwork.llm.quality import STATS, classify, describe, statistics, tail_probabilities
from knotwork.llm.tokens import token_sizes

SETTINGS = "source string, chunk_token_size int, chunk_overlap_token_size int, knot_source int"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=120), st.integers(1, 30), st.integers(0, 40))
def test_pieces_cover_share_and_fit(strength, size, overlap):
    overlap = min(overlap, size - 1)
    pieces = cut_points(np.array(strength, dtype=np.int8), size, overlap)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(strength)
    assert all(0 < b - a <= size for a, b in pieces)
    assert all(c == max(0, b - overlap) and d > b for (_, b), (c, d) in zip(pieces, pieces[1:]))


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 9000), st.integers(1, 1200), st.integers(0, 1199))
def test_least_pieces_where_no_break_constrains_them(n, size, overlap):
    overlap = min(overlap, size - 1)
    if n > 60 * (size - overlap):
        n = 60 * (size - overlap)
    strength = np.zeros(n, dtype=np.int8)
    strength[-1] = 3
    pieces = cut_points(strength, size, overlap)
    assert len(pieces) == 1 + max(0, math.ceil((n - size) / (size - overlap)))
    assert all(b - a <= size for a, b in pieces)
    lengths = [b - a for a, b in pieces]
    assert max(lengths) - min(lengths) <= 2


def test_cuts_fall_on_breaks():
    text = " ".join(["word " * 9 + "end."] * 12)
    starts, ends, strength = boundaries(text)
    assert all(strength[b - 1] == 2 for _, b in cut_points(strength, 35, 5)[:-1])


def test_split_documents(spark):
    rows = [(1, "a b c d e f", "S ", 1), (2, "a b c", "other", 1), (3, None, None, 1), (4, " \n", "s", 1), (5, "x\ty\r\nz w", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, size int")
    conf = spark.createDataFrame([("default", 3, 1, 0), ("s", 4, None, 0)], SETTINGS)
    got = defaultdict(list)
    for r in split_oversized(docs, conf).collect():
        got[r.doc_id].append((r.piece_no, r.text))
    assert [t for _, t in sorted(got[1])] == ["a b c", "c d e f"] and got[2] == [(0, "a b c")]
    assert set(got) == {1, 2, 5} and len(got[5]) == 2
    assert split_oversized(docs.limit(0), conf).count() == 0
    assert split_oversized(docs, conf.limit(0)).count() == 3


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80))
def test_packing_keeps_items_and_room(sizes):
    bins = best_fit(sizes, 50)
    better = local_search([list(b) for b in bins], sizes, 50)
    assert sorted(i for b in better for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= 50 for b in better)
    assert math.ceil(sum(sizes) / 50) <= len(better) <= len(bins)


def test_local_search_empties_bins():
    sizes = [6, 6, 4, 4, 5, 5]  # 6+4, 6+4, 5+5
    assert len(local_search([[0, 2], [1, 4][:1], [3, 4], [5]], sizes, 10)) == 3


def test_pack_whole(spark):
    rows = [(i, n, "clash") for i, n in enumerate([30, 30, 70, 250, 0, None, 100, 20])]
    items = spark.createDataFrame(rows, "doc_id bigint, tokens bigint, container string")
    tiers = spark.createDataFrame([("t", 100), (None, 5), ("bad", 0)], "tier string, capacity_tokens int")
    got = pack(items, tiers, group=3).collect()
    assert Counter(r.doc_id for r in got) == {0: 1, 1: 1, 2: 1, 3: 3, 6: 1, 7: 1}
    fill = Counter()
    for r in got:
        fill[r.container] += r.tokens
    assert max(fill.values()) <= 100 and all(fill[r.container] == r.container_tokens for r in got)
    assert sum(r.tokens for r in got) == 500 and len(fill) == 5
    assert pack(items.limit(0), tiers).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.fractions(min_value=Fraction(1, 5000), max_value=3), min_size=1, max_size=8), st.integers(1, 3000))
def test_every_prefix_of_the_mix_is_within_a_block(raw, slots):
    weights = {str(i): w / sum(raw) for i, w in enumerate(raw)}
    needs = {s: int(w * slots) + 1 for s, w in weights.items()}
    order, done = pfair(weights, needs), Counter()
    for t, s in enumerate(order[:slots], 1):
        done[s] += 1
        assert all(abs(done[k] - w * t) < 1 for k, w in weights.items())
    assert Counter(order) == needs


def test_mix_follows_its_weights_everywhere(spark):
    """Thirds and a small source: at every prefix of the mix's slots the shares hold, with many blocks and with few."""
    rows = [(i, "abcd"[i % 4], 10) for i in range(4000)]
    sizes = spark.createDataFrame(rows, "doc_id bigint, source string, tokens bigint")
    targets = spark.createDataFrame([("a", 1 / 3, 1), ("b", 1 / 3, 1), ("c", 0.3333, 1), ("d", 0.0004, 9)], "source string, target_share double, max_repeats int")
    for most in (1 << 20, 64):
        got = mix(sizes, targets, block=20, most_slots=most).collect()
        seen = Counter((slot, r.source) for r in got for slot in r.slots)
        assert len({s for slot, s in seen}) == 4 and max(Counter(slot for slot, _ in seen).values()) == 1
        if most == 64:
            assert max(slot for slot, _ in seen) <= 64


def test_packing_never_gathers_a_tier(spark):
    """Items over half the capacity cannot share a container: they stay in their groups."""
    items = spark.createDataFrame([(i, 60) for i in range(200)], "doc_id bigint, tokens bigint")
    got = pack(items, spark.createDataFrame([("t", 100)], "tier string, capacity_tokens int"), group=20).collect()
    assert len(got) == 200 and len({r.container for r in got}) == 200
    groups = Counter(r.container.rsplit("-", 1)[0] for r in got)
    assert len(groups) == 10 and max(groups.values()) < 45


def test_mix(spark):
    rows = [(i, s, 10, 1) for i, s in enumerate(["A"] * 40 + ["b "] * 5 + [None] * 3 + ["zz"] * 3)] + [(99, "a", 0, 1)]
    sizes = spark.createDataFrame(rows, "doc_id bigint, source string, tokens bigint, part int")
    targets = spark.createDataFrame([("a", 0.6, 1), ("b", 0.3, 3), ("none", 0.1, 2)], "source string, target_share double, max_repeats int")
    got = mix(sizes, targets, block=20)
    made = {r.doc_id: r for r in got.collect()}
    assert max(r.uses for r in made.values() if r.source == "b") == 3 and max(r.uses for r in made.values() if r.source == "a") == 1
    assert all(len(r.slots) == r.uses for r in made.values())
    report = {r.source: r for r in shares(got, targets).collect()}
    assert report["a"].actual_share == pytest.approx(2 / 3, abs=0.02) and report["none"].tokens == 0
    assert mix(sizes.limit(0), targets).count() == 0


def test_token_sizes_match_the_library(spark, data):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").limit(40)
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = {r.doc_id: len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect()}
    assert {r.doc_id: r.tokens for r in token_sizes(docs, []).collect()} == want


PROSE = "The pump was stopped after the second run, and the level in both tanks was read twice. It is not clear why the level fell. "


@pytest.mark.parametrize("text, kind", [
    ("- felt, 3 pieces\n- plate\n- check the pump\n- pipe, 2 pieces\n", "list"), ("Keywords: felt; plate; pump; pipe; tank; frame", "list"), ("[1] A. Bohr, On felts, J. Cells 7 (2006) 97.\n[2] B. Dirac, On plates, J. Cells 8 (2007) 12.", "list"), ("felt ........ 12\nplate ....... 14\npump .... 20", "list"),
    ("run;cell;loss\n1;felt;0.3\n2;plate;0.4\n3;pump;-", "table"), ("| run | loss |\n|---|---|\n| 1 | 0.3 |\n| 2 | 0.4 |", "table"), ("run    loss    gain\n1      0.3     2\n2      0.4     5", "table"), ("<table><tr><td>1</td><td>2</td></tr></table>", "table"),
    ("00000000  41 60 ca 05 0a b8 a3\n00000010  78 fc 3e 0a 2e 30 6d", "junk"), ("qxkrt bvnml zzkwp trwqk nbvcx plkjh mnbvq wrtpl kjhgf", "junk"), ("the of and to in it was for on at by with the of and", "junk"), ("next page\n" * 12, "junk"), ("felt 12!!! " * 20, "junk"), ('<div class="a"><span>&nbsp;</span></div>\n' * 5, "junk"),
    (PROSE * 3, None), (PROSE + "\n- felt\n- plate\n" + PROSE * 2, None), ("# Title\n\n" + PROSE, None), (PROSE.lower().replace(".", "").replace(",", "") * 2, None), ("Die Pumpe wurde nach dem zweiten Lauf gestoppt, und der Stand in beiden Behältern wurde gelesen.", None), ("在这一组实验中，泵在第二次运行之后停止，因为液面下降了。", None),
])
def test_descriptions(text, kind):
    v = dict(zip(STATS, describe(text)))
    got = "junk" if v["noise_share"] > 0.5 else "table" if v["cell_share"] > 0.5 else "list" if v["item_share"] > 0.5 else None
    assert got == kind, v


def test_exact_tails(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "ab"[i % 2], float(v)) for i, v in enumerate(rng.integers(0, 6, size=200))]
    stats = spark.createDataFrame([(*r, r[0]) for r in rows], "doc_id bigint, lang string, x double, text_hash bigint")
    got = {(r.lang, r.value): (r.below, r.above) for r in tail_probabilities(stats, ["x"]).collect()}
    for lang in "ab*":
        x = np.array([v for _, k, v in rows if lang in ("*", k)])
        for value in set(x):
            assert got[lang, value] == pytest.approx(((x <= value).mean(), (x >= value).mean()))


def test_classify_odd_rows(spark):
    rows = [(i, PROSE * (1 + i % 3), "en", 1) for i in range(30)] + [(50, "- a\n- b\n- c\n- d", None, 1), (51, None, "en", 1), (52, " \n", "en", 1), (53, PROSE * 5000, "xx", 1), (50, "- a\n- b\n- c\n- d", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score int")
    got = {r.doc_id: r.doc_class for r in classify(docs).collect()}
    assert got[50] == "list" and 51 not in got and 52 not in got and got[53] == "prose" and len(got) == 32
    assert {v for k, v in got.items() if k < 30} == {"prose"}
    assert classify(docs.limit(0)).count() == 0 and statistics(docs.limit(0)).count() == 0


TABLE = "| run | loss |\n|---|---|\n| 1 | 0.3 |\n| 2 | 0.4 |"


def test_ranks_choose_the_candidates(spark):
    """Copies of a table fill a third of the rows, and one language holds lists only: both are found; prose with a small list in it is held back."""
    rows = [(i, PROSE * (1 + i % 7) + f"Run {i} was the last.", "en") for i in range(200)]
    rows += [(1000 + i, TABLE, None) for i in range(120)] + [(2000 + i, f"- Pumpe {i}\n- Rahmen {i}\n- Filz\n- Dichtung {i}", "de") for i in range(30)]
    rows += [(3000 + i, PROSE * 3 + f"\n- felt {i}\n", "en") for i in range(20)]
    got = {r.doc_id: r for r in classify(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    assert {got[1000 + i].doc_class for i in range(120)} == {"table"} and {got[2000 + i].doc_class for i in range(30)} == {"list"}
    assert {r.doc_class for k, r in got.items() if k < 1000 or k >= 3000} == {"prose"}
    assert sum(r.candidate for k, r in got.items() if k < 200) == 0


def _cloud(n=900, dim=96, seed=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(60, dim))
    return np.concatenate([centres[rng.integers(0, 60, n // 2)] + rng.normal(scale=0.3, size=(n // 2, dim)), rng.normal(size=(n - n // 2, dim))]) * rng.uniform(0.3, 3, size=(n, 1))


@pytest.mark.parametrize("block", [4_000, 25])
def test_neighbours_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(neighbours, "BLOCK", block)
    points = _cloud()
    bad = [(2000, "s", None), (2001, "s", [0.0] * 96), (2002, "s", [1.0] * 95), (2003, "s", [float("nan")] * 96), (2004, None, points[0].tolist()), (0, "s", points[0].tolist())]
    rows = spark.createDataFrame([(i, "s", p.tolist()) for i, p in enumerate(points)] + bad, "vec_id bigint, namespace string, embedding array<float>")
    got = defaultdict(set)
    for r in neighbours.most_similar(rows, 10, 0.85).collect():
        got[r.query].add(r.other)
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    s = unit @ unit.T
    np.fill_diagonal(s, -1)
    want = {(i, j) for i in range(len(points)) for j in np.argsort(-s[i])[:10] if s[i, j] >= 0.85}
    found = {(i, j) for i, js in got.items() for j in js}
    assert not found - {(i, j) for i in range(len(points)) for j in range(len(points)) if s[i, j] >= 0.85 - 1e-6}
    assert len(want) > 300 and len(want & found) / len(want) >= 0.95


def test_second_centres_keep_cells_small(spark, monkeypatch):
    """With more vectors than the sample's centres can share out, cells get a second centre and recall holds."""
    monkeypatch.setattr(neighbours, "CELL", 25)
    monkeypatch.setattr(neighbours, "SAMPLE", 800)
    points = _cloud(4000)
    seen, fit = {}, neighbours.fit
    monkeypatch.setattr(neighbours, "fit", lambda *a, **k: seen.setdefault("model", fit(*a, **k)))
    rows = spark.createDataFrame([(i, "s", p.tolist()) for i, p in enumerate(points)], "vec_id bigint, namespace string, embedding array<float>")
    got = {(r.query, r.other) for r in neighbours.most_similar(rows, 10, 0.85).collect()}
    assert len(seen["model"].second["s"]) >= 2
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    s = unit @ unit.T
    np.fill_diagonal(s, -1)
    want = {(i, j) for i in range(len(points)) for j in np.argsort(-s[i])[:10] if s[i, j] >= 0.85}
    assert len(want) > 1000 and len(want & got) / len(want) >= 0.9


@pytest.mark.parametrize("asking", [16_000, 60])
def test_copies_of_a_vector(spark, monkeypatch, asking):
    """A third of the rows are one vector, others come in twos: every row has its ten nearest, ties to the smaller ids."""
    monkeypatch.setattr(neighbours, "ASKING", asking)
    monkeypatch.setattr(neighbours, "BLOCK", asking)
    points = _cloud(300)
    points[100:200] = points[100]
    points[200:240] = points[240:280]
    order = np.random.default_rng(1).permutation(300)
    rows = spark.createDataFrame([(int(order[i]), "s", p.tolist()) for i, p in enumerate(points)], "vec_id bigint, namespace string, embedding array<float>")
    got = defaultdict(list)
    for r in neighbours.most_similar(rows, 10).collect():
        got[r.query].append((-round(r.similarity, 4), r.other))
    x = np.empty((300, 96), dtype=np.float32)
    x[order] = points
    unit = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float64)
    s = np.round(unit @ unit.T, 4)
    assert len(got) == 300
    for i in range(300):
        want = sorted((-s[i, j], j) for j in range(300) if j != i)[:10]
        assert len(got[i]) == 10 and np.allclose([w[0] for w in want], sorted(g[0] for g in got[i]), atol=2e-4)
        if s[i].max() > 0.99999 and want[-1][0] < -0.99999:
            assert [w[1] for w in want] == [g[1] for g in sorted(got[i])]


def test_anisotropic_codes_cut_the_parallel_error():
    x = _cloud(2000)
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    model = neighbours.fit(np.array(["s"] * len(x), dtype=object), x, {"s": len(x)}, 96)
    rest = x - model.centres["s"][(x @ model.centres["s"].T).argmax(1)]

    def parallel(eta):
        model.eta = eta
        codes = model.encode(x, rest, 2)
        return np.abs(((rest - model.books[np.arange(24)[None], codes].reshape(len(x), -1)) * x).sum(1)).mean()

    assert parallel(8.0) < parallel(1.0)


def test_no_vectors(spark):
    rows = spark.createDataFrame([(1, "s", None)], "vec_id bigint, namespace string, embedding array<float>")
    assert neighbours.most_similar(rows).count() == 0 and neighbours.most_similar(rows.limit(0)).count() == 0
