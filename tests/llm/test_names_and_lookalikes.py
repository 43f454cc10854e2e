"""Name resolution and look-alike unification against brute force, and odd rows."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from knotwork.llm.names import BKTree, Matcher, distance, key, readings, resolve_names, shortened, spellings, tidy, typed_names
from knotwork.llm.unify import corpus_values, equal_looking_pairs, unify


def _plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=9), st.text("abc", max_size=9), st.text("abc", max_size=9))
def test_distance_is_a_metric(a, b, c):
    assert distance(a, b) == _plain(a, b) == distance(b, a)
    assert distance(a, c) <= distance(a, b) + distance(b, c)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abcd", min_size=1, max_size=8), max_size=40), st.text("abcd", min_size=1, max_size=8), st.integers(0, 4))
def test_tree_finds_all_within(words, query, most):
    want = sorted((_plain(w, query), w) for w in set(words) if _plain(w, query) <= most)
    assert sorted(BKTree(words).within(query, most)) == want


ENTRIES = [("m:alphavask_117", "Alphavask 117"), ("m:alphavask_117", "ALV-117"), ("m:alphavask_212", "Alphavask 212"), ("s:betorin_ii", "Betorin(II)"), ("s:betorin_iii", "Betorin(III)"), ("e:gammadane_felt", "Gammadane graphite felt"), ("y:deltaphor", "Deltaphor flow battery")]


def test_matcher():
    m = Matcher(ENTRIES)
    hit = lambda name: {i for k in readings(name) if (h := m.best(*k)) for i in h[1]}
    for name in ("alphavask_117", "Alphavask no. 117", "117 Alphavsak", "ａｌｐｈａｖａｓｋ １１７", "our Alphavask 117 (as received)", "alv-117", '"Alphavask117"', "Alphavask 117 (ALV-117)"):
        assert hit(name) == {"m:alphavask_117"}, name
    for name in ("Betorin(2+)", "Betorin (+2)", "betorin-Ⅱ", "Betorrin(II)"):
        assert hit(name) == {"s:betorin_ii"}, name
    for name in ("Gammadane GF", "Gammadane felt", "Gamadane gr. felt"):
        assert hit(name) == {"e:gammadane_felt"}, name
    for name in ("Deltaphor FB", "Deltaphor flow batt.", "Deltaphor battery"):
        assert hit(name) == {"y:deltaphor"}, name
    for name in ("Alphavask 450", "Betorin(V)", "felt", "S-14", "Omegadane graphite felt", "n.a.", "ALV-118", "Gammadane carbon cloth"):
        assert not hit(name), name


def test_shortened():
    assert shortened("fb", "flow battery") and shortened("c paper", "carbon paper") and not shortened("cloth", "carbon paper") and not shortened("", "x")


def test_key_and_tidy():
    assert key(tidy("Betorin (IV) ion")) == ("betorin ion", "ox4")
    assert key(tidy("???")) == ("", "")


def test_sharded_equals_one_tree(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(8, 12)))
    entries = [(f"id{i}", word()) for i in range(60)]
    names = [(w[:3] + w[4:],) for _, w in entries] + [(word(),) for _ in range(40)] + [(None,)]
    e = spark.createDataFrame(entries, "canonical_id string, entry string")
    n = spark.createDataFrame(names, "name string")
    one = {r.name: r.canonical_id for r in resolve_names(n, e).collect()}
    many = {r.name: r.canonical_id for r in resolve_names(n, e, tree_entries=7).collect()}
    assert one == many and None not in one


def test_ties_and_empty_lists_stay_unresolved(spark):
    e = spark.createDataFrame([("x", "Alphavask film"), ("y", "Alphavisk film")], "canonical_id string, entry string")
    n = spark.createDataFrame([("Alphavosk film",), ("Alphavask film",), ("​ ",)], "name string")
    got = {r.name: r.canonical_id for r in resolve_names(n, e).collect()}
    assert got["Alphavosk film"] == "UNRESOLVED" and got["Alphavask film"] == "x"
    assert {r.canonical_id for r in resolve_names(n, e.limit(0)).collect()} == {"UNRESOLVED"}


def test_typed_names_skip_blanks_and_redeliveries(spark):
    a = spark.createDataFrame([(1, "x", 0), (1, "x", 0), (2, None, 0), (3, " \xa0​", 0)], "match_id bigint, canonical_name string, pos int")
    b = spark.createDataFrame([(7, ["p", None, "", "q"], 0), (8, None, 0), (9, [], 0)], "edge_id bigint, unresolved_vertices array<string>, name int")
    got = sorted(tuple(r) for r in typed_names(a, b).collect())
    assert got == [("alias_match", 1, 0, "x"), ("rewritten_hyperedge", 7, 0, "p"), ("rewritten_hyperedge", 7, 3, "q")]


def test_spellings_without_aliases(spark):
    rows = spark.createDataFrame([("i", "A", None), ("j", None, ["b"])], "canonical_id string, canonical_name string, aliases array<string>")
    assert sorted(map(tuple, spellings(rows).collect())) == [("i", "A"), ("j", "b")]


LOOK = ["film", "ﬁlm", "ｆｉｌｍ", "fi​lm", "fіlm", "Film", "fílm", "fílm", "10²", "102", "a-b", "a–b", "a b", "a\xa0b", "", "​", None]


def _values(spark, texts):
    return spark.createDataFrame([("t", "s" if i % 2 else None, i, 0, t, "clash") for i, t in enumerate(texts)], "src string, scope string, id bigint, pos bigint, text string, canonical string")


def test_classes(spark):
    got = {r.text: (r.canonical, r.variants) for r in unify(_values(spark, LOOK)).collect()}
    assert {got[t] for t in ("film", "ﬁlm", "ｆｉｌｍ", "fi​lm", "fіlm")} == {("film", 5)}
    assert got["Film"] == ("Film", 1) and got["fílm"] == got["fílm"] == ("fílm", 2)
    assert got["10²"][1] == got["102"][1] == got["a-b"][1] == got["a–b"][1] == 1
    assert got["a b"] == got["a\xa0b"] == ("a b", 2) and got[None] == (None, 0)


def test_pairs_equal_brute_force(spark):
    rows = _values(spark, LOOK * 2)
    canon = {r.id: r.canonical for r in unify(rows).collect()}
    want = {(i, j) for i in range(1, 2 * len(LOOK), 2) for j in range(i + 2, 2 * len(LOOK), 2) if canon[i] is not None and canon[i] == canon[j] and (LOOK * 2)[i] != (LOOK * 2)[j]}
    assert {(r.a_id, r.b_id) for r in equal_looking_pairs(rows).collect()} == want


def test_corpus_values_and_empty(spark):
    names = spark.createDataFrame([(1, ["a", "а"], 1), (2, None, 1)], "entity_no bigint, match_strings array<string>, text int")
    raws = spark.createDataFrame([(5, "c", "x", 1), (5, "c", "x", 1)], "quantity_id bigint, chunk_id string, raw string, pos int")
    values = corpus_values(names, raws)
    assert values.count() == 3 and equal_looking_pairs(values).count() == 1
    assert equal_looking_pairs(values.limit(0)).count() == 0
