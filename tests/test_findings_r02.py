"""Findings of round 2: what failed before."""

from __future__ import annotations

import random
from decimal import ROUND_HALF_UP, Decimal

import pyarrow as pa
import pytest

from knotwork.operators import evaluate, instances, scoring


def test_a_share_without_a_number_is_no_instance(spark):
    """a percent sign that no number precedes ended numeric_instances with an index error."""
    rows = [(1, "coulombic efficiency in %", "METRIC", None), (2, "coulombic efficiency in %", "METRIC", 95.0), (3, "CE 97 %", "METRIC", None)]
    got = {r.mention_id: (r.node_id, r.value) for r in instances.instances(spark.createDataFrame(rows, "mention_id long, name string, entity_type string, value double")).collect()}
    assert got == {2: ("measurement:ce_95_0_percent", 95.0), 3: ("measurement:ce_97_0_percent", 97.0)}


def _brute(claim: dict, row: dict, hybrid: bool) -> float:
    share = lambda hits, of: sum(hits) / max(1, len(of))
    norm, tight = claim["claim_norm"], claim["claim_norm"].replace(" ", "")
    words, names = share((t in row["norm"] for t in claim["claim_terms"]), claim["claim_terms"]), share((any(p in norm for p in ps) for ps in row["parts"]), row["parts"])
    if not hybrid:
        return 0.75 * words + 0.25 * names
    bonus = float(claim["claim_relation"] != "" and any(t in row["relation_type"] for t in claim["claim_relation"].split("|")))
    return 0.45 * words + 0.25 * names + 0.15 * share((c in tight for c in row["conditions"]), row["conditions"]) + 0.10 * share((any(n in norm for n in ns) for ns in row["measures"]), row["measures"]) + 0.05 * bonus + min(row["arity"], 6) * 0.01


@pytest.mark.parametrize("hybrid", [True, False])
def test_best_rows_equal_every_pair_scored(hybrid, monkeypatch):
    """F1 to F3, F5 to F11: evidence met every fact in one expression; the best rows now come from blocks in which most rows are never scored."""
    monkeypatch.setattr(scoring, "BLOCK", 64)
    monkeypatch.setattr(scoring, "CELLS", 1)
    monkeypatch.setattr(scoring, "GROUP", 1_500)
    draw = random.Random(5)
    stock = ["felt", "feltro", "ph", "12", "cell", "acid", "a", "membrane", "rest", "mem", "95.2", "x9", "pumped"]
    some = lambda low, high: [draw.choice(stock) for _ in range(draw.randint(low, high))]
    rows = [{"evidence_id": 7_000 - i, "norm": " ".join(some(0, 9)), "parts": [[" ".join(some(1, 2))] if draw.random() < 0.9 else [*some(0, 3)] for _ in range(draw.randint(0, 3))], "conditions": ["condition:" + "".join(some(1, 1)) for _ in range(draw.randint(0, 2))], "measures": [[draw.choice(["12", "9", "95.2", "7"]) for _ in range(draw.randint(0, 2))] for _ in range(draw.randint(0, 2))], "arity": draw.randint(0, 8), "relation_type": draw.choice(["", "COMPARISON", "MECHANISM_EVIDENCE"])} for i in range(3_000)]
    claims = [{"cid": i, "claim_norm": " ".join(some(0, 8)) + draw.choice(["", " condition: acid", " condition:ph"]), "claim_terms": sorted(set(some(0, 6))), "claim_relation": draw.choice(["", "COMPARISON", "DEGRADATION_CHAIN|MECHANISM_EVIDENCE"])} for i in range(40)]
    lists = pa.list_(pa.list_(pa.string()))
    table = pa.Table.from_pylist(rows, pa.schema([("evidence_id", pa.int64()), ("norm", pa.string()), ("parts", lists), ("conditions", pa.list_(pa.string())), ("measures", lists), ("arity", pa.int32()), ("relation_type", pa.string())]))
    asked = pa.Table.from_pylist(claims, pa.schema([("cid", pa.int64()), ("claim_norm", pa.string()), ("claim_terms", pa.list_(pa.string())), ("claim_relation", pa.string())]))
    exact = lambda x: Decimal(repr(x)).quantize(Decimal("0.000001"), ROUND_HALF_UP)
    found: dict[int, list] = {}
    for batch in scoring.best_rows(iter(table.to_batches(max_chunksize=500)), asked, 10, scoring.HYBRID if hybrid else scoring.PLAIN):
        for r in batch.to_pylist():
            found.setdefault(r["cid"], []).append((-exact(r["score"]), r["evidence_id"]))
    for claim in claims:
        assert sorted(found[claim["cid"]])[:10] == sorted((-exact(_brute(claim, r, hybrid)), r["evidence_id"]) for r in rows)[:10]


def test_scores_round_half_up_on_their_decimals():
    assert scoring.millionths(scoring.np.array([0.1234565, 0.2234565, 1.0000005, 0.3333333, 0.0])).tolist() == [123457, 223457, 1000001, 333333, 0]


def test_equal_claims_are_ranked_once_for_each_fact(spark):
    edges = spark.createDataFrame([(i, ["a:yield", f"b:{i}"], None, f"stirring raises the yield {i % 3}") for i in range(1, 9)], "ord bigint, vertices array<string>, relation_type string, description string")
    facts = spark.createDataFrame([(1, "stirring raises yield 2"), (2, "stirring raises yield 2"), (3, None), (4, "Ω")], "fact_id bigint, claim string")
    got = {}
    for r in evaluate.rank(facts, evaluate.evidence_text(edges), 2).collect():
        got.setdefault(r.fact_id, []).append((r["rank"], r.evidence_id))
    assert sorted(got[1]) == sorted(got[2]) == [(1, 2), (2, 1)] and sorted(got[4]) == [(1, 1), (2, 2)] and 3 not in got
