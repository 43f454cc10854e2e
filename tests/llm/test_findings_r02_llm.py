"""Findings of round 2 on the training-data operators: what failed before."""

from __future__ import annotations

from knotwork.llm.defects import validation


def test_cutoffs_come_from_every_pair(spark):
    """the cutoffs of p1 came from a sample of at most about 2,000 pairs; the held-out half alone has as many here."""
    rows = [(i, f"Why does cell {i} lose charge?", f"Cell {i} loses charge because its seal leaks in {i % 7} runs.") for i in range(4_000)]
    got = {(r.defect_type, r.lang): r for r in validation(spark.createDataFrame(rows, "answer_id bigint, question string, answer string")).collect()}
    assert 1_800 < got["empty", "en"].sound < 2_300 and got["empty", "en"].damaged > 300
