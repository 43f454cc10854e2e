"""Defective answers and judges' consensus: examples, the label model, recovery of planted truth, odd rows."""

import numpy as np
import pytest

from knotwork.llm.consensus import Consensus, agreement, votes
from knotwork.llm.defect_examples import EXAMPLES
from knotwork.llm.defects import LabelModel, copied_votes, find_defects, refusal_votes, squeeze, truncated_votes, validation

PAIRS = "answer_id bigint, question string, answer string, gram string, word string"


def _pairs(spark, rows):
    return spark.createDataFrame([(i, q, a, "clash", "clash") for i, (q, a) in enumerate(rows)], PAIRS)


def test_label_model_learns_from_patterns_alone():
    rng = np.random.default_rng(3)
    truth = rng.random(20_000) < 0.1
    right = [0.97, 0.95, 0.95, 0.9]
    says = np.stack([np.where(rng.random(len(truth)) < p, truth, ~truth) for p in right], axis=1)
    silent = rng.random(says.shape) < 0.2
    seen = ["".join("0" if s else "+" if v else "-" for v, s in zip(vs, ss)) for vs, ss in zip(says, silent)]
    patterns, counts = np.unique(seen, return_counts=True)
    model = LabelModel(list(patterns), counts.astype(float))
    assert abs(model.prior - 0.1) < 0.02
    assert ((model.posterior(seen) > 0.5) == truth).mean() > 0.97


def test_silence_is_no_evidence():
    model = LabelModel(["000", "+00", "--0"], np.array([900.0, 50.0, 50.0]))
    assert abs(model.posterior(["000"])[0] - model.prior) < 1e-9


def test_functions_look_at_different_things():
    assert refusal_votes("Most of the 12 cells survived the final month, and we do not know why.") == "000--"
    assert refusal_votes("I'm sorry, but I can't help with that.")[0] == "+"
    assert truncated_votes("It had been run for 35 weeks at 45 °C.")[0] == "-"
    assert truncated_votes("It was measured by Dr. E.")[0] == "0"
    assert truncated_votes("First, the cell is rinsed.\n2.")[3] == "+"
    assert copied_votes("Why does it swell in acid?", "The question is: Why does it swell in acid?").count("+") >= 3
    assert copied_votes("Why does it swell in acid?", "Why does it swell in acid? Because the fibres take up water and their coating breaks.")[1] == "-"


def test_examples_and_odd_rows(spark):
    rows = [(q, a) for q, a, _ in EXAMPLES] * 8 + [(None, None), ("", "x"), (None, "The cell was kept at rest."), ("Why?", "​"), ("Why is it so?", "The reason is simple. " * 20_000)]
    got: dict[int, set] = {}
    for r in find_defects(_pairs(spark, rows)).collect():
        got.setdefault(r.answer_id, set()).add(r.defect_type)
    n = len(EXAMPLES)
    wanted = [k for _, _, k in EXAMPLES]
    right = sum((wanted[i] in got.get(i, set())) if wanted[i] else i not in got for i in range(n))
    assert right >= 0.85 * n
    assert got[8 * n] == {"empty"} and got[8 * n + 3] == {"empty"} and 8 * n + 4 not in got


def test_several_defects_of_one_pair_are_kept():
    q, a = "What does it do (or not do) in the cell?", "What does it do (or not do in the"
    assert "+" in truncated_votes(squeeze(a)) and copied_votes(q, a).count("+") >= 2


def test_contexts_tell_cut_sentences(spark):
    """Sentences of a few shapes; some answers miss the stop only, some are cut within a sentence."""
    rows, cut = [], set()
    for i in range(900):
        whole = f"The run {i} was kept at rest for {i % 40} days. The loss of the cell depends on the flow of acid. It follows that the flow of acid limits the loss of the cell."
        if i % 9 == 0:
            whole, _ = whole[: whole.rindex("limits")].rstrip(), cut.add(i)
        elif i % 9 == 1:
            whole = whole.rstrip(".")
        elif i % 9 == 2:
            whole, _ = whole[: whole.rindex("limits") + 4], cut.add(i)
        rows.append((f"What limits the run {i}?", whole))
    got = {r.answer_id for r in find_defects(_pairs(spark, rows)).where("defect_type = 'truncated'").collect()}
    assert got == cut


def test_validation_reports_both_sides(spark):
    rows = [(f"Why does the cell number {i} lose some of its charge?", f"The cell number {i} loses some of its charge because the seal of the tank is not tight. It was seen in {i % 7} runs.") for i in range(300)]
    got = {(r.defect_type, r.lang): r for r in validation(_pairs(spark, rows)).collect()}
    for defect in ("empty", "copied_question", "refusal"):
        r = got[defect, "en"]
        assert r.found >= 0.85 * r.damaged and r.wrongly_found <= 0.05 * r.sound


def test_empty_pairs(spark):
    assert find_defects(_pairs(spark, []).limit(0)).count() == 0


JUDGED = "answer_id bigint, per_model_judgments array<struct<judge_name:string,judge_model:string,factual_correctness:double,overall_score:double,reason:string>>, judge string, codes int"


def _judged(spark, rows):
    return spark.createDataFrame([(i, None if js is None else [(n, "m", s, None, None) for n, s in js], "clash", 1) for i, js in rows], JUDGED)


def test_usable_scores(spark):
    rows = [(1, [(" Ann ", 3.0), ("ann", 3.0), ("bob", 2.5), ("cy", 9.0), (None, 4.0), ("dee", None), ("eve", float("nan"))]), (1, [(" Ann ", 3.0)]), (2, None), (3, [])]
    got = [tuple(r) for r in votes(_judged(spark, rows)).collect() if r.answer_id == 1]
    assert got == [(1, "ann", 3)]


def test_planted_judges_are_recovered(spark):
    rng = np.random.default_rng(5)
    truth = rng.integers(1, 6, size=600)
    kinds = {"good1": "good", "good2": "good", "good3": "good", "lenient": "lenient", "contrary": "contrary", "four": "four", "noise": "noise", "rare": "good"}

    def score(kind, t):
        t = int(t)
        if kind == "good":
            return t if rng.random() < 0.85 else int(np.clip(t + rng.choice([-1, 1]), 1, 5))
        if kind == "lenient":
            return min(5, t + 1)
        if kind == "contrary":
            return 6 - t
        return 4 if kind == "four" else int(rng.integers(1, 6))

    rows = [(i, [(n, float(score(k, t))) for n, k in kinds.items() if n != "rare" or i < 8]) for i, t in enumerate(truth)]
    model = Consensus(votes(_judged(spark, rows)))
    labels = {r.answer_id: r.label for r in model.labels().collect()}
    assert len(labels) == 600
    assert np.mean([labels[i] == t for i, t in enumerate(truth)]) > 0.93
    judges = {r.judge: r for r in model.judges().collect()}
    assert judges["contrary"].community == "contrary" and judges["lenient"].community == "lenient" and judges["four"].community == "always_4"
    assert judges["rare"].n_labels == 8 and judges["rare"].accuracy > 0.6
    assert judges["noise"].information < 0.1 < judges["good1"].information


def test_no_votes(spark):
    model = Consensus(votes(_judged(spark, [(1, None)])))
    assert model.labels().count() == 0 and model.judges().count() == 0 and agreement(model.votes).first().alpha is None


def test_agreement_of_unanimous_judges(spark):
    rows = [(i, [("a", float(i % 5 + 1)), ("b", float(i % 5 + 1)), ("c", float(i % 5 + 1))]) for i in range(20)]
    assert agreement(votes(_judged(spark, rows))).first().alpha == pytest.approx(1.0)
