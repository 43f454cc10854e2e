"""Consensus labels from annotators who disagree: a community confusion model fitted by variational updates.

Annotators belong to a few communities (accurate, lenient, harsh, contrary, careless, fixed on one score), each with a
confusion matrix. An annotator's own matrix has its community's matrix as prior, so annotators with few labels lean on
their community. Votes, answers and annotators are all tables: an annotator's parameters are a row that is joined to
its votes, and only sums over all annotators (a few hundred numbers a partition) reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.functions.sizes import hot_keys, join_split, small_side
from knotwork.session import durable

K = 5
WEIGHT = 12.0  # pseudo-labels that a community's row lends each annotator, and that its starting shape lends the community
KINDS = ["accurate", "lenient", "harsh", "contrary", "careless", *[f"always_{v}" for v in range(1, K + 1)]]


def votes(answers: DataFrame) -> DataFrame:
    """answer_id, name, score: one row for each judge's first usable score of an answer.

    Usable is a whole score from 1 to 5 by a named judge; names are compared trimmed and in lower case.
    """
    rows = answers.where("answer_id is not null").select("answer_id", "per_model_judgments").dropDuplicates(["answer_id"])
    each = rows.select("answer_id", F.posexplode("per_model_judgments").alias("pos", "j")).select("answer_id", "pos", F.lower(F.regexp_replace("j.judge_name", r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")).alias("name"), F.col("j.factual_correctness").alias("score"))
    usable = each.where("name <> '' and score between 1 and 5 and score = floor(score)")
    return usable.groupBy("answer_id", "name").agg(F.min_by("score", "pos").cast("int").alias("score"))


def _digamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, dtype=float)
    out = np.zeros_like(x)
    for _ in range(6):
        out -= 1.0 / x
        x = x + 1.0
    return out + np.log(x) - 0.5 / x - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6)


def _lgamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, dtype=float)
    shift = np.zeros_like(x)
    for _ in range(6):
        shift -= np.log(x)
        x = x + 1.0
    return shift + (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3)


def first_communities() -> np.ndarray:
    """Starting matrices: accurate, lenient, harsh, contrary, careless, and one for each fixed score."""
    near = np.array([[np.exp(-1.6 * abs(t - v)) for v in range(K)] for t in range(K)])
    shift = lambda d: np.array([[np.exp(-1.6 * abs(min(max(t + d, 0), K - 1) - v)) for v in range(K)] for t in range(K)])
    fixed = [np.where(np.arange(K) == v, 20.0, 1.0) * np.ones((K, K)) for v in range(K)]
    out = np.stack([near, shift(1), shift(-1), near[::-1], np.ones((K, K)), *fixed])
    return out / out.sum(axis=2, keepdims=True)


def update(counts: np.ndarray, communities: np.ndarray, shares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Variational update of annotators (J, K, K counts): community memberships and Dirichlet posteriors of their matrices."""
    prior = WEIGHT * communities
    evidence = (_lgamma(prior[None] + counts[:, None]) - _lgamma(prior)[None]).sum(axis=3) + _lgamma(prior.sum(axis=2))[None] - _lgamma(prior.sum(axis=2)[None] + counts.sum(axis=2)[:, None])
    log = np.log(shares)[None] + evidence.sum(axis=2)
    member = np.exp(log - log.max(axis=1, keepdims=True))
    member /= member.sum(axis=1, keepdims=True)
    return member, np.einsum("jm,mtv->jtv", member, prior) + counts


def pooled_counts(member: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(M, K, K): the communities' counts, each annotator's row weighing at most 4 * WEIGHT labels."""
    of = counts.sum(axis=2, keepdims=True)
    return np.einsum("jm,jtv->mtv", member, counts * np.minimum(of, 4 * WEIGHT) / np.maximum(of, 1e-9))


JUDGES = "name string, n_labels bigint, counts array<double>, logs array<double>, member array<double>, moved double"  # counts and logs (expected logarithms of the matrix) by (true class, score)


class Consensus:
    """Fit on a frame of votes; `labels`, `judges` and `agreement` give the results."""

    def __init__(self, votes: DataFrame, most: int = 40, tolerance: float = 1e-3):
        self.spark = votes.sparkSession
        self.votes = durable(votes)
        self.hot_answers, self.hot_names = hot_keys(self.votes, ["answer_id"]), hot_keys(self.votes, ["name", "score"])
        self.log_classes, self.classes = np.full(K, -np.log(K)), np.full(K, 1.0 / K)
        self.params: DataFrame | None = None
        self.rounds = 0
        start = first_communities()
        communities, shares = start, np.full(len(start), 1.0 / len(start))
        for _ in range(most):
            self.params = durable(self._annotators(communities, shares))
            sums = np.sum([np.asarray(r[0]) for r in self.params.mapInPandas(_sums, "sums array<double>").collect()] or [np.zeros(1)], axis=0)
            if len(sums) == 1:  # no votes
                break
            self.rounds += 1
            n, moved, mass, member = sums[0], sums[1] / max(sums[0], 1), sums[2 : 2 + K] + 1.0, sums[2 + K : 2 + K + len(KINDS)]
            own = WEIGHT * start + sums[2 + K + len(KINDS) :].reshape(len(KINDS), K, K)
            communities, shares = own / own.sum(axis=2, keepdims=True), (member + 1.0) / (n + len(KINDS))
            self.classes, self.log_classes = mass / mass.sum(), _digamma(mass) - _digamma(mass.sum())
            if moved < tolerance:
                break

    def posteriors(self) -> DataFrame:
        """answer_id, n_votes, q0..q4: the posterior of each class by the current parameters, from sums over the answer's votes."""
        if self.params is None:  # the start: each vote leans to its score and the scores near it
            leaning = self.votes.select("answer_id", *[(-0.8 * F.abs(F.col("score") - 1 - t)).alias(f"e{t}") for t in range(K)])
        else:
            by_score = self.params.select("name", F.explode(F.array(*[F.struct(F.lit(v + 1).alias("score"), *[F.get("logs", F.lit(t * K + v)).alias(f"e{t}") for t in range(K)]) for v in range(K)])).alias("x")).select("name", "x.*")
            leaning = join_split(self.votes, small_side(by_score), ["name", "score"], self.hot_names)
        log = leaning.groupBy("answer_id").agg(F.count("*").alias("n_votes"), *[(F.sum(f"e{t}") + float(self.log_classes[t])).alias(f"e{t}") for t in range(K)])
        top = F.greatest(*[F.col(f"e{t}") for t in range(K)])
        weights = log.select("answer_id", "n_votes", *[F.exp(F.col(f"e{t}") - top).alias(f"e{t}") for t in range(K)])
        whole = sum(F.col(f"e{t}") for t in range(K))
        return weights.select("answer_id", "n_votes", *[(F.col(f"e{t}") / whole).alias(f"q{t}") for t in range(K)])

    def _annotators(self, communities: np.ndarray, shares: np.ndarray) -> DataFrame:
        """The annotators' parameters after one round: expected counts by annotator, then the update of each row by itself."""
        each = join_split(self.votes, self.posteriors().drop("n_votes"), ["answer_id"], self.hot_answers)
        cells = each.groupBy("name", "score").agg(F.count("*").alias("n"), *[F.sum(f"q{t}").alias(f"q{t}") for t in range(K)])
        rows = cells.groupBy("name").agg(F.sum("n").alias("n_labels"), F.collect_list(F.struct("score", *[f"q{t}" for t in range(K)])).alias("cells"))  # at most one entry a score
        if self.params is not None:
            rows = rows.join(self.params.select("name", F.col("logs").alias("old")), "name")
        names = [c.split()[0] for c in JUDGES.split(", ")]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                counts = np.zeros((len(batch), K, K))
                for j, cells in enumerate(batch["cells"]):
                    for cell in cells:
                        counts[j, :, cell["score"] - 1] = [cell[f"q{t}"] for t in range(K)]
                member, own = update(counts, communities, shares)
                logs = (_digamma(own) - _digamma(own.sum(axis=2, keepdims=True))).reshape(-1, K * K)
                old = np.stack(batch["old"].tolist()) if "old" in batch and len(batch) else np.full_like(logs, -99.0)
                moved = np.abs(np.exp(logs) - np.exp(old)).max(axis=1, initial=0.0)
                yield pd.DataFrame(dict(zip(names, (batch["name"], batch["n_labels"], counts.reshape(-1, K * K).tolist(), logs.tolist(), member.tolist(), moved))))

        return rows.mapInPandas(run, JUDGES)

    def labels(self, least: int = 3) -> DataFrame:
        """answer_id, label, sure (posterior of the label), agreement (share of the votes that equal it), n_votes."""
        q = F.array(*[F.col(f"q{t}") for t in range(K)])
        best = self.posteriors().where(F.col("n_votes") >= least).select("answer_id", F.col("n_votes").cast("int").alias("n_votes"), F.array_position(q, F.array_max(q)).cast("int").alias("label"), F.array_max(q).alias("sure"))
        joined = join_split(self.votes, best.select("answer_id", "label"), ["answer_id"], self.hot_answers)
        same = joined.groupBy("answer_id").agg(F.avg((F.col("score") == F.col("label")).cast("double")).alias("agreement"))
        return best.join(same, "answer_id").select("answer_id", "label", "sure", "agreement", "n_votes")

    def judges(self) -> DataFrame:
        """judge, n_labels, accuracy (expected share of right scores), information (share of the label's entropy its scores tell), community."""
        classes = self.classes

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                matrix = np.maximum(np.exp(np.array(batch["logs"].tolist()).reshape(-1, K, K)), 1e-12)
                joint = classes[None, :, None] * matrix / matrix.sum(axis=2, keepdims=True)
                told = (joint * np.log(joint / (joint.sum(2, keepdims=True) * joint.sum(1, keepdims=True)))).sum(axis=(1, 2)) / -(classes * np.log(classes)).sum()
                kind = np.array(batch["member"].tolist()).reshape(-1, len(KINDS)).argmax(axis=1)
                yield pd.DataFrame({"judge": batch["name"], "n_labels": batch["n_labels"], "accuracy": np.trace(joint, axis1=1, axis2=2).round(4), "information": told.round(4), "community": [KINDS[i] for i in kind]})

        return self.params.mapInPandas(run, "judge string, n_labels bigint, accuracy double, information double, community string")


def _sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row a partition: annotators, sum of their largest changes, class masses, memberships, communities' counts."""
    total = None
    for batch in batches:
        if not len(batch):
            continue
        c, member = np.array(batch["counts"].tolist()).reshape(-1, K, K), np.array(batch["member"].tolist())
        part = np.concatenate([[len(batch), batch["moved"].sum()], c.sum(axis=(0, 2)), member.sum(axis=0), pooled_counts(member, c).ravel()])
        total = part if total is None else total + part
    if total is not None:
        yield pd.DataFrame({"sums": [total.tolist()]})


def agreement(votes: DataFrame) -> DataFrame:
    """pairable, alpha: Krippendorff's alpha for ordinal distance over all answers with two votes or more, in one row (alpha null without any)."""
    tally = votes.groupBy("answer_id").agg(F.count("*").alias("m"), *[F.sum((F.col("score") == v).cast("double")).alias(f"n{v}") for v in range(1, K + 1)]).where("m > 1")
    cells = [F.sum(F.col(f"n{a}") * (F.col(f"n{b}") - (1 if a == b else 0)) / (F.col("m") - 1)).alias(f"o{a}{b}") for a in range(1, K + 1) for b in range(1, K + 1)]
    row = tally.agg(*cells).first()
    o = np.array([[row[f"o{a}{b}"] or 0.0 for b in range(1, K + 1)] for a in range(1, K + 1)])
    n = o.sum(axis=1)
    between = lambda a, b: (n[min(a, b) : max(a, b) + 1].sum() - (n[a] + n[b]) / 2) ** 2
    d = np.array([[between(a, b) if a != b else 0.0 for b in range(K)] for a in range(K)])
    seen, chance = (o * d).sum(), (np.outer(n, n) * d).sum() / max(n.sum() - 1, 1)
    return votes.sparkSession.createDataFrame([(float(round(n.sum(), 6)), round(float(1 - seen / chance), 4) if chance else None)], "pairable double, alpha double")
