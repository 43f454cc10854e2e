"""Sources mixed to target weights by a proportionate-fair schedule of token blocks.

A source of weight w releases its k-th block at slot floor((k - 1) / w), to be placed before slot ceil(k / w). Earliest
deadline first then keeps every source within one block of its due at every slot. Weights are exact fractions, and the
whole mix is scheduled without a repeating frame: blocks grow with the mix where it would have more than SLOTS of them,
so the schedule is a bounded table at any size.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.functions.sizes import join_hot, small_side
from knotwork.operators.prefix import running_total

SLOTS = 1 << 20  # bound on the blocks of a schedule
BLOCK_TOKENS = 2_048  # tokens of a block, where that makes no more than SLOTS blocks


def pfair(weights: dict[str, Fraction], needs: dict[str, int]) -> list[str]:
    """The source of each slot: earliest deadline first among the blocks released, until every source has its blocks.

    The weights add up to one. A source that has all its blocks leaves its slots to the others; what is left when all
    slots of the mix are given out is placed in the order of its deadlines.
    """
    slots = sum(needs.values())
    waiting = [(0, s, 1) for s in sorted(weights) if needs[s]]  # (release, source, block)
    heapq.heapify(waiting)
    ready: list[tuple[int, int, str, int]] = []
    out: list[str] = []
    while len(out) < slots:
        slot = len(out)
        if not ready and waiting and waiting[0][0] > slot:
            slot = waiting[0][0]  # all that is released is placed: the next block is taken early
        while waiting and waiting[0][0] <= slot:
            _, s, k = heapq.heappop(waiting)
            w = weights[s]
            overlaps = 1 if k * w.denominator % w.numerator else 0  # of two equal deadlines the one whose next window overlaps goes first
            heapq.heappush(ready, (-(-k * w.denominator // w.numerator), -overlaps, s, k))
        _, _, s, k = heapq.heappop(ready)
        out.append(s)
        if k < needs[s]:
            w = weights[s]
            heapq.heappush(waiting, (max(len(out), k * w.denominator // w.numerator), s, k + 1))
    return out


@dataclass
class Plan:
    total: Fraction
    tokens: dict[str, int]  # what each source has
    wanted: dict[str, Fraction]  # what each source gives
    repeats: dict[str, int]
    shares: dict[str, Fraction]


def plan(sizes: DataFrame, targets: DataFrame) -> Plan:
    """The largest mix in which every source keeps its share and no record exceeds its uses.

    A source of the target table that has no tokens is left out and the other shares are scaled up. The target table is
    a parameter: one row a source, read whole on the driver.
    """
    rows = targets.where("source is not null and target_share > 0 and max_repeats > 0").select(F.lower(F.trim("source")).alias("source"), "target_share", "max_repeats").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).collect()
    asked = sizes.sparkSession.createDataFrame([(r[0],) for r in rows], "mix_source string")
    have = {r[0]: int(r[1]) for r in sizes.join(small_side(asked), "mix_source").groupBy("mix_source").agg(F.sum("tokens")).collect() if r[1]}
    kept = [r for r in rows if have.get(r[0])]
    weight = {r[0]: Fraction(repr(float(r[1]))) for r in kept}
    scale = sum(weight.values())
    shares = {s: w / scale for s, w in weight.items()}
    repeats = {r[0]: int(r[2]) for r in kept}
    total = min((Fraction(repeats[s] * have[s]) / shares[s] for s in shares), default=Fraction(0))
    return Plan(total, have, {s: shares[s] * total for s in shares}, repeats, shares)


def mix(sizes: DataFrame, targets: DataFrame, block: int = BLOCK_TOKENS, most_slots: int = SLOTS) -> DataFrame:
    """doc_id, source, tokens, uses, slots (the schedule's slot of each use): the records of the mix.

    sizes: doc_id, source, tokens. Sources are compared trimmed and in lower case; records of null or other sources and
    records without tokens are left out. A source's records come in the order of a hash of their ids, pass after pass;
    a record is used in every pass in which at least half of it lies before the source's due, so a source misses its
    due by half a record at most. A use belongs to the block its first token lies in. A source named twice among the
    targets counts once, with its larger values. An empty table gives an empty result.
    """
    spark = sizes.sparkSession
    rows = sizes.where("tokens > 0 and source is not null").select("doc_id", F.lower(F.trim("source")).alias("mix_source"), "tokens")
    p = plan(rows, targets)
    if not p.shares:
        return spark.createDataFrame([], "doc_id bigint, source string, tokens bigint, uses int, slots array<bigint>")
    block = max(block, -(-p.total.numerator // (p.total.denominator * max(1, most_slots - 2 * len(p.shares)))))
    needs = {s: int(w // block) + 1 for s, w in p.wanted.items()}
    seen: dict[str, int] = {}
    order = pfair(p.shares, needs)
    numbers = [seen[s] for s in order if seen.update({s: seen.get(s, -1) + 1}) is None]
    schedule = spark.createDataFrame(pd.DataFrame({"mix_source": order, "b": numbers, "slot": range(len(order))}), "mix_source string, b bigint, slot bigint")
    facts = spark.createDataFrame([(s, p.tokens[s], float(p.wanted[s]), p.repeats[s]) for s in sorted(p.shares)], "mix_source string, has bigint, due double, most int")
    mine = rows.join(small_side(facts.select("mix_source")), "mix_source").withColumn("h", F.xxhash64("doc_id"))
    placed = running_total(mine, "mix_source", ["h", "doc_id"], "tokens", "start")
    uses = placed.join(small_side(facts), "mix_source").withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("most") - 1))).withColumn("at", F.col("start") + F.col("turn") * F.col("has")).where("at + tokens / 2 <= due")
    blocks = uses.withColumn("b", F.floor(F.col("at") / block))
    slotted = join_hot(blocks, schedule, ["mix_source", "b"])
    return slotted.groupBy("doc_id").agg(F.first("mix_source").alias("source"), F.first("tokens").alias("tokens"), F.count("*").cast("int").alias("uses"), F.sort_array(F.collect_list("slot")).alias("slots"))


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target_share, actual_share, tokens, records, most_uses of a mix; sources without records report 0."""
    got = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("tokens"), F.count("*").alias("records"), F.max("uses").alias("most_uses"))
    whole = got.agg(F.sum("tokens")).first()[0] or 1
    wanted = targets.where("source is not null").select(F.lower(F.trim("source")).alias("source"), "target_share")
    return wanted.join(got, "source", "left").select("source", "target_share", F.round(F.coalesce("tokens", F.lit(0)) / whole, 6).alias("actual_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"))
