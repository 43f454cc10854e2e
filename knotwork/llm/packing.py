"""Texts put into containers of fixed capacity: best fit first, then local search by moves and swaps.

Items are packed in groups of bounded size; the containers a group leaves underfull give their items to the next round,
where fewer groups pack them, until one group is left, or until a round closes too little to save a group: then every
group keeps the containers it has. No task ever packs more than a group. A text is cut only if it alone exceeds the
capacity. The limits of the local search below bound its effort; they leave no item out.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.session import durable

GROUP = 12_000  # items packed together
FULL = 0.995  # a container filled to this share is closed
TRIES = 60_000  # pairs of bins that one group's local search looks at
GIVERS = 4  # bins tried as givers for every bin over the lower bound
SMALL, LARGE, PAIRED = 40, 12, 12  # items of a bin looked at: the smallest to give back, the largest to give two of, the smallest to give back two of


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: the largest item first, each into the fullest bin that has room."""
    bins: list[list[int]] = []
    rooms: list[tuple[int, int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = bisect_left(rooms, (sizes[i], -1))
        if at == len(rooms):
            bins.append([i])
            room, b = capacity - sizes[i], len(bins) - 1
        else:
            room, b = rooms.pop(at)
            bins[b].append(i)
            room -= sizes[i]
        if room:
            insort(rooms, (room, b))
    return bins


def local_search(bins: list[list[int]], sizes: list[int], capacity: int, tries: int = TRIES) -> list[list[int]]:
    """Moves, one-for-one and two-for-one exchanges between underfull bins that raise the sum of squared fills.

    The emptiest bin gives: its items move into bins with room, or take the place of smaller items (one or two) there,
    so that it loses weight until it is empty. Stops at the least number of bins, or when nothing improves.
    """
    least = -(-sum(sizes) // capacity)
    fill = [sum(sizes[i] for i in b) for b in bins]
    alive = len(bins)
    open_bins = sorted((b for b in range(len(bins)) if fill[b] < capacity), key=lambda b: (fill[b], b))
    for giver in open_bins[: max(1, alive - least) * GIVERS]:
        if alive <= least or tries <= 0:
            break
        better = True
        while better and bins[giver] and tries > 0:
            better = False
            for taker in reversed(open_bins):  # the fullest first
                if taker == giver or not bins[taker] or fill[taker] < fill[giver]:
                    continue
                room = capacity - fill[taker]
                if room <= 0:
                    continue
                tries -= 1
                step = _exchange(bins[giver], bins[taker], sizes, room)
                if step is None:
                    continue
                out, back = step
                for i in out:
                    bins[giver].remove(i)
                    bins[taker].append(i)
                for j in back:
                    bins[taker].remove(j)
                    bins[giver].append(j)
                gain = sum(sizes[i] for i in out) - sum(sizes[j] for j in back)
                fill[giver] -= gain
                fill[taker] += gain
                better = True
                if not bins[giver] or tries <= 0:
                    break
        alive -= not bins[giver]
    return [b for b in bins if b]


def _exchange(give: list[int], take: list[int], sizes: list[int], room: int) -> tuple[list[int], list[int]] | None:
    """The exchange that fills the taker most: items from the giver, items back."""
    best, pick = 0, None
    for i in give:
        s = sizes[i]
        if best < s <= room:
            best, pick = s, ([i], [])
    if best == room:
        return pick
    small = sorted(take, key=lambda j: sizes[j])[:SMALL]
    for i in give:
        for j in small:
            gain = sizes[i] - sizes[j]
            if best < gain <= room:
                best, pick = gain, ([i], [j])
    if best == room:
        return pick
    few = sorted(give, key=lambda i: -sizes[i])[:LARGE]
    for x, i in enumerate(few):
        for k in few[x + 1 :]:
            both = sizes[i] + sizes[k]
            for j in small:
                gain = both - sizes[j]
                if best < gain <= room:
                    best, pick = gain, ([i, k], [j])
    for i in few:
        for x, j in enumerate(small[:PAIRED]):
            for k in small[x + 1 : PAIRED]:
                gain = sizes[i] - sizes[j] - sizes[k]
                if best < gain <= room:
                    best, pick = gain, ([i], [j, k])
    return pick


def _packer(size_of: dict[str, int], columns: list[str], turn: int, last: bool):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "piece_no"], ignore_index=True)
        tier, no = frame["tier"].iloc[0], int(frame["pack_group"].iloc[0])
        sizes, capacity = frame["tokens"].tolist(), size_of[tier]
        bins = local_search(best_fit(sizes, capacity), sizes, capacity)
        name, fill = [None] * len(sizes), [0] * len(sizes)
        for b, inside in enumerate(bins):
            total = sum(sizes[i] for i in inside)
            if last or total >= FULL * capacity:
                for i in inside:
                    name[i], fill[i] = f"{tier}-{turn}-{no}-{b}", total
        frame["container"], frame["container_tokens"] = name, fill
        return frame[[*columns, "container", "container_tokens"]]

    return run


def pack(items: DataFrame, capacities: DataFrame, group: int = GROUP) -> DataFrame:
    """tier, doc_id, piece_no, n_pieces, tokens, container, container_tokens.

    items: doc_id, tokens. capacities: tier, capacity_tokens (a table of a few rows; null and non-positive capacities
    are left out). Items without tokens are left out. An item over the capacity is cut into pieces of the capacity and
    a rest; repeated sizes and ties are ordered by id. An empty table gives an empty result.
    """
    spark = items.sparkSession
    tiers = sorted((r[0], r[1]) for r in capacities.where("capacity_tokens > 0 and tier is not null").select("tier", "capacity_tokens").distinct().limit(1000).collect())
    size_of = dict(tiers)
    out = "tier string, doc_id bigint, piece_no int, n_pieces int, tokens bigint, container string, container_tokens bigint"
    if not tiers:
        return spark.createDataFrame([], out)
    table = F.array(*[F.struct(F.lit(t).alias("tier"), F.lit(c).cast("bigint").alias("cap")) for t, c in tiers])
    each = items.where("tokens > 0").select("doc_id", F.col("tokens").alias("whole"), F.explode(table).alias("t")).select("doc_id", "whole", "t.tier", "t.cap")
    pieces = each.withColumn("n_pieces", F.ceil(F.col("whole") / F.col("cap")).cast("int")).select("tier", "cap", "doc_id", "n_pieces", F.explode(F.sequence(F.lit(0), F.col("n_pieces") - 1)).alias("piece_no"), "whole")
    pieces = pieces.select("tier", "cap", "doc_id", "piece_no", "n_pieces", F.least("cap", F.col("whole") - F.col("piece_no") * F.col("cap")).alias("tokens"))
    full = F.col("tokens") == F.col("cap")
    columns = ["tier", "doc_id", "piece_no", "n_pieces", "tokens"]
    done = pieces.where(full).select(*columns, F.concat_ws("-", "tier", F.lit("own"), "doc_id", "piece_no").alias("container"), F.col("tokens").alias("container_tokens"))
    left, parts = durable(pieces.where(~full).select(*columns)), [done]
    most = left.groupBy("tier").count().agg(F.max("count")).first()[0] or 0
    turn, stuck = 0, False
    while most:
        groups = -(-most // group)
        last = stuck or groups == 1
        salted = left.withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "piece_no", F.lit(turn)), F.lit(groups)).cast("int"))
        packed = durable(salted.groupBy("tier", "pack_group").applyInPandas(_packer(size_of, columns, turn, last), out))
        parts.append(packed.where("container is not null"))
        if last:
            break
        left = packed.where("container is null").select(*columns)
        most = left.groupBy("tier").count().agg(F.max("count")).first()[0] or 0
        stuck = -(-most // group) >= groups  # too little was closed to save a group: another round would not either
        turn += 1
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole
