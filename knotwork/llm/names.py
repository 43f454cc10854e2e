"""Free-entered names mapped to a canonical list: a BK-tree over the entries under a true edit metric."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.functions.lookalike import fold_py
from knotwork.session import durable

UNRESOLVED = "UNRESOLVED"
TREE_ENTRIES = 20_000  # entries of one tree; longer lists are sharded
# Words that people set before or behind a name without meaning another thing.
BEFORE = "our|the|a|an|used|fresh|new|standard|commercial|pristine|as received|modified|bare|pure|fresh|untreated"
AFTER = "as received|supplier grade|sample|samples|new|etc|batch \\d+|lot \\d+|batch|lot|grade|commercial|used|fresh|standard"
ROMAN = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7}
_OXIDATION = re.compile(r"\(\s*(?:(i{1,3}|iv|v|vi{1,2})|\+?\s*(\d)\s*\+?)\s*\)|(?<![\w(])(?:(\d)\s?\+|\+\s?(\d))(?!\w)|(?<=[a-z]) (i{1,3}|iv|vi{0,2})(?= |$)")
_MARK = re.compile(r"(?:\bno\b\.?|\bnr\b\.?|\bnum(?:ber)?\b|#|n°)\s*(?=\d)")
_LEAD = re.compile(rf"^(?:{BEFORE})\s+(?=\S)")
_TAIL = re.compile(rf"[\s,;:.\-]+(?:{AFTER})[\s.]*$")


def distance(a: str, b: str, most: int = 1 << 30) -> int:
    """Levenshtein distance by bit-parallel columns (Myers); stops early with most + 1 where it must exceed `most`."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    if not a or not b:
        return len(a) or len(b)
    n = len(a)
    at: dict[str, int] = {}
    for i, ch in enumerate(a):
        at[ch] = at.get(ch, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, score = full, 0, n
    for j, ch in enumerate(b):
        eq = at.get(ch, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        right, left = down | ~(diagonal | up), up & diagonal
        if right & top:
            score += 1
        elif left & top:
            score -= 1
        if score - (len(b) - 1 - j) > most:
            return most + 1
        right = (right << 1 | 1) & full
        left = left << 1 & full
        up, down = left | (~(diagonal | right) & full), right & diagonal
    return score


class BKTree:
    """Entries by their distance to a parent entry; `within` visits only children the triangle inequality leaves open."""

    def __init__(self, words: list[str]):
        self.nodes: list[tuple[str, dict[int, int]]] = []
        for word in words:
            self._add(word)

    def _add(self, word: str) -> None:
        if not self.nodes:
            self.nodes.append((word, {}))
            return
        at = 0
        while True:
            here, children = self.nodes[at]
            d = distance(here, word)
            if d == 0:
                return
            if d not in children:
                children[d] = len(self.nodes)
                self.nodes.append((word, {}))
                return
            at = children[d]

    def within(self, word: str, most: int) -> list[tuple[int, str]]:
        """Every entry at most `most` edits away, with its distance."""
        found, todo = [], [0] if self.nodes else []
        while todo:
            here, children = self.nodes[todo.pop()]
            d = distance(here, word)
            if d <= most:
                found.append((d, here))
            todo += [at for edge, at in children.items() if d - most <= edge <= d + most]
        return found


def tidy(name: str) -> str:
    """Look-alikes and case folded, accents off, decorations off."""
    t = fold_py(name.upper()).lower()
    t = "".join(ch for ch in unicodedata.normalize("NFD", t) if unicodedata.category(ch) != "Mn")
    t = re.sub(r"[\"'`´“”‘’«»]", "", t)
    t = re.sub(r"_+|\s*[-–—‐‑−]\s*(?!\s*\d\s*\))", " ", t)
    t = re.sub(r"\(\s*(as received|supplier grade|sample|new|used|commercial)\s*\)", " ", t)
    t = re.sub(r"\s+", " ", t).strip(" .,;:!?*")
    while True:
        u = _LEAD.sub("", _TAIL.sub("", t)).strip(" .,;:!?*")
        if u == t or not u:
            return t
        t = u


def key(name: str) -> tuple[str, str]:
    """(words, guard): the guard holds numbers and oxidation states, which must agree exactly."""
    t, guard = name, []

    def oxidation(m: re.Match) -> str:
        roman, *digits = (m[1] or m[5]), m[2], m[3], m[4]
        guard.append(f"ox{ROMAN[roman] if roman else next(d for d in digits if d)}")
        return " "

    t = _OXIDATION.sub(oxidation, t)
    t = _MARK.sub(" ", t)
    guard += re.findall(r"\d+", t)
    t = re.sub(r"[\d()\[\]{}/,;:.+&#]+", " ", t)
    return re.sub(r"\s+", " ", t).strip(), " ".join(sorted(guard))


def readings(name: str) -> list[tuple[str, str]]:
    """The keys a typed name may stand for: the whole, and, with brackets, what is before and inside them."""
    t = tidy(name)
    out = [key(t)]
    if m := re.fullmatch(r"(.+?)\s*[(\[]([^()\[\]]{3,})[)\]]", t):
        out += [key(tidy(m[1])), key(tidy(m[2]))]
    return [k for k in dict.fromkeys(out) if k[0]]


def allowed(words: str) -> int:
    """Edits a name of this length may be away: codes and short words must agree, long names may hold two slips, a swap of letters counting two."""
    letters = len(words.replace(" ", ""))
    return 0 if letters < 6 else 1 if letters < 8 else 2 if letters < 10 else 3 if letters < 16 else 4


def alike(name: str, entry: str) -> bool:
    """Whether each word is near the entry's word in its place, so that a long common tail does not lend edits to the name before it."""
    a, b = name.split(" "), entry.split(" ")
    most = 4 if a[0] == b[0] else 3
    return len(a) != len(b) or all(distance(x, y, most) <= (2 if len(y) < 7 else most) or y.startswith(x) for x, y in zip(a, b))


def shortened(tail: str, whole: str) -> bool:
    """Whether `tail` abbreviates the words of `whole`: its words, in order, start like a word there and drop letters ("c paper", "fb", "batt")."""
    words, at = whole.split(), 0
    for part in tail.split():
        while at < len(words):
            if len(part) > 4 and distance(part, words[at], 2) <= 1 + (len(part) > 6):
                at += 1
                break
            if words[at][0] == part[0]:
                text = "".join(words[at:])
                spot = 0
                for ch in part:
                    spot = text.find(ch, spot) + 1
                    if not spot:
                        break
                if spot:
                    while at < len(words) and spot > 0:
                        spot -= len(words[at])
                        at += 1
                    break
            at += 1
        else:
            return False
    return bool(tail)


class Matcher:
    """One shard of the list: a tree over whole keys and one over the first words of names of several words."""

    def __init__(self, entries: list[tuple[str, str]]):
        self.by_key: dict[str, dict[str, set[str]]] = {}
        self.by_head: dict[str, list[tuple[str, str, str]]] = {}
        for canonical_id, name in entries:
            words, guard = key(tidy(name))
            if not words:
                continue
            self.by_key.setdefault(words, {}).setdefault(guard, set()).add(canonical_id)
            head, _, rest = words.partition(" ")
            if rest and len(head) > 6:
                self.by_head.setdefault(head, []).append((rest, guard, canonical_id))
        self.keys, self.heads = BKTree(sorted(self.by_key)), BKTree(sorted(self.by_head))
        self.seen: dict[tuple[str, str], tuple[int, frozenset[str]] | None] = {}
        self.short: set[tuple[str, str]] = set()  # keys whose hits are shortened names
        self.guards = {guard for held in self.by_key.values() for guard in held}

    def best(self, words: str, guard: str) -> tuple[int, frozenset[str]] | None:
        """The least distance and the entries at it, among those with the same numbers and oxidation state."""
        if guard not in self.guards:
            return None
        if (words, guard) not in self.seen:
            hits: dict[int, set[str]] = {}
            for d, entry in self.keys.within(words, allowed(words)):
                if (ids := self.by_key[entry].get(guard)) and alike(words, entry):
                    hits.setdefault(d, set()).update(ids)
            head, _, rest = words.partition(" ")
            if not hits and rest and len(head) > 6:
                self.short.add((words, guard))
                for d, entry in self.heads.within(head, allowed(head)):
                    for whole, own, canonical_id in self.by_head[entry]:
                        if own == guard and shortened(rest, whole):
                            hits.setdefault(d + 1, set()).add(canonical_id)
            self.seen[words, guard] = (min(hits), frozenset(hits[min(hits)])) if hits else None
        return self.seen[words, guard]

    def run(self, names: pd.Series) -> pd.DataFrame:
        out = []
        for name in names:
            hits = [h for k in readings(name) if (h := self.best(*k))]
            if hits:
                least = min(d for d, _ in hits)
                out += [(name, least, i) for i in sorted(frozenset().union(*(ids for d, ids in hits if d == least)))]
        return pd.DataFrame(out, columns=["name", "edits", "canonical_id"])

    def parts(self, names: pd.Series) -> pd.DataFrame:
        """The hits of each reading apart, for a merge with those of other shards."""
        out = [(name, n, k in self.short, h[0], i) for name in names for n, k in enumerate(readings(name)) if (h := self.best(*k)) for i in sorted(h[1])]
        return pd.DataFrame(out, columns=["name", "reading", "short", "edits", "canonical_id"])


MATCHES = "name string, edits int, canonical_id string"
PARTS = "name string, reading int, short boolean, edits int, canonical_id string"


def _keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        keys = [key(tidy(entry)) for entry in batch["entry"]]
        yield batch.assign(words=[k[0] for k in keys], guard=[k[1] for k in keys])


def _against(listed: list[tuple[str, str]]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(listed)
        for batch in batches:
            yield matcher.parts(batch["name"])

    return run


def resolve_names(names: DataFrame, entries: DataFrame, tree_entries: int = TREE_ENTRIES) -> DataFrame:
    """name, canonical_id (or UNRESOLVED), edits for each distinct name. entries: canonical_id, entry (one row a spelling).

    A list of at most `tree_entries` spellings is one tree in every task. A longer one is sharded in the order of
    numbers and words; the names stream past one shard's tree after the other, skipping those without an entry of their
    number and oxidation state, and the shards' winners merge as in one tree: for each reading whole names before
    shortened ones, then by least distance. Names at the same distance from entries of different ids are UNRESOLVED, as
    are names whose number or oxidation state no entry has. Null names give no row; repeated names one. An empty list
    leaves every name UNRESOLVED.
    """
    distinct = names.where("name is not null").select("name").distinct()
    spelled = entries.where("canonical_id is not null and entry is not null").select("canonical_id", "entry").distinct()
    rows = spelled.limit(tree_entries + 1).collect()
    if len(rows) <= tree_entries:
        listed = sorted((r[0], r[1]) for r in rows)

        def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            matcher = Matcher(listed)
            for batch in batches:
                yield matcher.run(batch["name"])

        # The search costs more than its few bytes tell, so the names are spread over all cores.
        hits = distinct.repartition(2 * names.sparkSession.sparkContext.defaultParallelism).mapInPandas(one, MATCHES)
    else:
        shards = -(-spelled.count() // tree_entries)
        ranged = durable(spelled.mapInPandas(_keyed, "canonical_id string, entry string, words string, guard string").repartitionByRange(shards, "guard", "words", "entry").withColumn("shard", F.spark_partition_id()))
        asked = durable(distinct.repartition(2 * names.sparkSession.sparkContext.defaultParallelism))
        parts = None
        for shard in range(shards):
            held = [(r[0], r[1]) for r in ranged.where(F.col("shard") == shard).select("canonical_id", "entry").collect()]
            if held:
                hits = asked.mapInPandas(_against(held), PARTS)
                parts = hits if parts is None else parts.unionByName(hits)
        first, last = F.struct("short", "edits", "canonical_id"), F.struct(~F.col("short"), -F.col("edits"), "canonical_id")
        ends = parts.groupBy("name", "reading").agg(F.min(first).alias("first"), F.max_by("canonical_id", last).alias("last"))
        hits = ends.select("name", "first.edits", F.explode(F.array("first.canonical_id", "last")).alias("canonical_id"))
    least = hits.groupBy("name").agg(F.min(F.struct("edits", "canonical_id")).alias("best"), F.min_by("canonical_id", F.struct("edits", "canonical_id")).alias("low"), F.max_by("canonical_id", F.struct(-F.col("edits"), "canonical_id")).alias("high"))
    won = least.select("name", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.lit(UNRESOLVED)).alias("canonical_id"), F.col("best.edits").alias("edits"))
    return distinct.join(won, "name", "left").select("name", F.coalesce("canonical_id", F.lit(UNRESOLVED)).alias("canonical_id"), "edits")


BLANK = r"^[\s\p{Z}\p{Cf}\p{Cc}]*$"


def typed_names(alias_match: DataFrame, edges: DataFrame) -> DataFrame:
    """src, row_id, pos, name: every name of the two tables that is not null or blank; redelivered rows count once."""
    single = alias_match.where("canonical_name is not null").select(F.lit("alias_match").alias("src"), F.col("match_id").alias("row_id"), F.lit(0).alias("pos"), F.col("canonical_name").alias("name")).dropDuplicates(["row_id"])
    many = edges.where("size(unresolved_vertices) > 0").select("edge_id", "unresolved_vertices").dropDuplicates(["edge_id"])
    listed = many.select(F.lit("rewritten_hyperedge").alias("src"), F.col("edge_id").alias("row_id"), F.posexplode("unresolved_vertices").alias("pos", "name"))
    return single.unionByName(listed).where(F.col("name").isNotNull() & ~F.col("name").rlike(BLANK))


def spellings(canonical: DataFrame) -> DataFrame:
    """canonical_id, entry: the name and the aliases of each entry."""
    every = F.array_union(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>")))
    return canonical.select("canonical_id", F.explode(every).alias("entry")).where("entry is not null")
