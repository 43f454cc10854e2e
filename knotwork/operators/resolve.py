"""Mentions resolved against a registry: numeric instances, exact alias, fuzzy candidates, negative rules, decision, adjudication."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotwork.functions.readable import match_key
from knotwork.functions.sizes import small_side
from knotwork.operators import instances as inst
from knotwork.operators.instances import CONDITIONS, METRICS
from knotwork.session import durable

REGISTRY_ROWS = 50_000  # names of the registry that one task's fuzzy search holds; longer registries are searched shard by shard
AUTO, REVIEW = 95.0, 85.0
# Types that are looked up under a broader one.
BROADER = {"SPECIES": "ACTIVE_SPECIES", "ADDITIVE": "ACTIVE_SPECIES", "PERFORMANCE_METRIC": "METRIC", "OPERATING_CONDITION": "CONDITION", "MECHANISM": "DEGRADATION"}
# Terms that name no entity by themselves.
GENERIC_TERMS = ["electrode", "membrane", "electrolyte", "additive", "active species", "vanadium ions", "carbon electrode", "carbon felt", "flow battery", "efficiency", "resistance", "concentration", "current density", "temperature", "system", "material", "metric", "condition", "flow rate"]


@dataclass(frozen=True)
class Rules:
    """What must not be merged: generic terms, pairs (left, right, reason) of ids or names, groups of ids of high risk."""

    generic: tuple[str, ...] = tuple(GENERIC_TERMS)
    pairs: tuple[tuple[str, str, str], ...] = ()
    groups: tuple[tuple[str, ...], ...] = ()


def registry(entities: DataFrame) -> DataFrame:
    """canonical_id, entity_type, semantic_group, parent_id, key, place: one row for each distinct key of the name and aliases."""
    every = F.array_union(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>")))
    return entities.select("canonical_id", "entity_type", "semantic_group", "parent_id", F.col("entity_no").alias("place"), F.explode(F.array_distinct(F.transform(every, match_key))).alias("key")).where("key <> ''")


def _wide(kind: Column) -> Column:
    """The type a type is looked up under: its broader one, else itself."""
    upper = F.upper(kind)
    return F.coalesce(*[F.when(upper == a, b) for a, b in BROADER.items()], kind)


def exact(mentions: DataFrame, names: DataFrame) -> DataFrame:
    """mention_id, canonical_id: the registry's entry of the mention's own type, else of the broader type; the first entry wins.

    A mention without a type meets the whole registry, types in the order of their names.
    """
    keyed = mentions.where("name is not null").select("mention_id", match_key(F.col("name")).alias("key"), F.upper(F.when(F.col("entity_type") != "", F.col("entity_type"))).alias("entity_type"))
    entries = small_side(names.select("key", "entity_type", "canonical_id", "place"))
    typed = keyed.where("entity_type is not null").select("mention_id", "key", F.posexplode(F.array_distinct(F.array("entity_type", _wide(F.col("entity_type"))))).alias("priority", "entity_type")).join(entries, ["key", "entity_type"])
    open_type = keyed.where("entity_type is null").select("mention_id", "key", F.lit(2).alias("priority")).join(entries, "key")
    return typed.unionByName(open_type).groupBy("mention_id").agg(F.min_by("canonical_id", F.struct("priority", "entity_type", "place")).alias("canonical_id"))


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    if not a or not b:
        return 0
    at: dict[str, int] = {}
    for i, ch in enumerate(a):
        at[ch] = at.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & at.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - bin(row).count("1")


def ratio(a: str, b: str) -> float:
    return 100.0 * 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter text with a window of its length in the longer."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0.0 if b else 100.0
    if a in b:
        return 100.0
    return max(ratio(a, b[max(0, i) : i + len(a)]) for i in range(1 - len(a), len(b)))


def token_set_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    both, left, right = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not left or not right):
        return 100.0
    one, two = f"{both} {left}".strip(), f"{both} {right}".strip()
    found = [ratio(one, two)]
    if both:
        found += [ratio(both, one), ratio(both, two)]
    return max(found)


FUZZY = "name string, entity_type string, canonical_id string, place bigint, score double, ratio double, token_set double, length_ratio double"


def _search(rows: list[tuple], k: int):
    by_type: dict[str, list] = {}
    for kind, canonical_id, place, entry in rows:
        by_type.setdefault(kind, []).append((canonical_id, place, entry))
    whole = [entry for held in by_type.values() for entry in held]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, kind, key, wide in batch.itertuples(index=False, name=None):
                best: dict[str, tuple] = {}
                asked = by_type.get(wide, ()) if kind else whole
                first = [(max(p := ratio(key, entry), t := token_set_ratio(key, entry)), p, t, canonical_id, place, entry) for canonical_id, place, entry in asked]
                for least, plain, tokens, canonical_id, place, entry in sorted(first, key=lambda x: (-x[0], x[4])):
                    held = sorted((v[0] for v in best.values()), reverse=True)
                    shorter, common = min(len(key), len(entry)), plain * (len(key) + len(entry)) / 200
                    # No window has more in common than the whole; skip the windows where they cannot change the k best.
                    most = 200 * common / (shorter + common) if common else 0.0
                    worth = most > least and not (len(held) >= k and most < held[k - 1])
                    score = round(max(least, partial_ratio(key, entry)) if worth else least, 4)
                    if canonical_id not in best or score > best[canonical_id][0]:
                        best[canonical_id] = (score, -place, round(plain, 4), round(tokens, 4), round(shorter / max(1, len(key), len(entry)), 4))
                top = sorted(best.items(), key=lambda x: (-x[1][0], -x[1][1]))[:k]
                out += [(name, kind, c, -v[1], v[0], v[2], v[3], v[4]) for c, v in top]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in FUZZY.split(", ")])

    return run


def fuzzy(mentions: DataFrame, entities: DataFrame, k: int = 5) -> DataFrame:
    """name, entity_type, rank, canonical_id, score, ratio, token_set, length_ratio: the k best entries of the mention's (broader) type for each distinct mention, of the whole registry for one without a type.

    Matching keys are compared. A registry of up to REGISTRY_ROWS names is held in each task; a longer one is searched
    in shards of that size, whose k best are ranked again.
    """
    names = registry(entities)
    total = names.count()
    shards = max(1, -(-total // REGISTRY_ROWS))
    asked = mentions.where("name is not null").select("name", "entity_type").distinct().select("name", "entity_type", match_key(F.col("name")).alias("key"), _wide(F.col("entity_type")).alias("wide"))
    asked = durable(asked.repartition(2 * entities.sparkSession.sparkContext.defaultParallelism))
    found = None
    for shard in range(shards):
        part = names if shards == 1 else names.where(F.pmod(F.xxhash64("canonical_id"), F.lit(shards)) == shard)
        rows = [tuple(r) for r in part.select("entity_type", "canonical_id", "place", "key").collect()]
        hits = asked.mapInPandas(_search(rows, k), FUZZY)
        found = hits if found is None else found.unionByName(hits)
    order = Window.partitionBy("name", "entity_type").orderBy(F.desc("score"), "place")
    return found.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k).drop("place")


def blocked(pairs: DataFrame, names: DataFrame, rules: Rules | list[str]) -> DataFrame:
    """pairs (name, canonical_id) with `reason` or null: negative rules in order.

    A pair of the rules' list; a mention that by its exact name is another member of a group of high risk, or of the
    candidate's family in the registry; a generic term; a composite (with / or @) that contains one of the candidate's
    names: these must not be merged. `rules` may be a list of generic terms only.
    """
    rules = rules if isinstance(rules, Rules) else Rules(generic=tuple(rules))
    spark = pairs.sparkSession
    keyed = pairs.select("name", "canonical_id", match_key(F.col("name")).alias("key")).distinct()
    family = small_side(names.groupBy("canonical_id").agg(F.first("parent_id").alias("family"), F.collect_set("key").alias("keys")))
    own = small_side(names.groupBy("key").agg(F.min_by("canonical_id", "place").alias("exact_id"), F.min_by("parent_id", "place").alias("exact_family")))
    rows = keyed.join(family, "canonical_id", "left").join(own, "key", "left")
    both = [(left, right, reason, n) for n, (left, right, reason) in enumerate(rules.pairs)]
    both += [(right, left, reason, n) for left, right, reason, n in both]
    listed = spark.createDataFrame(both, "canonical_id string, side string, pair_reason string, n int")
    held_names = names.select(F.col("canonical_id").alias("side"), F.col("key").alias("side_key"))
    sides = listed.join(held_names, "side", "left").select("canonical_id", F.coalesce("side_key", match_key(F.col("side"))).alias("key"), "pair_reason", "n").groupBy("canonical_id", "key").agg(F.min_by("pair_reason", "n").alias("pair_reason"))
    rows = rows.join(small_side(sides), ["canonical_id", "key"], "left")
    members = spark.createDataFrame([(c, g) for g, ids in enumerate(rules.groups) for c in ids], "member string, g int").groupBy("member").agg(F.collect_set("g").alias("groups"))
    rows = rows.join(small_side(members.select(F.col("member").alias("canonical_id"), F.col("groups").alias("own_groups"))), "canonical_id", "left").join(small_side(members.select(F.col("member").alias("exact_id"), F.col("groups").alias("exact_groups"))), "exact_id", "left")
    held = F.coalesce(F.array_contains("keys", F.col("key")), F.lit(False))
    related = F.coalesce(F.col("exact_family") == F.col("family"), F.lit(False)) | F.coalesce(F.arrays_overlap("own_groups", "exact_groups"), F.lit(False))
    sibling = related & (F.col("exact_id") != F.col("canonical_id"))
    composite = F.col("key").rlike("[/@]") & ~held & F.exists("keys", lambda k: (k != "") & F.contains(F.col("key"), k))
    generic = F.col("key").isin(*_generic_keys(rules)) if rules.generic else F.lit(False)
    reason = F.coalesce("pair_reason", F.when(sibling, "high_risk_group").when(generic & ~held & F.col("keys").isNotNull(), "generic_term").when(composite, "component_or_variant"))
    return rows.select("name", "canonical_id", reason.alias("reason"))


def _generic_keys(rules: Rules) -> list[str]:
    """Generic terms are plain words: their keys are the words without blanks."""
    return ["".join(t.lower().split()) for t in rules.generic]


CANDIDATE = "canonical_id", "score", "ratio", "token_set", "length_ratio"


def cascade(mentions: DataFrame, entities: DataFrame, rules: Rules | list[str], auto: float = AUTO, review: float = REVIEW) -> DataFrame:
    """mention_id, decision, canonical_id, node_id, method, confidence, semantic_group, candidates, blocked_reason, need_review, value, low, high, unit.

    In order: a numeric instance of a metric or condition; an exact alias, unless a negative rule blocks it; the best of
    five fuzzy candidates: under the review score a new entity, blocked by a rule for review, merged if the scores, the
    lengths, the absence of digits and the semantic groups allow it, else for review. canonical_id is null for what the
    registry does not hold; node_id names it in any case (unresolved:... for review). Empty names become new entities.
    """
    rules = rules if isinstance(rules, Rules) else Rules(generic=tuple(rules))
    names = durable(registry(entities))
    measured = inst.instances(mentions)
    rest = mentions.join(measured.select("mention_id"), "mention_id", "left_anti").select("mention_id", F.trim("name").alias("name"), F.when(F.col("entity_type") != "", F.col("entity_type")).alias("entity_type"))
    found = durable(exact(rest, names))
    open_rows = rest.join(found, "mention_id", "left_anti").where("name <> ''")
    groups = small_side(entities.select("canonical_id", F.col("semantic_group").alias("group")))
    ranked = durable(fuzzy(open_rows, entities, 5))
    near = ranked.groupBy("name", "entity_type").agg(F.array_sort(F.collect_list(F.struct("rank", *CANDIDATE))).alias("c"))  # at most five entries
    near = near.select(F.col("name").alias("asked"), F.col("entity_type").alias("asked_type"), F.transform("c", lambda x: F.struct(*[x[c].alias(c) for c in CANDIDATE])).alias("candidates"))
    first = rest.join(found.withColumnRenamed("canonical_id", "exact_id"), "mention_id", "left").join(near, (F.col("name") == F.col("asked")) & F.col("entity_type").eqNullSafe(F.col("asked_type")), "left").drop("asked", "asked_type")
    first = durable(first.withColumn("target", F.coalesce("exact_id", F.get("candidates", F.lit(0)).canonical_id)))
    ruled = blocked(first.where("target is not null").select("name", F.col("target").alias("canonical_id")), names, rules).select(F.col("name").alias("asked"), F.col("canonical_id").alias("asked_id"), "reason")
    rows = first.join(ruled, (F.col("name") == F.col("asked")) & (F.col("target") == F.col("asked_id")), "left").join(groups, F.col("target") == F.col("canonical_id"), "left").drop("canonical_id", "asked", "asked_id")
    rows = inst.with_forms(rows, F.col("name"), "n")
    rows = durable(rows.withColumns({"mention_group": inst.group_of(inst.views("n"), F.col("entity_type")), "generic": F.col("n_key").isin(*_generic_keys(rules)) if rules.generic else F.lit(False), "fresh": inst.new_id(F.coalesce("entity_type", F.lit("UNKNOWN")), F.col("name")), "words": inst.new_key(F.col("name"))}))
    top = F.get("candidates", F.lit(0))
    clash = (F.col("group").isNotNull() & F.col("mention_group").isNotNull() & (F.col("group") != F.col("mention_group"))) | (F.upper("entity_type").isin(*METRICS, *CONDITIONS) & (F.col("group").isNull() | F.col("mention_group").isNull()))
    free = (top.score >= auto) & (top.ratio >= 97) & (top.token_set >= 95) & (top.length_ratio >= 0.75) & ~F.col("name").rlike("[0-9]") & ~F.col("generic") & ~F.coalesce(clash, F.lit(False))
    is_exact, stopped = F.col("exact_id").isNotNull(), F.col("reason").isNotNull()
    decision = F.when(is_exact & ~stopped, "MERGE").when(is_exact, "NEED_REVIEW").when(top.score.isNull() | (top.score < review), "CREATE_NEW").when(stopped, "NEED_REVIEW").when(free, "MERGE").otherwise("NEED_REVIEW")
    rows = rows.withColumn("decision", decision)
    merged, in_review = F.col("decision") == "MERGE", F.col("decision") == "NEED_REVIEW"
    judged = rows.select(
        "mention_id", "decision", F.when(merged, F.col("target")).alias("canonical_id"), F.when(merged, F.col("target")).when(in_review, F.concat(F.lit("unresolved:"), "words")).otherwise(F.col("fresh")).alias("node_id"),
        F.when(merged & is_exact, "exact_alias_match").when(merged, "fuzzy_auto_match").when(in_review, "need_review").otherwise("create_new").alias("method"),
        F.when(merged & is_exact, 1.0).when(merged, F.round(F.least(top.ratio, top.token_set) / 100, 4)).when(in_review & ~is_exact, F.round(top.score / 100, 4)).otherwise(0.0).alias("confidence"),
        F.when(merged, F.col("group")).otherwise(F.col("mention_group")).alias("semantic_group"), F.when(is_exact, F.lit(None)).otherwise(F.col("candidates")).alias("candidates"), F.when(in_review, F.col("reason")).alias("blocked_reason"), in_review.alias("need_review"),
        *[F.lit(None).cast(t).alias(c) for c, t in (("value", "double"), ("low", "double"), ("high", "double"), ("unit", "string"))],
    )
    counted = measured.select("mention_id", F.lit("MERGE").alias("decision"), "canonical_id", "node_id", "method", F.lit(1.0).alias("confidence"), F.col("grp").alias("semantic_group"), F.lit(None).cast(judged.schema["candidates"].dataType).alias("candidates"), F.lit(None).cast("string").alias("blocked_reason"), F.lit(False).alias("need_review"), "value", "low", "high", "unit")
    return judged.unionByName(counted)


RULING = "mention_id bigint, ruling string, target string, sure double, review boolean"


def adjudicate(judged: DataFrame, mentions: DataFrame, entities: DataFrame, rules: Rules | list[str], provider, schema: str = RULING) -> DataFrame:
    """Rows in need of review that have candidates and no blocking rule put to a provider; others keep their decision.

    The provider maps batches of pandas frames (mention_id, name, entity_type, candidates) to RULING. A merge holds only
    if its target is among the candidates, no negative rule forbids it and the semantic groups agree (both known for
    metrics and conditions); else the row stays in review with the reason. CREATE_NEW and the other ways of keeping a
    mention apart are taken as they are; anything else keeps the row in review. Without a reply nothing changes.
    """
    asked = durable(judged.where("decision = 'NEED_REVIEW' and size(candidates) > 0 and blocked_reason is null").join(mentions.select("mention_id", "name", "entity_type"), "mention_id"))
    said = asked.select("mention_id", "name", "entity_type", F.col("candidates.canonical_id").alias("candidates")).mapInPandas(provider, schema)
    rows = asked.join(said, "mention_id").withColumn("ruling", F.upper("ruling"))
    merges = (F.col("ruling") == "MERGE") & F.array_contains("candidates.canonical_id", F.col("target"))
    rows = durable(rows.withColumn("merges", F.coalesce(merges, F.lit(False))))
    ruled = blocked(rows.where("merges").select("name", F.col("target").alias("canonical_id")), registry(entities), rules).select(F.col("name").alias("asked"), F.col("canonical_id").alias("asked_id"), "reason")
    groups = small_side(entities.select(F.col("canonical_id").alias("held_id"), F.col("semantic_group").alias("held_group")))
    rows = rows.join(ruled, (F.col("name") == F.col("asked")) & (F.col("target") == F.col("asked_id")), "left").join(groups, F.col("target") == F.col("held_id"), "left")
    numeric = F.upper("entity_type").isin(*METRICS, *CONDITIONS)
    reason = F.when(F.col("reason").isNotNull(), F.col("reason")).when(F.col("held_group") != F.col("semantic_group"), "semantic_group_conflict").when(numeric & (F.col("held_group").isNull() | F.col("semantic_group").isNull()), "missing_semantic_group")
    rows = rows.withColumn("why", F.when(F.col("merges"), reason))
    ok = F.col("merges") & F.col("why").isNull()
    apart = F.col("ruling").isin("CREATE_NEW", "CREATE_VARIANT", "CREATE_COMPONENT_RELATION", "CREATE_PARENT_CHILD", "NO_MERGE")
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.when(F.col("sure") != 0, F.col("sure")), F.col("confidence"))))
    done = rows.select(
        "mention_id", F.when(ok, "MERGE").when(apart, F.col("ruling")).otherwise("NEED_REVIEW").alias("decision"), F.when(ok, F.col("target")).alias("canonical_id"),
        F.when(ok, F.col("target")).when(F.col("ruling") == "CREATE_NEW", inst.new_id(F.coalesce("entity_type", F.lit("UNKNOWN")), F.col("name"))).otherwise(F.col("node_id")).alias("node_id"),
        F.when(F.col("why").isNotNull(), F.col("method")).otherwise("llm_judged").alias("method"), F.when(ok | apart, sure).otherwise(F.col("confidence")).alias("confidence"), F.when(ok, F.col("held_group")).otherwise(F.col("semantic_group")).alias("semantic_group"), "candidates", F.col("why").alias("blocked_reason"),
        F.when(ok, F.coalesce("review", F.lit(False))).when(F.col("ruling") == "CREATE_NEW", False).when(apart, F.coalesce("review", F.lit(False))).otherwise(True).alias("need_review"), "value", "low", "high", "unit",
    )
    return judged.join(done.select("mention_id"), "mention_id", "left_anti").unionByName(done)


def concepts_only(judged: DataFrame) -> DataFrame:
    """Numeric instances collapsed to their concept: its id as node, no value or unit, the method marked."""
    is_instance = F.startswith("node_id", F.lit("measurement:")) | F.col("node_id").rlike(r"^condition:.*_\d")
    out = {"node_id": F.when(is_instance, F.col("canonical_id")).otherwise(F.col("node_id")), "method": F.when(is_instance, F.concat("method", F.lit("_concept_only"))).otherwise(F.col("method"))}
    return judged.withColumns(out | {c: F.when(~is_instance, F.col(c)) for c in ("value", "low", "high", "unit")})


def pipeline(mentions: DataFrame, entities: DataFrame, rules: Rules | list[str], provider=None, keep_instances: bool = True) -> DataFrame:
    """node_id, canonical_id, entity_type, method, confidence, need_review, raw_name, mentions, description, n, value, low, high, unit, parsed: mentions end to end, one row a node.

    Listed contact angles are taken apart, quantities parsed, mentions resolved (and adjudicated, if there is a
    provider), numeric instances kept or collapsed, rows grouped by node: the first mention gives the base, spellings
    and descriptions are joined in their order. If any step fails the mentions pass through unchanged, each its own
    node, with the method `passed_through`. mentions: mention_id, name, entity_type and any of value, value_min,
    value_max, unit, key_attribute, description.
    """
    text = "description" if "description" in mentions.columns else None
    try:
        rows = inst.angles(mentions)
        key = F.struct("mention_id", "pos")
        rows = durable(inst.enriched(rows.withColumns({"source_id": F.col("mention_id"), "mention_id": F.xxhash64(key)})))
        judged = cascade(rows, entities, rules)
        if provider is not None:
            judged = adjudicate(durable(judged), rows, entities, rules, provider)
        judged = judged if keep_instances else concepts_only(judged)
        whole = durable(judged.drop("unit", "value").join(rows.select("mention_id", "source_id", "pos", "name", "entity_type", "parsed", *([text] if text else [])), "mention_id").join(judged.select("mention_id", "unit", "value"), "mention_id"))
        order = F.struct("source_id", "pos")
        base = lambda c: F.min_by(c, order).alias(c)
        first = whole.groupBy("node_id").agg(*[base(c) for c in ("canonical_id", "entity_type", "method", "confidence", "need_review", "value", "low", "high", "unit", "parsed")], F.min_by("name", order).alias("raw_name"), F.count("*").alias("n"))
        # Each spelling and description counts once, before they are listed.
        listed = lambda c, sep: whole.where(F.trim(c) != "").groupBy("node_id", F.trim(c).alias("said")).agg(F.min(order).alias("at")).groupBy("node_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "said"))), lambda x: x["said"]), sep).alias(c))
        out = first.join(listed("name", " | ").withColumnRenamed("name", "mentions"), "node_id", "left")
        out = out.join(listed(text, " | "), "node_id", "left") if text else out.withColumn("description", F.lit(None).cast("string"))
        return durable(out.withColumn("error", F.lit(None).cast("string")))
    except Exception as e:  # noqa: BLE001
        none = lambda c, t="string": F.lit(None).cast(t).alias(c)
        parsed = inst.with_quantity(mentions.limit(0), F.lit("")).schema["parsed"].dataType.simpleString()
        return mentions.select(
            F.concat(F.lit("raw:"), F.coalesce("name", F.lit(""))).alias("node_id"), none("canonical_id"), "entity_type", F.lit("passed_through").alias("method"), F.lit(0.0).alias("confidence"), F.lit(True).alias("need_review"), none("value", "double"), none("low", "double"), none("high", "double"), none("unit"), none("parsed", parsed),
            F.col("name").alias("raw_name"), F.lit(1).cast("bigint").alias("n"), F.col("name").alias("mentions"), (F.col(text) if text else F.lit(None).cast("string")).alias("description"), F.lit(f"{type(e).__name__}: {e}"[:500]).alias("error"),
        )


def explode_values(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """keep, pos, value: one row a number of texts that list two or more separated by slashes."""
    listed = F.regexp_extract_all(F.regexp_extract(F.col(text), r"((?:[-+]?[0-9]+(?:\.[0-9]+)?\s*/\s*)+[-+]?[0-9]+(?:\.[0-9]+)?)", 1), F.lit(r"([-+]?[0-9]+(?:\.[0-9]+)?)"), F.lit(1))
    return df.withColumn("listed", listed).where(F.size("listed") >= 2).select(*keep, F.posexplode("listed").alias("pos", "value")).withColumn("value", F.col("value").cast("double"))


def chase(mapping: DataFrame, rounds: int = 20) -> DataFrame:
    """source, target: each source followed through the map until it ends or returns. The map's pointers are doubled, so n rounds follow 2^n steps."""
    from knotwork.session import durable

    at = mapping.select(F.col("source"), F.col("target")).dropDuplicates(["source"])
    for _ in range(rounds):
        step = at.select(F.col("source").alias("target"), F.col("target").alias("further"))
        moved = durable(at.join(step, "target", "left").select("source", F.when(F.col("further") == F.col("source"), F.col("target")).otherwise(F.coalesce("further", "target")).alias("to"), F.col("target").alias("was")))
        at = moved.select("source", F.col("to").alias("target"))
        if moved.where("to <> was").limit(1).count() == 0:
            break
    return at
