"""Queries of reference resolution, validation and the resolve cascade, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from knotwork.functions import text as x
from knotwork.functions.readable import readable
from knotwork.operators import instances as i
from knotwork.operators import references as r
from knotwork.operators import resolve as s
from knotwork.plans import bindings as b
from knotwork.plans import name_sql as n
from knotwork.plans.bindings import EDGES, HYPEREDGES, VERTICES
from knotwork.plans.text_queries import _KEY, _NORMAL
from knotwork.session import table

RULES = s.Rules()  # the generic terms; families of the registry stand in for groups of high risk
GENERIC = s._generic_keys(RULES)


def _entities(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "canonical_entity")


def _names(spark: SparkSession, d: str) -> DataFrame:
    return _entities(spark, d).select("canonical_id", F.array_union(F.array("canonical_name"), "aliases").alias("names"), F.col("entity_type").isin("CONDITION", "METRIC").alias("numeric"))


def _relations(spark: SparkSession, d: str) -> DataFrame:
    return b.hyperedges(spark, d).where(F.size("raw_vertices") > 0).select(F.col("ord").alias("edge_id"), F.array_compact("raw_vertices").alias("vertices"))


def _mentions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "alias_match").select(F.col("match_id").alias("mention_id"), F.col("canonical_name").alias("name"), "entity_type").distinct()


def _typed(spark: SparkSession, d: str) -> DataFrame:
    return _mentions(spark, d).where("entity_type is not null")


def ref_normalize(spark: SparkSession, d: str) -> DataFrame:
    return _mentions(spark, d).select("mention_id", x.edge_reference(F.col("name")).alias("ref"), x.bare_reference(F.col("name")).alias("bare"))


def ref_lookup(spark: SparkSession, d: str) -> DataFrame:
    return r.lookup(_names(spark, d), "canonical_id", "names")


def rel_filter_low(spark: SparkSession, d: str) -> DataFrame:
    return r.known_relations(_relations(spark, d).where(F.size("vertices") == 2), r.lookup(_names(spark, d), "canonical_id", "names"), "canonical_id", 2)


def rel_filter_high(spark: SparkSession, d: str) -> DataFrame:
    return r.known_relations(_relations(spark, d).where(F.size("vertices") > 2), r.lookup(_names(spark, d), "canonical_id", "names"), "canonical_id", 3)


def efu_repair(spark: SparkSession, d: str) -> DataFrame:
    edges = b.hyperedges(spark, d).select(F.col("ord").alias("edge_id"), "source_id", "vertices")
    kinds = b.vertices(spark, d).select("vertex_id", "entity_type")
    return r.repair_edges(edges, kinds, "source_id", ["SYSTEM", "CONDITION", "METRIC"])


def unknown_summary(spark: SparkSession, d: str) -> DataFrame:
    return r.unknown_summary(b.hyperedges(spark, d), b.vertices(spark, d), "relation_type")


def top_unknown(spark: SparkSession, d: str) -> DataFrame:
    return r.top_unknown(b.hyperedges(spark, d), b.vertices(spark, d))


def validate_entities(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "parsed_quantity").dropDuplicates(["quantity_id"])
    return rows.select("quantity_id", r.entity_errors(["current_density", "temperature", "concentration", "time", "flow_rate", "voltage", "power_density", "efficiency", "pH"]).alias("errors"))


def validate_relations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "rewritten_hyperedge").dropDuplicates(["edge_id"]).select("edge_id", r.relation_errors().alias("errors"))


def validate_batch(spark: SparkSession, d: str) -> DataFrame:
    """Rows and errors of the batch: how many rows are valid and how often each error occurs."""
    rows = validate_relations(spark, d)
    return rows.select(F.explode_outer("errors").alias("error")).groupBy("error").agg(F.count("*").alias("n"))


def exact_alias(spark: SparkSession, d: str) -> DataFrame:
    """Mentions with a type, as the SQL has it; those without one are in exact_alias_all."""
    return s.exact(_typed(spark, d), s.registry(_entities(spark, d)))


def exact_alias_all(spark: SparkSession, d: str) -> DataFrame:
    return s.exact(_mentions(spark, d), s.registry(_entities(spark, d)))


def fuzzy_topk(spark: SparkSession, d: str) -> DataFrame:
    return s.fuzzy(_mentions(spark, d), _entities(spark, d))


def negative_rules(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct mention against the entry its row names by exact alias, and against that entry's family."""
    names = s.registry(_entities(spark, d))
    hit = _mentions(spark, d).join(s.exact(_typed(spark, d), names), "mention_id").select("name", "canonical_id").distinct()
    family = names.select("canonical_id", "parent_id").distinct()
    pairs = hit.join(family, "canonical_id").where("parent_id is not null").join(family.select(F.col("canonical_id").alias("other"), "parent_id"), "parent_id").select("name", F.col("other").alias("canonical_id"))
    return s.blocked(pairs, names, RULES)


def resolve_cascade(spark: SparkSession, d: str) -> DataFrame:
    return s.cascade(_mentions(spark, d), _entities(spark, d), RULES)


def norm_report(spark: SparkSession, d: str) -> DataFrame:
    """Mentions by decision and method with their share, the entities they end in and the twenty commonest open names of each."""
    judged = resolve_cascade(spark, d).join(_mentions(spark, d).select("mention_id", "name"), "mention_id")
    each = judged.where("need_review and name is not null").groupBy("decision", "method", "name").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("decision", "method").orderBy(F.desc("n"), "name"))
    top = each.withColumn("r", rank).where("r <= 20").groupBy("decision", "method").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "name"))), lambda v: v["name"]).alias("open_names"))
    total = judged.count()
    rows = judged.groupBy("decision", "method").agg(F.count("*").alias("n"), F.count_distinct("node_id").alias("entities"), F.count_if(F.col("blocked_reason").isNotNull()).alias("blocked"), F.count_if(F.col("need_review")).alias("in_review"))
    return rows.join(top, ["decision", "method"], "left").withColumn("ratio", F.round(F.col("n") / max(total, 1), 4)).withColumn("open_names", F.coalesce("open_names", F.array().cast("array<string>")))


def _merged(spark: SparkSession, d: str, found: DataFrame) -> DataFrame:
    hit = found.groupBy("canonical_id").agg(F.count("*").alias("n"))
    return hit.join(_entities(spark, d).select("canonical_id", "entity_type"), "canonical_id").groupBy("entity_type").agg(F.sum(F.col("n") - 1).alias("merged"), F.sum("n").alias("mentions"), F.round(F.sum(F.col("n") - 1) / F.sum("n"), 4).alias("ratio"))


def _by_node(spark: SparkSession, d: str, found: DataFrame) -> DataFrame:
    rows = _mentions(spark, d).join(found, "mention_id")
    first = rows.groupBy("canonical_id", "name").agg(F.min("mention_id").alias("at"))
    return first.groupBy("canonical_id").agg(F.min_by("name", "at").alias("base"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda v: v["name"]), " | ").alias("spellings"))


def merge_report(spark: SparkSession, d: str) -> DataFrame:
    """By type: mentions merged away (mentions less entities) by the exact aliases."""
    return _merged(spark, d, exact_alias(spark, d))


def merge_report_all(spark: SparkSession, d: str) -> DataFrame:
    return _merged(spark, d, exact_alias_all(spark, d))


def group_by_node(spark: SparkSession, d: str) -> DataFrame:
    """Mentions by the entity they resolve to: first spelling, distinct spellings in order of appearance."""
    return _by_node(spark, d, exact_alias(spark, d))


def group_by_node_all(spark: SparkSession, d: str) -> DataFrame:
    return _by_node(spark, d, exact_alias_all(spark, d))


def unit_parse(spark: SparkSession, d: str) -> DataFrame:
    """The quantity each text states, with its type as hint where one is given: type, operator, value or range, unit."""
    rows = table(spark, d, "parsed_quantity").select("quantity_id", "raw", "quantity_type").distinct()
    out = i.with_quantity(rows, F.col("raw"), F.replace(F.col("quantity_type"), F.lit("_"), F.lit(" ")))
    return out.where("parsed is not null").select("quantity_id", "parsed.*")


def text_readable(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "parsed_quantity").select("quantity_id", "raw").distinct().select("quantity_id", readable(F.col("raw")).alias("shown"))


def _signals(spark: SparkSession, d: str) -> DataFrame:
    """Mentions and descriptions as signal texts of metrics and conditions."""
    names = _mentions(spark, d).select(F.concat(F.lit("m"), F.col("mention_id").cast("string")).alias("id"), "name")
    said = b.hyperedges(spark, d).where("description is not null").select(F.concat(F.lit("e"), F.col("ord").cast("string")).alias("id"), F.col("description").alias("name"), "ord")
    # The data's own metrics are invented; the rules' words are given to a part of its texts.
    worded = said.select(F.concat("id", F.lit("w")).alias("id"), F.concat(F.element_at(F.array(*[F.lit(w) for w in _WORDS]), (F.col("ord") % len(_WORDS) + 1).cast("int")), F.lit(" of "), "name").alias("name"))
    return names.unionByName(said.drop("ord")).unionByName(worded)


_WORDS = ["CE = 97.2%", "average CE 80 % to VE 91 %", "energy efficiency of 74.8%", "IEC: 1.42 mmol/g", "contact angle 92.8 deg", "voltage loss by 0.14 V", "capacity retention 88 %", "120 mA cm-2", "vanadium at 1.6 mol / L", "Bi3+ 5 mmol/L concentration", "pH 3", "200 cycles", "40 °C", "ohmic resistance 0.3"]


def metric_detect(spark: SparkSession, d: str) -> DataFrame:
    """The metric each text names and the number it states for it."""
    rows = i.with_forms(_signals(spark, d), F.col("name"), "t")
    rows = rows.withColumn("metric", i.metric_of(i.views("t")).id)
    return rows.select("id", "metric", i.metric_value(F.col("metric"), F.col("t_shown")).alias("value"))


def numeric_instances(spark: SparkSession, d: str) -> DataFrame:
    """Quantities as mentions: those that state a number of a metric or condition become instances."""
    rows = table(spark, d, "parsed_quantity").where("quantity_type is not null").dropDuplicates(["quantity_id"]).select(F.col("quantity_id").alias("mention_id"), F.concat_ws(" ", F.replace("quantity_type", F.lit("_"), F.lit(" ")), "raw").alias("name"), F.lit("CONDITION").alias("entity_type"), "value", F.col("min_value").alias("value_min"), F.col("max_value").alias("value_max"), "unit")
    return i.instances(rows).select("mention_id", "canonical_id", "node_id", "method", "unit")


def multi_value_explode(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_partkey", F.concat(F.lit("contact angle "), F.col("p_size").cast("string"), F.lit("/"), (F.col("p_size") + 3).cast("string"), F.lit(" / 7.5 of "), "p_name").alias("text"))
    return s.explode_values(rows, "text", ["p_partkey"])


def condition_detect(spark: SparkSession, d: str) -> DataFrame:
    rows = i.with_forms(_signals(spark, d), F.col("name"), "t")
    return rows.select("id", i.condition_of(i.views("t")).id.alias("condition"))


def instance_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "parsed_quantity").where("value is not null and quantity_type is not null").select("quantity_id", "quantity_type", "value", "unit").distinct()
    return rows.select("quantity_id", F.concat_ws("_", F.concat(F.lit("condition:"), F.lower("quantity_type")), i.number_slug(F.col("value")), x.compared_unit_slug(F.col("unit"))).alias("node_id"))


def collapse_instances(spark: SparkSession, d: str) -> DataFrame:
    """Instances back to their concept: how many there are and their span."""
    return table(spark, d, "parsed_quantity").where("value is not null and quantity_type is not null").dropDuplicates(["quantity_id"]).groupBy(F.concat(F.lit("condition:"), F.lower("quantity_type")).alias("node_id")).agg(F.count("*").alias("instances"), F.min("value").alias("low"), F.max("value").alias("high"))


def new_entity_ids(spark: SparkSession, d: str) -> DataFrame:
    return _mentions(spark, d).where("name is not null").select("mention_id", i.new_id(F.coalesce("entity_type", F.lit("UNKNOWN")), F.col("name")).alias("canonical_id"))


def semantic_groups(spark: SparkSession, d: str) -> DataFrame:
    """The semantic group of each mention by the ordered rules of its type."""
    rows = i.with_forms(_mentions(spark, d), F.col("name"), "t")
    return rows.select("mention_id", i.group_of(i.views("t"), F.col("entity_type")).alias("semantic_group"))


def equivalence_chase(spark: SparkSession, d: str) -> DataFrame:
    """Parts mapped to half their number while that is even, followed to the end."""
    rows = table(spark, d, "part").where("p_partkey % 2 = 0 and p_partkey > 0").select(F.col("p_partkey").alias("source"), (F.col("p_partkey") / 2).cast("bigint").alias("target"))
    return s.chase(rows)


def norm_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Mentions end to end, one row a node."""
    out = s.pipeline(_mentions(spark, d), _entities(spark, d), RULES)
    return out.select("node_id", "canonical_id", "method", "need_review", "raw_name", "mentions", "n")


QUERIES = {f.__name__: f for f in (ref_normalize, ref_lookup, rel_filter_low, rel_filter_high, efu_repair, unknown_summary, top_unknown, validate_entities, validate_relations, validate_batch, exact_alias, exact_alias_all, fuzzy_topk, negative_rules, resolve_cascade, norm_report, merge_report, merge_report_all, group_by_node, group_by_node_all, unit_parse, text_readable, numeric_instances, multi_value_explode, metric_detect, condition_detect, instance_ids, collapse_instances, new_entity_ids, semantic_groups, equivalence_chase, norm_pipeline)}

_M = "m AS (SELECT DISTINCT match_id AS mention_id, canonical_name AS name, entity_type FROM alias_match)"
_REF = "regexp_replace(replace(lower(translate({}, '⁰¹²³⁴⁵⁶⁷⁸⁹₀₁₂₃₄₅₆₇₈₉⁺⁻₊₋', '01234567890123456789+-+-')), '[u+208d]', 'd'), '[\\s_–—−-]', '', 'g')"
_BARE = "regexp_replace(" + _REF.format("regexp_replace({}, '[-+]?[0-9]+(?:\\.[0-9]+)?\\s*(?:%|°c|ma/cm2|mol/l|[a-z]{{1,2}}\\b)?', '', 'g')") + ", '[,;:=]', '', 'g')"
_N = "n AS (SELECT DISTINCT canonical_id, unnest(list_concat([canonical_name], aliases)) AS name FROM canonical_entity)"
_LOOK = f"{_N}, k AS (SELECT key, min(canonical_id) AS canonical_id FROM (SELECT canonical_id, {_REF.format('name')} AS key FROM n) WHERE key <> '' GROUP BY key HAVING min(canonical_id) = max(canonical_id))"
_FILTER = """{look}, {he}, e AS (SELECT ord AS edge_id, list_filter(raw_vertices, lambda x: x IS NOT NULL) AS v FROM hyperedges WHERE len(raw_vertices) > 0),
    p AS (SELECT edge_id, unnest(v) AS name, generate_subscripts(v, 1) AS pos FROM e WHERE len(v) {test}), j AS (SELECT edge_id, pos, coalesce(k1.canonical_id, k2.canonical_id) AS t FROM p LEFT JOIN k k1 ON k1.key = {ref} LEFT JOIN k k2 ON k2.key = {bare}),
    f AS (SELECT edge_id, t, min(pos) AS pos FROM j WHERE t IS NOT NULL GROUP BY ALL), l AS (SELECT edge_id, list(t ORDER BY pos) AS vertices FROM f GROUP BY edge_id), o AS (SELECT edge_id, count(*) FILTER (t IS NULL) AS open FROM j GROUP BY edge_id)
    SELECT edge_id, coalesce(vertices, []) AS vertices, open = 0 AND len(coalesce(vertices, [])) >= {least} AS accepted FROM o LEFT JOIN l USING (edge_id)"""
_EXACT = f"{_M}, {_N.replace('n AS (SELECT DISTINCT canonical_id,', 'n AS (SELECT DISTINCT canonical_id, entity_type, entity_no, parent_id,')}, reg AS (SELECT DISTINCT canonical_id, entity_type, entity_no, parent_id, {_KEY.format('name')} AS key FROM n), ex AS (SELECT mention_id, arg_min(canonical_id, entity_no) AS canonical_id FROM m JOIN reg ON reg.entity_type = m.entity_type AND reg.key = {_KEY.format('m.name')} GROUP BY mention_id)"
_SIGNALS = f"""{_M}, {HYPEREDGES}, said AS (SELECT 'e' || ord AS id, description AS name, ord FROM hyperedges WHERE description IS NOT NULL),
    sig AS (SELECT 'm' || mention_id AS id, name FROM m UNION ALL SELECT id, name FROM said UNION ALL SELECT id || 'w' AS id, [{", ".join(f"'{w}'" for w in _WORDS)}][(ord % {len(_WORDS)} + 1)::INT] || ' of ' || name FROM said),
    t AS (SELECT id, coalesce(name, '') AS raw, {n.readable("coalesce(name, '')")} AS shown FROM sig), f AS (SELECT *, lower(shown) AS low, {n.key("raw")} AS k FROM t)"""
ORACLES = {
    "ref_normalize": f"WITH {_M} SELECT mention_id, {_REF.format('name')} AS ref, {_BARE.format('name')} AS bare FROM m",
    "ref_lookup": f"WITH {_LOOK} SELECT key, canonical_id FROM k",
    "rel_filter_low": "WITH " + _FILTER.format(look=_LOOK, he=HYPEREDGES, test="= 2", least=2, ref=_REF.format("name"), bare=_BARE.format("name")),
    "rel_filter_high": "WITH " + _FILTER.format(look=_LOOK, he=HYPEREDGES, test="> 2", least=3, ref=_REF.format("name"), bare=_BARE.format("name")),
    "efu_repair": f"""WITH {HYPEREDGES}, {VERTICES}, p AS (SELECT ord, source_id, unnest(vertices) AS vertex_id FROM hyperedges), t AS (SELECT ord, source_id, vertex_id, entity_type FROM p JOIN vertices USING (vertex_id) WHERE entity_type IN ('SYSTEM', 'CONDITION', 'METRIC')),
        one AS (SELECT source_id, entity_type, min(vertex_id) AS one FROM t GROUP BY ALL HAVING min(vertex_id) = max(vertex_id)),
        a AS (SELECT h.ord, k.n, k.t, o.one FROM hyperedges h CROSS JOIN (VALUES (1, 'SYSTEM'), (2, 'CONDITION'), (3, 'METRIC')) k(n, t) JOIN one o ON o.source_id = h.source_id AND o.entity_type = k.t WHERE len(h.vertices) >= 3 AND NOT EXISTS (SELECT 1 FROM t WHERE t.ord = h.ord AND t.entity_type = k.t)),
        g AS (SELECT ord, list(one ORDER BY n) AS added, list('add_' || lower(t) ORDER BY n) AS rules FROM a GROUP BY ord)
        SELECT h.ord AS edge_id, list_concat(h.vertices, coalesce(added, [])) AS vertices, coalesce(rules, []) AS rules FROM hyperedges h LEFT JOIN g USING (ord) WHERE len(h.vertices) >= 3""",
    "unknown_summary": f"WITH {HYPEREDGES}, {VERTICES}, p AS (SELECT relation_type, unnest(vertices) AS vertex_id FROM hyperedges) SELECT relation_type, count(*) AS members, count(*) FILTER (v.vertex_id IS NULL) AS unknown, round(100 * count(*) FILTER (v.vertex_id IS NULL) / count(*), 2) AS rate FROM p LEFT JOIN vertices v USING (vertex_id) GROUP BY relation_type",
    "top_unknown": f"WITH {HYPEREDGES}, {VERTICES}, p AS (SELECT unnest(vertices) AS vertex_id FROM hyperedges) SELECT vertex_id, count(*) AS n FROM p WHERE vertex_id NOT IN (SELECT vertex_id FROM vertices) GROUP BY 1 ORDER BY n DESC, vertex_id LIMIT 20",
    "validate_entities": """SELECT quantity_id, list_filter([CASE WHEN coalesce(trim(raw), '') = '' THEN 'name is required' END, CASE WHEN quantity_type IS NULL THEN 'type is required' END,
        CASE WHEN quantity_type NOT IN ('current_density', 'temperature', 'concentration', 'time', 'flow_rate', 'voltage', 'power_density', 'efficiency', 'pH') THEN 'type is not allowed' END,
        CASE WHEN value IS NOT NULL AND min_value IS NOT NULL AND max_value IS NOT NULL THEN 'value and range exclude each other' END, CASE WHEN min_value > max_value THEN 'range is reversed' END,
        CASE WHEN value IS NOT NULL AND unit IS NULL AND coalesce(quantity_type, '') <> 'pH' THEN 'unit is required with a value' END], lambda x: x IS NOT NULL) AS errors FROM (SELECT DISTINCT quantity_id, raw, quantity_type, value, min_value, max_value, unit FROM parsed_quantity)""",
    "validate_relations": """SELECT edge_id, list_filter([CASE WHEN coalesce(len(vertices), 0) < 2 THEN 'at least two vertices' END, CASE WHEN strength NOT BETWEEN 0 AND 10 THEN 'strength is not between 0 and 10' END, CASE WHEN length(evidence_span) > 500 THEN 'evidence span is longer than 500' END,
        CASE WHEN relation_type IS NULL THEN 'relation type is required' END, CASE WHEN level_hg NOT IN ('Low-order', 'High-order') THEN 'level is not allowed' END], lambda x: x IS NOT NULL) AS errors FROM (SELECT DISTINCT edge_id, vertices, strength, evidence_span, relation_type, level_hg FROM rewritten_hyperedge)""",
    "exact_alias": f"WITH {_EXACT} SELECT mention_id, canonical_id FROM ex",
    "negative_rules": f"""WITH {_EXACT}, hit AS (SELECT DISTINCT name, canonical_id FROM m JOIN ex USING (mention_id)), fam AS (SELECT DISTINCT canonical_id, parent_id FROM canonical_entity), pr AS (SELECT DISTINCT h.name, o.canonical_id, {_KEY.format('h.name')} AS key, f.parent_id AS family FROM hit h JOIN fam f ON f.canonical_id = h.canonical_id JOIN fam o ON o.parent_id = f.parent_id),
        own AS (SELECT key, arg_min(canonical_id, entity_no) AS exact_id, arg_min(parent_id, entity_no) AS exact_family FROM reg GROUP BY key), ks AS (SELECT canonical_id, list(DISTINCT key) AS keys FROM reg WHERE key <> '' GROUP BY canonical_id)
        SELECT name, pr.canonical_id, CASE WHEN exact_family = family AND exact_id <> pr.canonical_id THEN 'high_risk_group' WHEN pr.key IN ({", ".join(f"'{g}'" for g in GENERIC)}) AND NOT list_contains(keys, pr.key) THEN 'generic_term'
            WHEN regexp_matches(pr.key, '[/@]') AND NOT list_contains(keys, pr.key) AND len(list_filter(keys, lambda k: contains(pr.key, k))) > 0 THEN 'component_or_variant' END AS reason FROM pr LEFT JOIN own USING (key) LEFT JOIN ks ON ks.canonical_id = pr.canonical_id""",
    "merge_report": f"WITH {_EXACT}, h AS (SELECT canonical_id, count(*) AS n FROM ex GROUP BY 1) SELECT entity_type, sum(n - 1)::BIGINT AS merged, sum(n)::BIGINT AS mentions, round(sum(n - 1) / sum(n), 4) AS ratio FROM h JOIN canonical_entity USING (canonical_id) GROUP BY 1",
    "group_by_node": f"WITH {_EXACT}, f AS (SELECT canonical_id, name, min(mention_id) AS pos FROM m JOIN ex USING (mention_id) GROUP BY ALL) SELECT canonical_id, arg_min(name, pos) AS base, string_agg(name, ' | ' ORDER BY pos) AS spellings FROM f GROUP BY 1",
    "unit_parse": f"""WITH q AS (SELECT DISTINCT quantity_id, raw, quantity_type FROM parsed_quantity), r AS (SELECT *, {n.readable("raw")} AS shown FROM q), e AS (SELECT *, lower(coalesce(replace(quantity_type, '_', ' '), '') || ' ' || coalesce(shown, '')) AS hinted FROM r),
        p AS (SELECT quantity_id, raw, {", ".join(f"{v} AS {c}" for c, v in n.quantity("shown", "hinted").items())} FROM e)
        SELECT quantity_id, kind AS quantity_type, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN 'range' WHEN sign IN ('≈', '~', 'about', 'approximately') THEN 'approx' WHEN sign = '' THEN '=' ELSE sign END AS operator, CASE WHEN a IS NULL OR b IS NULL THEN one END AS value, CASE WHEN b IS NOT NULL THEN least(a, b) END AS low, CASE WHEN a IS NOT NULL THEN greatest(a, b) END AS high,
            unit, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN 0.9 ELSE 0.85 END::DOUBLE AS confidence FROM p WHERE trim(raw) <> '' AND kind IS NOT NULL AND (one IS NOT NULL OR a IS NOT NULL)""",
    "text_readable": f"SELECT quantity_id, {n.readable('raw')} AS shown FROM (SELECT DISTINCT quantity_id, raw FROM parsed_quantity)",
    "multi_value_explode": "SELECT p_partkey, 0 AS pos, p_size::DOUBLE AS value FROM part UNION ALL SELECT p_partkey, 1, p_size + 3 FROM part UNION ALL SELECT p_partkey, 2, 7.5 FROM part",
    "metric_detect": f"WITH {_SIGNALS}, g AS (SELECT *, {n.metric_case('raw', 'k')} AS metric FROM f) SELECT id, metric, {n.metric_value('metric', 'shown')} AS value FROM g",
    "condition_detect": f"WITH {_SIGNALS} SELECT id, {n.condition_case('low', 'k')} AS condition FROM f",
    "instance_ids": f"""WITH q AS (SELECT DISTINCT quantity_id, quantity_type, value, unit, {_NORMAL.format('unit')} AS n FROM parsed_quantity WHERE value IS NOT NULL AND quantity_type IS NOT NULL),
        u AS (SELECT *, CASE WHEN n IN ('%', 'percent') THEN 'percent' WHEN n IN ('degree', 'deg') THEN 'degree' WHEN n IN ('cycle', 'cycles') THEN 'cycle' ELSE replace(replace(n, ' ', ''), '/', '_') END AS slug FROM q)
        SELECT quantity_id, 'condition:' || lower(quantity_type) || '_' || replace(replace(printf('%g', value), '-', 'minus_'), '.', '_') || '_' || CASE WHEN slug = '' THEN 'unitless' ELSE slug END AS node_id FROM u""",
    "collapse_instances": "SELECT 'condition:' || lower(quantity_type) AS node_id, count(DISTINCT quantity_id) AS instances, min(value) AS low, max(value) AS high FROM parsed_quantity WHERE value IS NOT NULL AND quantity_type IS NOT NULL GROUP BY 1",
    "new_entity_ids": f"""WITH {_M}, k AS (SELECT mention_id, entity_type, translate(replace(lower({n.readable("name")}), '+', ' plus '), '/-', '  ') AS t FROM m WHERE name IS NOT NULL), w AS (SELECT *, array_to_string(regexp_extract_all(t, '([a-z0-9]+)', 1), '_') AS words FROM k)
        SELECT mention_id, CASE entity_type WHEN 'ACTIVE_SPECIES' THEN 'active_species' ELSE lower(coalesce(entity_type, 'unknown')) END || ':' || CASE WHEN words = '' THEN 'unknown' ELSE words END AS canonical_id FROM w""",
    "semantic_groups": f"""WITH {_M}, k AS (SELECT *, {n.key("coalesce(name, '')")} AS k, lower({n.readable("coalesce(name, '')")}) AS low FROM m)
        SELECT mention_id, CASE entity_type WHEN 'METRIC' THEN CASE WHEN contains(k, 'efficiency') OR k IN ('ce', 've', 'ee') THEN 'efficiency_metric' WHEN contains(k, 'resistance') OR contains(k, 'rct') THEN 'resistance_metric' WHEN contains(k, 'roughness') OR contains(k, 'contactangle') OR contains(k, 'wettability') THEN 'morphology_metric'
                WHEN contains(k, 'capacityretention') THEN 'capacity_metric' WHEN contains(k, 'energydensity') THEN 'energy_metric' WHEN contains(k, 'ionexchangecapacity') OR k = 'iec' THEN 'ion_exchange_metric' WHEN contains(k, 'polarization') THEN 'polarization_metric' WHEN contains(k, 'peakseparation') THEN 'electrochemical_evidence_metric' WHEN contains(k, 'pumpingloss') THEN 'hydraulic_metric' WHEN contains(k, 'masstransfer') THEN 'transport_metric' END
            WHEN 'CONDITION' THEN CASE WHEN contains(k, 'currentdensity') THEN 'current_condition' WHEN contains(k, 'flowrate') THEN 'flow_condition' WHEN contains(k, 'concentration') OR contains(low, 'mol/l') THEN 'concentration_condition' WHEN contains(k, 'temperature') OR contains(k, 'degc') THEN 'temperature_condition' WHEN contains(k, 'cycle') THEN 'cycle_condition' WHEN contains(k, 'ph') THEN 'ph_condition' END
            WHEN 'DEGRADATION' THEN CASE WHEN regexp_matches(k, 'crossover|her|hydrogenevolution|capacityfading|dendrite|imbalance|masstransfer|polarization') THEN 'degradation_mechanism' END WHEN 'ACTIVE_SPECIES' THEN 'species_or_additive' END AS semantic_group FROM k""",
    "equivalence_chase": "WITH RECURSIVE c AS (SELECT p_partkey AS source, p_partkey // 2 AS target FROM part WHERE p_partkey % 2 = 0 AND p_partkey > 0 UNION ALL SELECT source, target // 2 FROM c WHERE target % 2 = 0 AND target > 0) SELECT source, min(target) AS target FROM c GROUP BY source",
}
ORACLES["validate_batch"] = f"WITH v AS ({ORACLES['validate_relations']}), u AS (SELECT unnest(CASE WHEN len(errors) = 0 THEN [NULL] ELSE errors END) AS error FROM v) SELECT error, count(*) AS n FROM u GROUP BY 1"
