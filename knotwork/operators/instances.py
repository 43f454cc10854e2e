"""Quantities within names: what is measured, its number and unit, and the id of the numeric instance it makes.

Rules are tables tried in order; an expression made from them gives the first that holds. A mention of a metric or
condition that states a number becomes an instance of its concept before any registry is asked.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.functions.readable import key_of, match_key, readable
from knotwork.session import durable

NUMBER = r"[-+]?\d+(?:\.\d+)?"
METRICS, CONDITIONS = ("METRIC", "PERFORMANCE_METRIC"), ("CONDITION", "OPERATING_CONDITION")
NUMERIC = (*METRICS, *CONDITIONS, "PIEZO_PROPERTY")
Test = Callable[[dict[str, Column]], Column]


def _key(*words: str) -> Test:
    """One of the words in the compact key."""
    return lambda v: F.coalesce(*[F.when(F.contains(v["key"], F.lit(w)), True) for w in words], F.lit(False))


def _starts(word: str) -> Test:
    return lambda v: F.startswith(v["key"], F.lit(word))


def _raw(pattern: str) -> Test:
    return lambda v: v["raw"].rlike(f"(?i){pattern}")


def _low(pattern: str) -> Test:
    return lambda v: v["low"].rlike(pattern)


def _any(*tests: Test) -> Test:
    return lambda v: F.coalesce(*[F.when(t(v), True) for t in tests], F.lit(False))


def _all(*tests: Test) -> Test:
    return lambda v: F.when(F.lit(True) if not tests else [t(v) for t in tests][0], F.lit(True)).otherwise(False) if len(tests) == 1 else _fold(tests, v)


def _fold(tests: tuple[Test, ...], v: dict[str, Column]) -> Column:
    out = tests[0](v)
    for t in tests[1:]:
        out = out & t(v)
    return out


def _letters(code: str) -> str:
    """The letters with no other letter beside them."""
    return rf"(?:^|[^a-z]){code}(?:[^a-z]|$)"


# Fixed values, in order: metric, its name, its group, its unit where none is stated, what names it.
METRIC_RULES: list[tuple[str, str, str, str, Test]] = [
    ("metric:polarization_voltage", "polarization voltage", "polarization_metric", "V", _key("polarizationvoltage", "voltageloss", "voltagedrop")),
    ("metric:peak_separation", "peak separation", "electrochemical_evidence_metric", "V", _key("peakseparation")),
    ("metric:ce", "coulombic efficiency", "efficiency_metric", "%", _any(_raw(_letters("ce")), _raw("coulombic"), _starts("ce"))),
    ("metric:ve", "voltage efficiency", "efficiency_metric", "%", _any(_raw(_letters("ve")), _raw("voltage efficiency|voltaic efficiency"), _starts("ve"))),
    ("metric:ee", "energy efficiency", "efficiency_metric", "%", _any(_raw(_letters("ee")), _raw("energy"), _starts("ee"))),
    ("metric:capacity_retention", "capacity retention", "capacity_metric", "%", _key("capacityretention")),
    ("metric:energy_density", "energy density", "energy_metric", "%", _key("energydensity")),
    ("metric:ion_exchange_capacity", "ion exchange capacity", "ion_exchange_metric", "mmol/g", _any(_key("ionexchangecapacity"), _raw(_letters("iec")))),
    ("metric:area_resistance", "area resistance", "resistance_metric", "%", _key("arearesistance")),
    ("metric:ohmic_resistance", "ohmic resistance", "resistance_metric", "%", _key("ohmicresistance", "ohmicloss")),
    ("metric:charge_transfer_resistance", "charge-transfer resistance", "resistance_metric", "%", _key("chargetransferresistance", "rct")),
    ("metric:membrane_resistance", "membrane resistance", "resistance_metric", "%", _key("membraneresistance")),
    ("metric:surface_roughness", "surface roughness", "morphology_metric", "%", _key("surfaceroughness")),
    ("metric:contact_angle", "contact angle", "morphology_metric", "degree", _key("contactangle", "wettability")),
]
_STRENGTH = _any(_low("mol/l"), _key("concentration"))
# Fixed values, in order: condition, its name, its group, its unit, what names it.
CONDITION_RULES: list[tuple[str, str, str, str, Test]] = [
    ("condition:current_density", "current density", "current_condition", "mA/cm2", _any(_low("ma/cm2"), _key("currentdensity"), _low(r"\bma\b.*\bcm\b.*2"))),
    ("condition:flow_rate", "flow rate", "flow_condition", "mL/min", _key("flowrate")),
    ("condition:bi3_concentration", "Bi3+ concentration", "concentration_condition", "mmol/L", _all(_key("bi3", "bismuth"), _STRENGTH)),
    ("condition:vanadium_concentration", "vanadium concentration", "concentration_condition", "mol/L", _all(_key("vanadium"), _STRENGTH)),
    ("condition:acid_concentration", "acid concentration", "concentration_condition", "mol/L", _all(_key("h2so4", "acid"), _STRENGTH)),
    ("condition:electrolyte_concentration", "electrolyte concentration", "concentration_condition", "mol/L", _all(_key("electrolyte"), _STRENGTH)),
    ("condition:temperature", "temperature", "temperature_condition", "C", _any(_key("temperature", "degc"), _low(r"\b\d+(?:\.\d+)?\s*(?:°c|c)\b"))),
    ("condition:cycle_number", "cycle number", "cycle_condition", "cycle", _key("cycle")),
    ("condition:ph", "pH", "ph_condition", "", _key("ph")),
    ("condition:electrolyte_concentration", "electrolyte concentration", "concentration_condition", "mol/L", _low("mol/l")),
]
# Patterns of a metric's number in a readable text, in order.
_OF = r"\s*(?:=|:|of)?\s*"
METRIC_VALUES = {
    "metric:ce": [rf"\bCE\b\s*(?:=|:)?\s*({NUMBER})\s*%", rf"coulombic efficiency{_OF}({NUMBER})\s*%"],
    "metric:ve": [rf"\bVE\b\s*(?:=|:)?\s*({NUMBER})\s*%", rf"voltage efficiency{_OF}({NUMBER})\s*%"],
    "metric:ee": [rf"\bEE\b\s*(?:=|:)?\s*({NUMBER})\s*%", rf"energy efficiency{_OF}({NUMBER})\s*%"],
    "metric:ion_exchange_capacity": [rf"\bIEC\b\s*(?:=|:)?\s*({NUMBER})\s*mmol\s*/?\s*g", rf"ion exchange capacity{_OF}({NUMBER})\s*mmol\s*/?\s*g"],
    "metric:contact_angle": [rf"contact angle{_OF}({NUMBER})\s*(?:deg|°)?", rf"\b({NUMBER})\s*(?:deg|°)\b"],
    "metric:peak_separation": [rf"peak separation{_OF}({NUMBER})\s*(?:v|mv)?"],
    "metric:polarization_voltage": [rf"(?:polarization voltage|voltage loss|voltage drop|ohmic voltage drop)\s*(?:difference|delta)?\s*(?:=|:|of|by)?\s*({NUMBER})\s*v", rf"\b({NUMBER})\s*v\b"],
}
PERCENT = ("metric:ce", "metric:ve", "metric:ee", "metric:capacity_retention")
# Spellings of a unit (readable, lower case) and what it is written as; None drops it.
UNIT_NAMES = {"%": "%", "percent": "%", "mol/l": "mol/L", "m": "mol/L", "mmol/l": "mmol/L", "mm": "mmol/L", "mmol/g": "mmol/g", "mmolg": "mmol/g", "ml/min": "mL/min", "mlmin": "mL/min", "degc": "C", "°c": "C", "c": "C", "deg": "degree", "degree": "degree", "degrees": "degree", "°": "degree", "v": "V", "cycle": "cycle", "cycles": "cycle", "ph": None}
# Fixed values, in order: the unit that a text without a unit of its own states.
TEXT_UNITS: list[tuple[str | None, Test]] = [
    ("%", _raw("%")), ("mmol/g", _raw("mmol/g|mmol g")), ("mA/cm2", _low(r"ma/cm2|ma cm|\bma\b.*\bcm\b.*2")), ("mmol/L", _low("mmol/l")), ("mol/L", _low("mol/l")), ("mL/min", _low("ml/min|ml min")),
    ("C", _any(_low("degc"), _raw(r"\b\d+(?:\.\d+)?\s*(?:°c|c)\b"))), ("degree", _any(_key("contactangle"), _raw("°"), _low("degree"))), ("V", _low(r"\b\d+(?:\.\d+)?\s*v\b")), (None, _low("ph")), ("cycle", _low("cycle")),
]
# Units with a slug of their own.
UNIT_SLUGS = {"%": "percent", "ma/cm2": "ma_cm2", "mol/l": "mol_l", "mmol/l": "mmol_l", "mmol/g": "mmol_g", "ml/min": "ml_min", "deg": "degree", "degree": "degree", "degrees": "degree", "c": "c", "v": "v"}
# Fixed values, in order: quantity types by the words of hint and text, with unit or the pattern that gives it.
QUANTITY_RULES: list[tuple[str, str | None, str | None, str | None, str | None]] = [
    # type, words (in hint and text, lower case), pattern in the text, unit, pattern of the unit in the text
    ("current_density", "current density", None, "mA/cm2", None),
    ("temperature", r"temperature|°c|\bk\b", None, "°C", None),
    ("concentration", "concentration", r"\b(?:mol/L|M|g/L|mg/L|mM|μM)\b", None, r"\b(mol/L|M|g/L|mg/L|mM|μM)\b"),
    ("time", r"time|\b(?:min|h|hr|hour|hours|s)\b", None, None, r"(?i)\b(min|h|hr|hour|hours|s)\b"),
    ("pH", "ph", None, "pH", None),
    ("ultrasonic_frequency", "frequency|ultrasound", "kHz", "kHz", None),
    ("power_density", "power density", None, "W/cm2", None),
    ("defluorination_rate", "defluorination", None, "%", None),
    ("removal_rate", "removal|degradation efficiency", None, "%", None),
]
# Fixed values, in order: types by a unit alone; a unit of None is the one found.
UNIT_RULES = [("current_density", r"mA\s*(?:/| )\s*cm(?:-?2|2)", "mA/cm2"), ("temperature", r"(?:°C|C|K)\b", None), ("concentration", r"(?:mol/L|M|g/L|mg/L|mM|μM)\b", None), ("time", r"(?:min|h|hr|hour|hours|s)\b", None), ("pH", r"pH\b", "pH"), ("ultrasonic_frequency", r"kHz\b", "kHz"), ("power_density", r"W\s*/\s*cm2", "W/cm2"), ("efficiency", "%", "%")]
# Groups of names by type, in order.
GROUP_RULES: dict[tuple[str, ...], list[tuple[str, Test]]] = {
    METRICS: [("efficiency_metric", _any(_key("efficiency"), lambda v: v["key"].isin("ce", "ve", "ee"))), ("resistance_metric", _key("resistance", "rct")), ("morphology_metric", _key("roughness", "contactangle", "wettability")), ("capacity_metric", _key("capacityretention")), ("energy_metric", _key("energydensity")), ("ion_exchange_metric", _any(_key("ionexchangecapacity"), lambda v: v["key"] == "iec")), ("polarization_metric", _key("polarization")), ("electrochemical_evidence_metric", _key("peakseparation")), ("hydraulic_metric", _key("pumpingloss")), ("transport_metric", _key("masstransfer"))],
    CONDITIONS: [("current_condition", _key("currentdensity")), ("flow_condition", _key("flowrate")), ("concentration_condition", _any(_key("concentration"), _low("mol/l"))), ("temperature_condition", _key("temperature", "degc")), ("cycle_condition", _key("cycle")), ("ph_condition", _key("ph"))],
    ("DEGRADATION", "MECHANISM"): [("degradation_mechanism", _key("crossover", "her", "hydrogenevolution", "capacityfading", "dendrite", "imbalance", "masstransfer", "polarization"))],
    ("ACTIVE_SPECIES", "ADDITIVE"): [("species_or_additive", lambda v: F.lit(True))],
}
# The prefix of new ids by type, where it is not the type itself.
PREFIXES = {"SPECIES": "active_species", "ADDITIVE": "active_species", "PERFORMANCE_METRIC": "metric", "OPERATING_CONDITION": "condition", "MECHANISM": "degradation", "MECHANISM_EVIDENCE": "evidence"}


def with_forms(df: DataFrame, text: Column, prefix: str) -> DataFrame:
    """Adds the forms that rules look at: <prefix>_raw as written (null as empty), _shown readable, _low in lower case, _key compact.

    They are columns of their own, one on another, so that the many rules refer to them and do not repeat them.
    """
    out = df.withColumn(f"{prefix}_raw", F.coalesce(text, F.lit("")))
    out = out.withColumn(f"{prefix}_shown", readable(F.col(f"{prefix}_raw")))
    out = out.withColumn(f"{prefix}_low", F.lower(f"{prefix}_shown"))
    return out.withColumn(f"{prefix}_key", key_of(F.col(f"{prefix}_low")))


def views(prefix: str) -> dict[str, Column]:
    return {k: F.col(f"{prefix}_{k}") for k in ("raw", "shown", "low", "key")}


def _first(rules: list, v: dict[str, Column], value: Callable[[tuple], Column]) -> Column:
    return F.coalesce(*[F.when(rule[-1](v), value(rule)) for rule in rules])


def metric_of(v: dict[str, Column]) -> Column:
    """struct(id, name, grp, unit) of the metric a text names, or null."""
    return _first(METRIC_RULES, v, lambda r: F.struct(F.lit(r[0]).alias("id"), F.lit(r[1]).alias("name"), F.lit(r[2]).alias("grp"), F.lit(r[3]).alias("unit")))


def condition_of(v: dict[str, Column]) -> Column:
    """struct(id, name, grp, unit) of the condition a text names, or null."""
    return _first(CONDITION_RULES, v, lambda r: F.struct(F.lit(r[0]).alias("id"), F.lit(r[1]).alias("name"), F.lit(r[2]).alias("grp"), F.lit(r[3]).alias("unit")))


def group_of(v: dict[str, Column], kind: Column) -> Column:
    """The semantic group of a name of a type, by the type's rules in order."""
    return F.coalesce(*[F.when(kind.isin(*kinds), _first(rules, v, lambda r: F.lit(r[0]))) for kinds, rules in GROUP_RULES.items()])


def metric_value(metric: Column, shown: Column) -> Column:
    """The number that a readable text states for a metric: by the metric's patterns in order, for shares else the last percentage."""
    found = lambda p: F.regexp_extract(shown, f"(?i){p}", 1).try_cast("double")
    own = [F.when(metric == m, F.coalesce(*[found(p) for p in patterns])) for m, patterns in METRIC_VALUES.items()]
    last = F.try_element_at(F.regexp_extract_all(shown, F.lit(rf"({NUMBER})\s*%"), F.lit(1)), F.lit(-1)).cast("double")
    return F.coalesce(*own, F.when(metric.isin(*PERCENT) & shown.contains("%"), last))


def canonical_unit(unit: Column, low: Column) -> Column:
    """A stated unit in its usual spelling (`low` is its readable form in lower case); blank units stay, pH is dropped."""
    dropped = [k for k, v in UNIT_NAMES.items() if v is None]
    named = F.coalesce(F.when(low.isin("%", "percent"), "%"), F.when(low.contains("ma/cm2") | low.contains("ma") & low.contains("cm"), "mA/cm2"), *[F.when(low == k, v) for k, v in UNIT_NAMES.items() if v])
    return F.when(F.coalesce(unit, F.lit("")) == "", unit).when(low.isin(*dropped), None).otherwise(F.coalesce(named, F.trim(unit)))


def with_unit(df: DataFrame, stated: Column, v: dict[str, Column], default: Column, name: str) -> DataFrame:
    """Adds the unit that a field states, else the text, else the default (which is in its usual spelling)."""
    df = df.withColumn("kw_stated", F.replace(readable(stated), F.lit("cm-2"), F.lit("cm2")))
    df = df.withColumn("kw_low", F.lower(F.trim("kw_stated")))
    said = F.coalesce(*[F.when(test(v), F.lit(u if u is not None else "none")) for u, test in TEXT_UNITS], default)
    own = canonical_unit(F.col("kw_stated"), F.col("kw_low"))
    return df.withColumn(name, F.when(F.coalesce(F.col("kw_stated"), F.lit("")) != "", own).when(said != "none", said)).drop("kw_stated", "kw_low")


def unit_slug(unit: Column) -> Column:
    low = F.lower(unit)
    plain = F.translate(F.replace(F.replace(unit, F.lit("%"), F.lit("percent")), F.lit("°"), F.lit("deg")), "/- ", "___")
    own = F.coalesce(*[F.when(low == k, v) for k, v in UNIT_SLUGS.items()], F.regexp_replace(match_key(plain), "^$", "unitless"))
    return F.when(F.coalesce(unit, F.lit("")) == "", "unitless").otherwise(own)


def general(value: Column) -> Column:
    """A number with six significant digits, as short as it goes: without trailing zeros, in powers of ten from 1e6 and under 1e-4."""
    shown = F.format_string("%.5e", value)  # -d.ddddde+pp
    power = F.regexp_extract(shown, r"e([-+]\d+)$", 1).cast("int")
    fixed = F.format_string("%.9f", F.regexp_extract(shown, r"^(.*)e", 1).cast("double") * F.pow(F.lit(10.0), power))
    plain = F.regexp_replace(fixed, r"\.?0+$", "")
    scaled = F.concat(F.regexp_replace(F.regexp_extract(shown, r"^(.*)e", 1), r"\.?0+$", ""), F.regexp_extract(shown, r"(e[-+]\d+)$", 1))
    return F.when(value.isNull(), None).when(value == 0, "0").when((power >= 6) | (power < -4), scaled).otherwise(plain)


def number_slug(value: Column) -> Column:
    """A number as part of an id; a missing one is `none`."""
    return F.coalesce(F.replace(F.replace(general(value), F.lit("-"), F.lit("minus_")), F.lit("."), F.lit("_")), F.lit("none"))


def new_key(name: Column) -> Column:
    """Words of a name's readable form joined by underscores; plus signs are spelled out."""
    low = F.translate(F.replace(readable(F.coalesce(name, F.lit("")), lower=True), F.lit("+"), F.lit(" plus ")), "/-", "  ")
    return F.regexp_replace(F.array_join(F.regexp_extract_all(low, F.lit("([a-z0-9]+)"), F.lit(1)), "_"), "^$", "unknown")


def new_id(kind: Column, name: Column) -> Column:
    """Id of an entity that no registry holds: prefix of the type and words of the name."""
    upper = F.upper(F.trim(F.coalesce(kind, F.lit("entity"))))
    prefix = F.coalesce(*[F.when(upper == k, v) for k, v in PREFIXES.items()], F.regexp_replace(F.replace(match_key(upper), F.lit("/"), F.lit("_")), "^$", "entity"))
    keeps = F.when(upper == "ACTIVE_SPECIES", "active_species")
    return F.concat(F.coalesce(keeps, prefix), F.lit(":"), new_key(name))


def with_quantity(df: DataFrame, text: Column, hint: Column | None = None, name: str = "parsed") -> DataFrame:
    """Adds struct(quantity_type, operator, value, low, high, unit, confidence) of a text's quantity; null without a type or a number."""
    df = df.withColumn("kw_text", text).withColumn("kw_shown", readable(F.col("kw_text")))
    df = df.withColumn("kw_both", F.lower(F.concat_ws(" ", F.coalesce(hint, F.lit("")) if hint is not None else F.lit(""), "kw_shown")))
    shown, both = F.col("kw_shown"), F.col("kw_both")
    some = lambda x: F.when(x != "", x)
    hit = lambda p: some(F.regexp_extract(shown, p, 1))
    found = []
    for kind, words, pattern, unit, unit_pattern in QUANTITY_RULES:
        test = both.rlike(words) | (shown.rlike(pattern) if pattern else F.lit(False))
        u = F.when(shown.rlike(r"\bK\b"), "K").otherwise("°C") if kind == "temperature" else F.lit(unit) if unit else hit(unit_pattern)
        found.append(F.when(test, F.struct(F.lit(kind).alias("kind"), u.alias("unit"))))
    share = both.rlike("ce|ve|ee|efficiency|toc|yield") & shown.contains("%")
    found.append(F.when(share, F.struct(F.lit("efficiency").alias("kind"), F.lit("%").alias("unit"))))
    found += [F.when(shown.rlike(f"(?i){p}"), F.struct(F.lit(kind).alias("kind"), (F.lit(u) if u else hit(f"(?i)({p})")).alias("unit"))) for kind, p, u in UNIT_RULES]
    span = rf"(?i)({NUMBER})\s*(?:-|to|~)\s*({NUMBER})"
    df = df.withColumns({"kw_kind": F.coalesce(*found), "kw_sign": F.lower(F.regexp_extract(shown, "(?i)(>=|<=|>|<|≈|~|about|approximately)", 1)), "kw_a": F.regexp_extract(shown, span, 1).try_cast("double"), "kw_b": F.regexp_extract(shown, span, 2).try_cast("double"), "kw_one": F.regexp_extract(shown, f"({NUMBER})", 1).try_cast("double")})
    kind, sign, a, b, one = (F.col(f"kw_{c}") for c in ("kind", "sign", "a", "b", "one"))
    ranged = a.isNotNull() & b.isNotNull()
    operator = F.when(ranged, "range").when(sign.isin("≈", "~", "about", "approximately"), "approx").when(sign == "", "=").otherwise(sign)
    out = F.struct(kind["kind"].alias("quantity_type"), operator.alias("operator"), F.when(~ranged, one).alias("value"), F.when(ranged, F.least(a, b)).alias("low"), F.when(ranged, F.greatest(a, b)).alias("high"), kind["unit"].alias("unit"), F.when(ranged, 0.9).otherwise(0.85).alias("confidence"))
    return df.withColumn(name, F.when((F.trim("kw_text") != "") & kind.isNotNull() & (ranged | one.isNotNull()), out)).drop("kw_text", "kw_shown", "kw_both", "kw_kind", "kw_sign", "kw_a", "kw_b", "kw_one")


def enriched(mentions: DataFrame) -> DataFrame:
    """Mentions with `parsed`: for numeric types the quantity of name, value, unit, attribute and description together."""
    part = lambda c: F.col(c).cast("string") if c in mentions.columns else F.lit(None).cast("string")
    text = F.concat_ws(" ", *[F.when(F.trim(part(c)) != "", part(c)) for c in ("name", "value", "unit", "key_attribute", "description")])
    out = with_quantity(mentions, text, F.concat_ws(" ", part("name"), part("key_attribute")))
    return out.withColumn("parsed", F.when(F.col("entity_type").isin(*NUMERIC), F.col("parsed")))


def _precedes(condition: Column, low: Column) -> Column:
    """Whether a condition's unit is so plain in the text that it goes before the metric's words."""
    strength = low.contains("mol/l")
    tests = {"condition:current_density": low.contains("ma/cm2"), "condition:temperature": low.contains("degc") | low.rlike(r"\b\d+(?:\.\d+)?\s*c\b"), "condition:cycle_number": low.contains("cycle"), "condition:ph": low.contains("ph")}
    tests |= {f"condition:{x}_concentration": strength for x in ("vanadium", "acid", "electrolyte", "bi3")}
    return F.coalesce(*[F.when(condition == c, t) for c, t in tests.items()], F.lit(False))


def _allowed(metric: Column, unit: Column, v: dict[str, Column]) -> Column:
    """Whether a metric may be measured in the unit."""
    low, text, u = v["low"], v["raw"], F.lower(F.coalesce(unit, F.lit("")))
    angle = u.isin("degree", "deg", "degrees") & (low.contains("contact angle") | low.contains("deg"))
    return F.when(metric.isin(*PERCENT), (u == "%") & text.contains("%")).when(metric == "metric:ion_exchange_capacity", u == "mmol/g").when(metric == "metric:contact_angle", angle).when(metric == "metric:polarization_voltage", u == "v").otherwise(True)


def instances(mentions: DataFrame) -> DataFrame:
    """mention_id, canonical_id, concept, node_id, grp, method, value, low, high, unit: mentions that state a number of a metric or condition.

    mentions: mention_id, name, entity_type and, if there are any, value, value_min, value_max, unit, key_attribute,
    description. A condition whose unit is plain goes before a metric, a metric's own number before that; a metric in a
    unit it cannot have is no instance. Null and empty names give none.
    """
    kinds = dict(mentions.dtypes)
    has = lambda c, t: F.col(c).cast(t) if c in kinds else F.lit(None).cast(t)
    said = lambda *cs: F.concat_ws(" ", *[F.nullif(c, F.lit("")) for c in cs])
    rows = mentions.where(F.trim("name") != "").where(F.upper("entity_type").isin(*NUMERIC)).select(
        "mention_id", F.trim("name").alias("name"), F.upper("entity_type").alias("kind"), has("value", "double").alias("given"), has("value_min", "double").alias("least"), has("value_max", "double").alias("most"), has("unit", "string").alias("stated"),
        said(F.trim("name"), has("value", "string"), has("unit", "string"), has("key_attribute", "string")).alias("surface"), said(F.trim("name"), has("value", "string"), has("unit", "string"), has("key_attribute", "string"), has("description", "string")).alias("signal"),
    )
    rows = with_forms(with_forms(with_forms(rows, F.col("surface"), "f"), F.col("signal"), "g"), F.col("name"), "n")
    f, g, n = views("f"), views("g"), views("n")
    rows = rows.withColumns({"by_name": condition_of(f), "cond": condition_of(g), "met": metric_of(g), "number": F.coalesce("given", F.regexp_extract("name", f"({NUMBER})", 1).try_cast("double"))})
    span = rf"(?i)({NUMBER})\s*(?:-|to|~)\s*({NUMBER})"
    rows = rows.withColumns({"a": F.regexp_extract(n["shown"], span, 1).try_cast("double"), "b": F.regexp_extract(n["shown"], span, 2).try_cast("double"), "own": metric_value(F.col("met.id"), g["shown"])})
    rows = rows.withColumns({"low": F.when(F.col("a").isNotNull(), F.least("a", "b")).otherwise(F.col("least")), "high": F.when(F.col("a").isNotNull(), F.greatest("a", "b")).otherwise(F.col("most")), "m_value": F.coalesce("own", "number")})
    rows = durable(with_unit(rows, F.col("stated"), g, F.col("met.unit"), "m_unit"))
    countable = F.coalesce("number", "low", "high").isNotNull()
    metric = F.col("met").isNotNull() & F.col("m_value").isNotNull()
    fits = _allowed(F.col("met.id"), F.col("m_unit"), g)
    early = F.coalesce(F.col("by_name").isNotNull() & _precedes(F.col("by_name.id"), f["low"]), F.lit(False))
    middle = F.coalesce(F.col("cond").isNotNull() & F.col("own").isNull() & _precedes(F.col("cond.id"), g["low"]), F.lit(False))
    late = F.col("cond").isNotNull() & F.when(metric, ~fits).otherwise(F.col("kind").isin(*CONDITIONS))
    way = lambda name, what: F.struct(F.lit(name).alias("way"), F.col(what).alias("what"))
    rows = rows.withColumn("pick", F.when(early & countable, way("condition", "by_name")).when(middle & countable, way("condition", "cond")).when(metric & fits, way("measurement", "met")).when(late & countable, way("condition", "cond")))
    rows = with_unit(rows, F.col("stated"), n, F.col("pick.what.unit"), "c_unit")
    is_metric, concept = F.col("pick.way") == "measurement", F.col("pick.what.id")
    rows = durable(rows.withColumns({"is_metric": is_metric, "concept": concept, "unit": F.when(is_metric, F.col("m_unit")).when(concept != "condition:ph", F.col("c_unit"))})).where("pick is not null")
    is_metric = F.col("is_metric")
    whole = F.col("concept").isin(*PERCENT) & (F.col("m_unit") == "%") & (F.col("m_value") == F.floor("m_value"))
    m_slug = F.when(whole, F.replace(F.concat(F.col("m_value").cast("bigint").cast("string"), F.lit("_0")), F.lit("-"), F.lit("minus_"))).otherwise(number_slug(F.col("m_value")))
    m_key = F.when(F.col("concept") == "metric:polarization_voltage", "polarization_voltage_delta").otherwise(F.substring_index("concept", ":", -1))
    c_slug = F.when(F.coalesce("low", "high").isNotNull(), F.concat(number_slug(F.col("low")), F.lit("_to_"), number_slug(F.col("high")))).otherwise(number_slug(F.col("number")))
    rows = rows.withColumns({"slug": unit_slug(F.col("unit")), "m_slug": m_slug, "c_slug": c_slug})
    node = F.when(is_metric, F.concat(F.lit("measurement:"), m_key, F.lit("_"), "m_slug", F.lit("_"), "slug")).otherwise(F.concat(F.lit("condition:"), F.substring_index("concept", ":", -1), F.lit("_"), "c_slug", F.when(F.coalesce("unit", F.lit("")) != "", F.concat(F.lit("_"), "slug")).otherwise("")))
    return rows.select("mention_id", F.col("concept").alias("canonical_id"), F.col("pick.what.name").alias("concept"), node.alias("node_id"), F.col("pick.what.grp").alias("grp"), F.when(is_metric, "measurement_instance").otherwise("condition_instance").alias("method"), F.when(is_metric, F.col("m_value")).otherwise(F.col("number")).alias("value"), F.when(~is_metric, F.col("low")).alias("low"), F.when(~is_metric, F.col("high")).alias("high"), F.when(F.col("unit") != "", F.col("unit")).alias("unit"))


def angles(mentions: DataFrame) -> DataFrame:
    """Mentions that list two contact angles or more, once for each angle (name and value replaced, pos counting from 0); the others as they are (pos 0)."""
    text = F.concat_ws(" ", "name", *[F.col(c) for c in ("key_attribute", "description") if c in mentions.columns])
    marked = F.regexp_extract_all(text, F.lit(rf"(?i)({NUMBER})\s*(?:°|deg)"), F.lit(1))
    tail = F.regexp_extract(text, r"(?is)contact angle(.*)", 1)
    listed = F.when(F.size(marked) >= 2, marked).when(F.contains(tail, F.lit("/")), F.regexp_extract_all(tail, F.lit(f"({NUMBER})"), F.lit(1)))
    several = F.col("entity_type").isin(*METRICS, *CONDITIONS) & F.lower(text).contains("contact angle") & (F.size(listed) >= 2)
    rows = mentions.withColumn("kw_angles", F.when(several, listed)).select("*", F.posexplode_outer("kw_angles").alias("pos", "angle")).drop("kw_angles")
    split = F.col("angle").isNotNull()
    out = {"name": F.when(split, F.concat(F.lit("contact angle "), "angle", F.lit("°"))).otherwise(F.col("name")), "entity_type": F.when(split, "METRIC").otherwise(F.col("entity_type")), "value": F.when(split, F.col("angle").cast("double")), "unit": F.when(split, "deg")}
    for c in ("value", "unit"):
        if c in mentions.columns:
            out[c] = F.coalesce(out[c], F.col(c))
    return rows.withColumns(out | {"pos": F.coalesce("pos", F.lit(0))}).drop("angle")
