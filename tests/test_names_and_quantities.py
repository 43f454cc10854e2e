"""Readable names, matching keys, quantities within names, instances, negative rules, adjudication and the pipeline."""

import pytest
from pyspark.sql import functions as F

from knotwork.functions.readable import match_key, readable
from knotwork.operators import instances as inst
from knotwork.operators import resolve
from knotwork.operators.evaluate import expected_condition, expected_metric

MENTION = "mention_id bigint, name string, entity_type string, value double, unit string, description string"


def _one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize("text, shown, key", [
    ("  ≥100 mA cm−2 ", ">=100 ma/cm2", ">=100ma/cm2"), ("OH radical", "oh_radical", "ohradical"), ("hydroxyl radical", "oh_radical", "ohradical"), ("·OH", "oh_radical", "ohradical"), ("superoxide radicals", "o2_radical", "o2radical"), ("BaTiO₃", "BaTiO3", "batio3"), ("ba ti o3", "ba ti o3", "batio3"),
    ("V ( iv )", "V(IV)", "viv"), ("VO²⁺", "VO^2+", "vo^2+"), ("VO₂⁺", "VO2+", "vo2+"), ("5 mg / L ^-1", "5 mg/l", "5mg/l"), ("a  -  b , c", "a-b,c", "a-bc"), ("ＡＢ　５ ℃", "AB 5 degc", "ab5degc"), ("", "", ""), (None, None, None),
])
def test_readable_and_key(spark, text, shown, key):
    column = F.lit(text).cast("string")
    assert _one(spark, readable(column)) == shown and _one(spark, match_key(column)) == key


@pytest.mark.parametrize("text, hint, wanted", [
    ("≥100 mA cm−2", "current density", ("current_density", ">=", 100.0, None, None, "mA/cm2", 0.85)), ("40–68 kHz", "ultrasound frequency", ("ultrasonic_frequency", "range", None, 40.0, 68.0, "kHz", 0.9)), ("68 to 40 kHz", "", ("ultrasonic_frequency", "range", None, 40.0, 68.0, "kHz", 0.9)),
    ("about 2 h", None, ("time", "approx", 2.0, None, None, "h", 0.85)), ("pH: 3.5", None, ("pH", "=", 3.5, None, None, "pH", 0.85)), ("300 K", None, ("temperature", "=", 300.0, None, None, "K", 0.85)), ("12", None, None), ("high", "temperature", None), ("", "temperature", None), (None, None, None),
])
def test_quantities(spark, text, hint, wanted):
    rows = spark.createDataFrame([(text, hint)], "t string, h string")
    got = inst.with_quantity(rows, F.col("t"), F.col("h")).first().parsed
    assert (None if got is None else tuple(got)) == wanted


def test_instances(spark):
    rows = [
        (1, "EE 74.8%", "METRIC", None, None, None), (2, "IEC 1.42 mmol/g", "METRIC", None, None, None), (3, "contact angle 92.8?", "METRIC", None, None, None), (4, "120 mA cm?2", "CONDITION", None, None, None), (5, "EE", "METRIC", 79.2, "%", None), (6, "CE", "METRIC", 97.0, "%", None),
        (7, "120 mA/cm2", "METRIC", None, None, "current density"), (8, "200 cycles", "METRIC", None, None, "capacity retention test duration"), (9, "polarization voltage 0.14 V", "METRIC", None, None, None), (10, "pH 14", "CONDITION", None, None, None),
        (11, "contact angle", "METRIC", None, None, "contact angle 92.8?/102?/130.4? after activation"), (12, "25-40 °C", "CONDITION", None, None, None), (13, "EE", "METRIC", None, None, None), (14, None, "METRIC", 3.0, "%", None), (15, "membrane 117", "MEMBRANE", None, None, None), (16, "CE 80 % and then 91 %", "METRIC", None, None, "average"),
    ]
    got: dict[int, set] = {}
    for r in inst.instances(inst.angles(spark.createDataFrame(rows, MENTION))).collect():
        got.setdefault(r.mention_id, set()).add(r.node_id)
    assert got == {
        1: {"measurement:ee_74_8_percent"}, 2: {"measurement:ion_exchange_capacity_1_42_mmol_g"}, 3: {"measurement:contact_angle_92_8_degree"}, 4: {"condition:current_density_120_ma_cm2"}, 5: {"measurement:ee_79_2_percent"}, 6: {"measurement:ce_97_0_percent"}, 7: {"condition:current_density_120_ma_cm2"},
        8: {"condition:cycle_number_200_cycle"}, 9: {"measurement:polarization_voltage_delta_0_14_v"}, 10: {"condition:ph_14"}, 11: {f"measurement:contact_angle_{a}_degree" for a in ("92_8", "102", "130_4")}, 12: {"condition:temperature_25_to_40_c"}, 16: {"measurement:ce_80_0_percent"},
    }


@pytest.mark.parametrize("value", [0.0, 1.0, -2.5, 100000.0, 1234567.0, 0.00001234, 0.0001234, 12.3456789, 999999.7, 3e8, 74.8, -1e-9])
def test_six_significant_digits(spark, value):
    assert _one(spark, inst.general(F.lit(value))) == f"{value:g}"


@pytest.mark.parametrize("name, kind, wanted", [("energy density", "METRIC", "metric:energy_density"), ("electrode polarization", "DEGRADATION", "degradation:electrode_polarization"), ("V(IV)/V(V)", "SPECIES", "active_species:v_iv_v_v"), ("Bi3+", None, "entity:bi3_plus"), ("", "MEMBRANE", "membrane:unknown")])
def test_new_ids(spark, name, kind, wanted):
    assert _one(spark, inst.new_id(F.lit(kind).cast("string"), F.lit(name))) == wanted


def test_expected_ids(spark):
    rows = spark.createDataFrame([("bismuth", 5.0, None, "CE", "condition:bi3_concentration_5_mmol_l", "measurement:ce_5_0_percent"), ("acid", 3.0, "mol L-1", "contact angle", "condition:acid_concentration_3_mol_l", "measurement:contact_angle_3_degree"), ("condition:x", 1.5, None, "IEC", "condition:x", "measurement:iec_1_5_mmol_g")], "c string, v double, u string, m string, wc string, wm string")
    for r in rows.select("wc", "wm", expected_condition(F.col("c"), F.col("v"), F.col("u")).alias("gc"), expected_metric(F.col("m"), F.col("v"), F.col("u")).alias("gm")).collect():
        assert (r.gc, r.gm) == (r.wc, r.wm)


def _registry(spark):
    rows = [
        (1, "pfas:pfoa", "PFOA", "PFAS_TARGET", "target", None, ["perfluorooctanoic acid", "C8"]), (2, "pfas:pfos", "PFOS", "PFAS_TARGET", "target", None, ["C8S"]), (3, "catalyst:batio3", "BaTiO3", "CATALYST_MATERIAL", None, None, ["BTO"]), (4, "active_species:v_iv", "V(IV)", "ACTIVE_SPECIES", "species_or_additive", None, []),
        (5, "active_species:v_v", "V(V)", "ACTIVE_SPECIES", "species_or_additive", None, []), (6, "membrane:nafion_117", "Nafion 117", "MEMBRANE", None, None, ["N117"]), (7, "membrane:nafion_212", "Nafion 212", "MEMBRANE", None, None, []), (8, "electrode:c_c", "carbon cloth", "ELECTRODE", None, None, []), (9, "metric:ce", "coulombic efficiency", "METRIC", "efficiency_metric", None, ["CE"]),
    ]
    return spark.createDataFrame(rows, "entity_no bigint, canonical_id string, canonical_name string, entity_type string, semantic_group string, parent_id string, aliases array<string>")


RULES = resolve.Rules(pairs=(("pfas:pfoa", "pfas:pfos", "Different targets."), ("membrane:nafion_117", "membrane:nafion_212", "Different models.")), groups=(("active_species:v_iv", "active_species:v_v"),))


def test_negative_rules(spark):
    pairs = [("PFOA", "pfas:pfos"), ("PFOS", "pfas:pfoa"), ("Nafion 117", "membrane:nafion_212"), ("V(IV)", "active_species:v_v"), ("Pt/BTO/BO", "catalyst:batio3"), ("electrode", "electrode:c_c"), ("PFOA", "pfas:pfoa"), ("carbon cloths", "electrode:c_c")]
    got = {(r.name, r.canonical_id): r.reason for r in resolve.blocked(spark.createDataFrame(pairs, "name string, canonical_id string"), resolve.registry(_registry(spark)), RULES).collect()}
    assert [got[p] for p in pairs] == ["Different targets.", "Different targets.", "Different models.", "high_risk_group", "component_or_variant", "generic_term", None, None]


def test_cascade_in_order(spark):
    rows = [(1, "perfluorooctanoic acid", "PFAS_TARGET"), (2, "BaTiO₃", "CATALYST_MATERIAL"), (3, "C8S", "PFAS_TARGET"), (4, "Pt/BTO/BO", "CATALYST_MATERIAL"), (5, "CE 97%", "METRIC"), (6, "area resistance", "METRIC"), (7, "electrode", "ELECTRODE"), (8, "carbon clothh", "ELECTRODE"), (9, "perfluorooctan acid", "PFAS_TARGET"), (10, "", "METRIC"), (11, "V(III)", "ADDITIVE")]
    got = {r.mention_id: r for r in resolve.cascade(spark.createDataFrame(rows, "mention_id bigint, name string, entity_type string"), _registry(spark), RULES).collect()}
    assert len(got) == 11
    assert [got[i].canonical_id for i in (1, 2, 3)] == ["pfas:pfoa", "catalyst:batio3", "pfas:pfos"]
    assert got[4].decision == "NEED_REVIEW" and got[4].blocked_reason == "component_or_variant" and got[4].node_id == "unresolved:pt_bto_bo"
    assert got[5].method == "measurement_instance" and got[5].node_id == "measurement:ce_97_0_percent" and got[5].value == 97.0
    assert got[6].canonical_id != "metric:ce" and got[7].canonical_id is None
    assert got[8].decision == "NEED_REVIEW" or got[8].canonical_id == "electrode:c_c"
    assert got[9].decision == "NEED_REVIEW" and got[9].candidates[0].canonical_id == "pfas:pfoa" and len(got[9].candidates) == 2
    assert got[10].node_id == "metric:unknown" and got[11].canonical_id is None


def test_adjudication_is_checked(spark):
    rows = [(1, "perfluorooctan acid", "PFAS_TARGET"), (2, "perfluorooctan acids", "PFAS_TARGET"), (3, "coulombic eficiency", "METRIC"), (4, "perfluoroctanoic acid", "PFAS_TARGET")]
    mentions = spark.createDataFrame(rows, "mention_id bigint, name string, entity_type string")
    judged = resolve.cascade(mentions, _registry(spark), RULES)

    def provider(batches):
        said = {1: ("MERGE", "pfas:pfoa"), 2: ("MERGE", "membrane:nafion_117"), 3: ("merge", "metric:ce")}
        for batch in batches:
            batch = batch[batch["mention_id"].isin(said)]
            yield batch[["mention_id"]].assign(ruling=[said[i][0] for i in batch["mention_id"]], target=[said[i][1] for i in batch["mention_id"]], sure=0.92, review=False)

    got = {r.mention_id: r for r in resolve.adjudicate(judged, mentions, _registry(spark), RULES, provider).collect()}
    assert len(got) == 4
    assert (got[1].decision, got[1].canonical_id, got[1].method, got[1].confidence) == ("MERGE", "pfas:pfoa", "llm_judged", 0.92)
    assert got[2].decision == "NEED_REVIEW" and got[2].need_review and got[2].canonical_id is None
    assert got[3].decision == "NEED_REVIEW" and got[3].blocked_reason == "missing_semantic_group"
    assert got[4].method != "llm_judged"


def test_pipeline(spark):
    rows = [(1, "N117", "MEMBRANE", None, None, "membrane used in the test"), (2, "Nafion 117", "MEMBRANE", None, None, "second"), (3, "CE", "METRIC", 97.0, "%", None), (4, "contact angle", "METRIC", None, None, "contact angle 92.8?/102? after activation"), (5, None, "METRIC", None, None, None)]
    mentions = spark.createDataFrame(rows, MENTION)
    got = {r.node_id: r for r in resolve.pipeline(mentions, _registry(spark), RULES).collect()}
    assert set(got) == {"membrane:nafion_117", "measurement:ce_97_0_percent", "measurement:contact_angle_92_8_degree", "measurement:contact_angle_102_degree", "metric:unknown"}
    one = got["membrane:nafion_117"]
    assert (one.raw_name, one.mentions, one.description, one.n) == ("N117", "N117 | Nafion 117", "membrane used in the test | second", 2)
    assert got["measurement:ce_97_0_percent"].canonical_id == "metric:ce" and got["measurement:ce_97_0_percent"].parsed.quantity_type == "efficiency"
    flat = {r.node_id: r for r in resolve.pipeline(mentions, _registry(spark), RULES, keep_instances=False).collect()}
    assert flat["metric:ce"].value is None and flat["metric:ce"].method == "measurement_instance_concept_only" and flat["metric:contact_angle"].n == 2
    broken = resolve.pipeline(mentions, _registry(spark).drop("semantic_group"), RULES).collect()
    assert {r.method for r in broken} == {"passed_through"} and len(broken) == 5 and broken[0].error


def test_registry_in_shards(spark, monkeypatch):
    mentions = spark.createDataFrame([(1, "perfluorooctan acid", "PFAS_TARGET"), (2, "nafion 11", None), (3, "coulomb efficiency", "METRIC")], "mention_id bigint, name string, entity_type string")
    whole = sorted(map(tuple, resolve.fuzzy(mentions, _registry(spark), 3).collect()), key=str)
    monkeypatch.setattr(resolve, "REGISTRY_ROWS", 3)
    assert sorted(map(tuple, resolve.fuzzy(mentions, _registry(spark), 3).collect()), key=str) == whole
