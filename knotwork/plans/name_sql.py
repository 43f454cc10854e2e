"""SQL of readable names, matching keys and quantities, for the checks; written for itself, not from the tables of the expressions."""

from __future__ import annotations

import unicodedata

_READ = [
    ("VO\\s*²\\s*⁺", "VO^2+", True), ("VO\\s*\\^\\s*2\\s*\\+", "VO^2+", True), ("VO\\s*₂\\s*⁺", "VO2+", True), ("VO\\s*2\\s*\\+", "VO2+", True), ("V\\s*4\\s*\\+", "V4+", True),
    ("V\\s*\\(\\s*II\\s*\\)", "V(II)", True), ("V\\s*\\(\\s*III\\s*\\)", "V(III)", True), ("V\\s*\\(\\s*IV\\s*\\)", "V(IV)", True), ("V\\s*\\(\\s*V\\s*\\)", "V(V)", True), ("Cr\\s*\\(\\s*II\\s*\\)", "Cr(II)", True), ("Cr\\s*\\(\\s*III\\s*\\)", "Cr(III)", True),
]
_LATER = [
    ("(?:·|\\.)\\s*OH\\b", "oh_radical"), ("\\bOH\\s+radicals?\\b", "oh_radical"), ("\\bhydroxyl\\s+radicals?\\b", "oh_radical"), ("(?:·|\\.)\\s*O2\\s*-?\\b", "o2_radical"), ("\\bO2\\s+radical\\s+anion\\b", "o2_radical"), ("\\bsuperoxide\\s+radicals?\\b", "o2_radical"), ("\\bSO4\\s*(?:·|-?radical)?\\s*-?\\b", "so4_radical"),
]
_UNITS = [("mA\\s*(?:/|\\s+)\\s*cm\\s*(?:\\^?\\s*-?\\s*2)", "ma/cm2"), ("W\\s*(?:/|\\s+)\\s*cm\\s*(?:\\^?\\s*-?\\s*2)", "w/cm2"), ("mg\\s*(?:/|\\s+)\\s*L\\s*(?:\\^?\\s*-?\\s*1)?", "mg/l"), ("g\\s*(?:/|\\s+)\\s*L\\s*(?:\\^?\\s*-?\\s*1)?", "g/l"), ("mol\\s*(?:/|\\s+)\\s*L\\s*(?:\\^?\\s*-?\\s*1)?", "mol/l")]


def _quoted(text: str) -> str:
    return text.replace("'", "''")


def _sub(x: str, pattern: str, to: str, flags: str = "gi") -> str:
    return f"regexp_replace({x}, '{_quoted(pattern)}', '{_quoted(to)}', '{flags}')"


def units(x: str) -> str:
    for pattern, to in _UNITS:
        x = _sub(x, pattern, to)
    return x


def readable(x: str) -> str:
    for pattern, to, _ in _READ:
        x = _sub(x, "\\b" + pattern, to)
    for a, b in (("℃", "°C"), ("℉", "°F"), ("㎛", "um"), ("㎜", "mm"), ("㎝", "cm"), ("㎎", "mg"), ("㎏", "kg"), ("㎖", "ml"), ("…", "..."), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("№", "No")):
        x = f"replace({x}, '{a}', '{b}')"
    single = [(chr(c), unicodedata.normalize("NFKC", chr(c))) for c in [*range(0xA0, 0xD800), *range(0xE000, 0xF900), *range(0xFB00, 0x10000)]]
    single = [(a, b) for a, b in single if a != b and len(b) == 1]
    x = f"translate({x}, '{_quoted(''.join(a for a, _ in single))}', '{_quoted(''.join(b for _, b in single))}')"
    for a, b in (("−", "-"), ("–", "-"), ("—", "-"), ("‐", "-"), ("≥", ">="), ("≤", "<="), ("•", "·"), ("∙", "·"), ("μ", "u"), ("°C", "degc"), ("°c", "degc"), ("°", "")):
        x = f"replace({x}, '{a}', '{b}')"
    for pattern, to in _LATER:
        x = _sub(x, pattern, to)
    x = _sub(_sub(_sub(units(x), "\\s+", " ", "g"), "\\s*([/+(),;:])\\s*", "\\1", "g"), "\\s*-\\s*", "-", "g")
    return _sub(x, "^[ \\t\\r\\n\"']+|[ \\t\\r\\n\"']+$", "", "g")


def key(x: str) -> str:
    x = _sub(_sub(f"lower({readable(x)})", "\\bba\\s*ti\\s*o\\s*3\\b", "batio3", "g"), "\\bbi\\s*fe\\s*o\\s*3\\b", "bifeo3", "g")
    return _sub(x, "[\\s\"'`~!?,.;:()\\[\\]{}_]", "", "g")


NUMBER = "[-+]?[0-9]+(?:\\.[0-9]+)?"
_HAS = lambda key_, *words: "(" + " OR ".join(f"contains({key_}, '{w}')" for w in words) + ")"


def metric_case(raw: str, k: str) -> str:
    """The metric by the text as written and its key."""
    alone = lambda code: f"regexp_matches({raw}, '(?i)(?:^|[^a-z]){code}(?:[^a-z]|$)')"
    rows = [
        ("polarization_voltage", _HAS(k, "polarizationvoltage", "voltageloss", "voltagedrop")), ("peak_separation", _HAS(k, "peakseparation")),
        ("ce", f"{alone('ce')} OR regexp_matches({raw}, '(?i)coulombic') OR starts_with({k}, 'ce')"), ("ve", f"{alone('ve')} OR regexp_matches({raw}, '(?i)voltage efficiency|voltaic efficiency') OR starts_with({k}, 've')"), ("ee", f"{alone('ee')} OR regexp_matches({raw}, '(?i)energy') OR starts_with({k}, 'ee')"),
        ("capacity_retention", _HAS(k, "capacityretention")), ("energy_density", _HAS(k, "energydensity")), ("ion_exchange_capacity", f"{_HAS(k, 'ionexchangecapacity')} OR {alone('iec')}"), ("area_resistance", _HAS(k, "arearesistance")), ("ohmic_resistance", _HAS(k, "ohmicresistance", "ohmicloss")),
        ("charge_transfer_resistance", _HAS(k, "chargetransferresistance", "rct")), ("membrane_resistance", _HAS(k, "membraneresistance")), ("surface_roughness", _HAS(k, "surfaceroughness")), ("contact_angle", _HAS(k, "contactangle", "wettability")),
    ]
    return "CASE " + " ".join(f"WHEN {t} THEN 'metric:{m}'" for m, t in rows) + " END"


def condition_case(low: str, k: str) -> str:
    """The condition by the readable text in lower case and its key."""
    strength = f"(contains({low}, 'mol/l') OR contains({k}, 'concentration'))"
    rows = [
        ("current_density", f"contains({low}, 'ma/cm2') OR contains({k}, 'currentdensity') OR regexp_matches({low}, '\\bma\\b.*\\bcm\\b.*2')"), ("flow_rate", _HAS(k, "flowrate")), ("bi3_concentration", f"{_HAS(k, 'bi3', 'bismuth')} AND {strength}"), ("vanadium_concentration", f"{_HAS(k, 'vanadium')} AND {strength}"),
        ("acid_concentration", f"{_HAS(k, 'h2so4', 'acid')} AND {strength}"), ("electrolyte_concentration", f"{_HAS(k, 'electrolyte')} AND {strength}"), ("temperature", f"{_HAS(k, 'temperature', 'degc')} OR regexp_matches({low}, '\\b\\d+(?:\\.\\d+)?\\s*(?:°c|c)\\b')"),
        ("cycle_number", _HAS(k, "cycle")), ("ph", _HAS(k, "ph")), ("electrolyte_concentration", f"contains({low}, 'mol/l')"),
    ]
    return "CASE " + " ".join(f"WHEN {t} THEN 'condition:{c}'" for c, t in rows) + " END"


def metric_value(metric: str, shown: str) -> str:
    """The number a readable text states for the metric."""
    n = NUMBER
    own = {
        "ce": [f"\\bCE\\b\\s*(?:=|:)?\\s*({n})\\s*%", f"coulombic efficiency\\s*(?:=|:|of)?\\s*({n})\\s*%"], "ve": [f"\\bVE\\b\\s*(?:=|:)?\\s*({n})\\s*%", f"voltage efficiency\\s*(?:=|:|of)?\\s*({n})\\s*%"], "ee": [f"\\bEE\\b\\s*(?:=|:)?\\s*({n})\\s*%", f"energy efficiency\\s*(?:=|:|of)?\\s*({n})\\s*%"],
        "ion_exchange_capacity": [f"\\bIEC\\b\\s*(?:=|:)?\\s*({n})\\s*mmol\\s*/?\\s*g", f"ion exchange capacity\\s*(?:=|:|of)?\\s*({n})\\s*mmol\\s*/?\\s*g"], "contact_angle": [f"contact angle\\s*(?:=|:|of)?\\s*({n})\\s*(?:deg|°)?", f"\\b({n})\\s*(?:deg|°)\\b"], "peak_separation": [f"peak separation\\s*(?:=|:|of)?\\s*({n})\\s*(?:v|mv)?"],
        "polarization_voltage": [f"(?:polarization voltage|voltage loss|voltage drop|ohmic voltage drop)\\s*(?:difference|delta)?\\s*(?:=|:|of|by)?\\s*({n})\\s*v", f"\\b({n})\\s*v\\b"],
    }
    take = lambda p: f"try_cast(nullif(regexp_extract({shown}, '(?i){p}', 1), '') AS DOUBLE)"
    whens = " ".join(f"WHEN 'metric:{m}' THEN coalesce({', '.join(map(take, ps))})" for m, ps in own.items())
    last = f"CASE WHEN {metric} IN ('metric:ce', 'metric:ve', 'metric:ee', 'metric:capacity_retention') THEN try_cast(regexp_extract_all({shown}, '({n})\\s*%', 1)[-1] AS DOUBLE) END"
    return f"coalesce(CASE {metric} {whens} END, {last})"


def quantity(shown: str, both: str) -> dict[str, str]:
    """Columns of a readable text's quantity; `both` is hint and text in lower case."""
    m = lambda x, p: f"regexp_matches({x}, '{p}')"
    got = lambda p: f"nullif(regexp_extract({shown}, '{p}', 1), '')"
    # Word edges beside letters of any script, which \\b of this dialect does not know.
    left, right = "(?:^|[^\\pL\\pN_])", "(?:[^\\pL\\pN_]|$)"
    strength, hours = f"{left}(mol/L|M|g/L|mg/L|mM|μM){right}", f"(?i){left}(min|h|hr|hour|hours|s){right}"
    rules = [
        (m(both, "current density"), "current_density", "'mA/cm2'"), (m(both, f"temperature|°c|{left}k{right}"), "temperature", f"CASE WHEN {m(shown, left + 'K' + right)} THEN 'K' ELSE '°C' END"), (f"{m(both, 'concentration')} OR {m(shown, strength)}", "concentration", got(strength)),
        (m(both, f"time|{left}(?:min|h|hr|hour|hours|s){right}"), "time", got(hours)), (m(both, "ph"), "pH", "'pH'"), (f"{m(both, 'frequency|ultrasound')} OR {m(shown, 'kHz')}", "ultrasonic_frequency", "'kHz'"), (m(both, "power density"), "power_density", "'W/cm2'"), (m(both, "defluorination"), "defluorination_rate", "'%'"),
        (m(both, "removal|degradation efficiency"), "removal_rate", "'%'"), (f"{m(both, 'ce|ve|ee|efficiency|toc|yield')} AND contains({shown}, '%')", "efficiency", "'%'"), (m(shown, "(?i)mA\\s*(?:/| )\\s*cm(?:-?2|2)"), "current_density", "'mA/cm2'"), (m(shown, f"(?i)(?:°C|C|K){right}"), "temperature", got(f"(?i)((?:°C|C|K)){right}")),
        (m(shown, f"(?i)(?:mol/L|M|g/L|mg/L|mM|μM){right}"), "concentration", got(f"(?i)((?:mol/L|M|g/L|mg/L|mM|μM)){right}")), (m(shown, f"(?i)(?:min|h|hr|hour|hours|s){right}"), "time", got(f"(?i)((?:min|h|hr|hour|hours|s)){right}")), (m(shown, f"(?i)pH{right}"), "pH", "'pH'"), (m(shown, f"(?i)kHz{right}"), "ultrasonic_frequency", "'kHz'"), (m(shown, "(?i)W\\s*/\\s*cm2"), "power_density", "'W/cm2'"), (f"contains({shown}, '%')", "efficiency", "'%'"),
    ]
    span = f"(?i)({NUMBER})\\s*(?:-|to|~)\\s*({NUMBER})"
    return {
        "kind": "CASE " + " ".join(f"WHEN {t} THEN '{k}'" for t, k, _ in rules) + " END", "unit": "CASE " + " ".join(f"WHEN {t} THEN {u}" for t, _, u in rules) + " END",
        "sign": f"lower(regexp_extract({shown}, '(?i)(>=|<=|>|<|≈|~|about|approximately)', 1))", "a": f"try_cast(nullif(regexp_extract({shown}, '{span}', 1), '') AS DOUBLE)", "b": f"try_cast(nullif(regexp_extract({shown}, '{span}', 2), '') AS DOUBLE)", "one": f"try_cast(nullif(regexp_extract({shown}, '({NUMBER})', 1), '') AS DOUBLE)",
    }


def general(value: str) -> str:
    """Six significant digits, trailing zeros off."""
    return f"printf('%g', {value})"
