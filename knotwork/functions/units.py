"""Unit spellings and number notations of measured quantities (plain Python, run inside Arrow batches)."""

from __future__ import annotations

import re

from knotwork.functions.lookalike import fold_py

# Unit -> (quantity type, factor, offset) with common = value * factor + offset.
UNITS = {
    "mA/cm2": ("current_density", 1.0, 0.0), "A/cm2": ("current_density", 1e3, 0.0), "uA/cm2": ("current_density", 1e-3, 0.0), "A/m2": ("current_density", 0.1, 0.0), "mA/m2": ("current_density", 1e-4, 0.0), "kA/m2": ("current_density", 100.0, 0.0),
    "C": ("temperature", 1.0, 0.0), "K": ("temperature", 1.0, -273.15), "F": ("temperature", 5.0 / 9.0, -160.0 / 9.0),
    "mol/L": ("concentration", 1.0, 0.0), "mmol/L": ("concentration", 1e-3, 0.0), "umol/L": ("concentration", 1e-6, 0.0), "mol/m3": ("concentration", 1e-3, 0.0),
    "min": ("time", 1.0, 0.0), "s": ("time", 1.0 / 60.0, 0.0), "h": ("time", 60.0, 0.0), "d": ("time", 1440.0, 0.0), "ms": ("time", 1.0 / 60000.0, 0.0), "week": ("time", 10080.0, 0.0),
    "mL/min": ("flow_rate", 1.0, 0.0), "L/min": ("flow_rate", 1e3, 0.0), "mL/s": ("flow_rate", 60.0, 0.0), "L/h": ("flow_rate", 1e3 / 60.0, 0.0), "mL/h": ("flow_rate", 1.0 / 60.0, 0.0), "uL/min": ("flow_rate", 1e-3, 0.0), "L/s": ("flow_rate", 6e4, 0.0),
    "V": ("voltage", 1.0, 0.0), "mV": ("voltage", 1e-3, 0.0), "kV": ("voltage", 1e3, 0.0), "uV": ("voltage", 1e-6, 0.0),
    "W/cm2": ("power_density", 1.0, 0.0), "mW/cm2": ("power_density", 1e-3, 0.0), "W/m2": ("power_density", 1e-4, 0.0), "kW/m2": ("power_density", 0.1, 0.0), "mW/m2": ("power_density", 1e-7, 0.0),
    "%": ("efficiency", 1.0, 0.0), "fraction": ("efficiency", 100.0, 0.0),
    "kHz": ("ultrasonic_frequency", 1.0, 0.0), "Hz": ("ultrasonic_frequency", 1e-3, 0.0), "MHz": ("ultrasonic_frequency", 1e3, 0.0),
    "pH": ("pH", 1.0, 0.0),
}
# Spellings in words and symbols that the rule for ratios below does not make.
SPELLINGS = {
    "mA/cm2": ["milliamperes per square centimetre", "milliamps per square centimetre", "milliamperes per square centimeter", "mA per cm2"], "A/cm2": ["amperes per square centimetre", "amps per square centimetre"], "uA/cm2": ["microamperes per square centimetre", "microamps per square centimetre"], "A/m2": ["amperes per square metre", "amps per square metre"],
    "C": ["°C", "° C", "degC", "deg C", "deg. C", "degrees Celsius", "degree Celsius", "degrees C", "Celsius"], "K": ["K", "kelvin", "kelvins"], "F": ["°F", "° F", "degF", "deg F", "deg. F", "degrees Fahrenheit", "degree Fahrenheit", "degrees F", "Fahrenheit"],
    "mol/L": ["M", "molar", "moles per litre", "mole per litre", "moles per liter"], "mmol/L": ["mM", "millimolar", "millimoles per litre"], "umol/L": ["uM", "micromolar", "micromoles per litre"], "mol/m3": ["moles per cubic metre"],
    "min": ["min", "mins", "minute", "minutes"], "s": ["s", "sec", "secs", "second", "seconds"], "h": ["h", "hr", "hrs", "hour", "hours"], "d": ["d", "day", "days"], "ms": ["ms", "milliseconds"], "week": ["week", "weeks", "wk"],
    "mL/min": ["cc/min", "ccm", "millilitres per minute", "milliliters per minute"], "L/min": ["litres per minute", "liters per minute"], "mL/s": ["millilitres per second", "cc/s"], "L/h": ["litres per hour", "liters per hour"],
    "V": ["V", "volt", "volts"], "mV": ["mV", "millivolt", "millivolts"], "kV": ["kV", "kilovolts"], "uV": ["uV", "microvolts"],
    "W/cm2": ["watts per square centimetre"], "mW/cm2": ["milliwatts per square centimetre"], "W/m2": ["watts per square metre"], "kW/m2": ["kilowatts per square metre"],
    "%": ["%", "percent", "per cent", "pct", "pct."], "fraction": ["fraction"],
    "kHz": ["kHz", "kilohertz"], "Hz": ["Hz", "hertz"], "MHz": ["MHz", "megahertz"], "pH": ["pH", "pH units"],
}
WORDS = dict(zip("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred half".split(), [*range(21), 30, 40, 50, 60, 70, 80, 90, 100, 0.5]))
SUPERSCRIPTS = str.maketrans("⁰¹²³⁴⁵⁶⁷⁸⁹⁻⁺", "0123456789-+")


def _key(spelling: str) -> str:
    return re.sub(r"\s+", " ", spelling.replace("μ", "u")).strip()


def _spellings() -> dict[str, str]:
    out = {}
    for unit in UNITS:
        if "/" in unit:
            top, under = unit.split("/")
            unders = {"L": ["L", "l", "dm3"]}.get(under, [under])
            for t in {"mL": ["mL", "ml"], "uL": ["uL", "ul"], "L": ["L", "l"]}.get(top, [top]):
                for u in unders:
                    name, power = (u[:-1], u[-1]) if u[-1] in "23" else (u, "1")
                    for form in (f"{t}/{u}", f"{t} / {u}", f"{t} {name}-{power}", f"{t}{name}-{power}", f"{t} {name}^-{power}", f"{t}/{name}^{power}", f"{t} per {u}"):
                        out[form] = unit
        for s in SPELLINGS.get(unit, []):
            out[_key(s)] = unit
    return out


BY_SPELLING = _spellings()
BY_LOWER: dict[str, str] = {}
for _s, _u in BY_SPELLING.items():
    BY_LOWER.setdefault(_s.lower(), _u)
_NUMBER = r"(?<![\w.,^])[-−+]?\d[\d.,]*(?:[' ]\d{3}(?!\d))*(?:\s?[×x*]\s?10\s?\^?\s?[-−+]?\d+|[eE][-−+]?\d+)?"
_WORD = r"(?<![\w-])(?:" + "|".join(sorted(WORDS, key=len, reverse=True)) + r")(?:[- ](?:one|two|three|four|five|six|seven|eight|nine))?(?![\w-])"
_UNIT = "|".join(re.escape(s).replace(r"\ ", r"\s?" if "°" in s else " ") for s in sorted(BY_SPELLING, key=len, reverse=True) if s not in ("pH", "pH units", "fraction"))
_N = f"(?:{_NUMBER}|{_WORD})"
_ONE = re.compile(rf"({_N})\s*(?:±\s*[\d.,]+\s*|\+/-\s*[\d.,]+\s*)?({_UNIT})(?![\w²³])")
_ONE_ANY = re.compile(_ONE.pattern, re.I)
_RANGE = re.compile(rf"({_N})\s*(?:(?:{_UNIT})(?![\w]))?\s*(?:–|—|-|−|to|and|up to|bis|à|through|\.\.\.?|~)\s*({_N.replace('(?<![\\w.,^])', '')})\s*({_UNIT})(?![\w²³])")
_RANGE_ANY = re.compile(_RANGE.pattern, re.I)
_PAIR = re.compile(rf"({_N})\s*(?:–|—|-|−|to|and|up to)\s*({_N.replace('(?<![\\w.,^])', '')})")
_BARE = re.compile(_N)
_PH = re.compile(r"\bpH\b", re.I)
_NOISE = re.compile(r"\[\d+\]|\((?:série|series|run)\s*\d+\)|\b(?:run|cell|no\.|nr\.?|batch|série|series|sample|fig\.?|table|tab\.?|source)\s*\d+|\bafter \d+ cycles", re.I)
_POWER = re.compile(r"^(.*?)\s?(?:[×x*]\s?10\s?\^?\s?|[eE])([-−+]?\d+)$")


def number(text: str) -> tuple[float | None, float | None]:
    """(value, other reading): the other reading is given where a comma may be a decimal or a thousands mark."""
    t = text.strip().replace("−", "-")
    low = t.lower()
    if low in WORDS:
        return float(WORDS[low]), None
    parts = re.split(r"[- ]", low)
    if len(parts) == 2 and parts[0] in WORDS and parts[1] in WORDS:
        return float(WORDS[parts[0]] + WORDS[parts[1]]), None
    scale = 1
    if m := _POWER.match(t):
        t, exponent = m[1], int(m[2])
        if abs(exponent) > 30:
            return None, None
        scale = exponent
    t = re.sub(r"(?<=\d)[' ](?=\d{3})", "", t).rstrip(".,")
    other = None
    if "," in t and "." in t:
        t = t.replace(",", "") if t.rindex(".") > t.rindex(",") else t.replace(".", "").replace(",", ".")
    elif t.count(",") > 1:
        t = t.replace(",", "")
    elif "," in t:
        head, tail = t.split(",")
        if len(tail) == 3 and 1 <= len(head.lstrip("+-")) <= 3 and head.lstrip("+-") != "0" and not scale - 1:
            t, other = head + tail, f"{head}.{tail}"
        else:
            t = f"{head}.{tail}"
    elif t.count(".") > 1:
        t = t.replace(".", "")
    power = f"e{scale}" if scale != 1 or m else ""
    try:
        return float(t + power), (float(other + power) if other else None)
    except ValueError:
        return None, None


def unit_of(text: str | None) -> str | None:
    """The unit a field or a text part names, or None."""
    if not text:
        return None
    t = _key(plain(text))
    return BY_SPELLING.get(t) or BY_LOWER.get(t.lower())


def plain(text: str) -> str:
    """Look-alikes folded, superscripts as digits, multiplication dots as blanks."""
    t = fold_py(text).replace("μ", "u")
    t = re.sub(r"10([⁻⁺]?[⁰¹²³⁴⁵⁶⁷⁸⁹]+)", lambda m: "10^" + m[1].translate(SUPERSCRIPTS), t)
    t = t.translate(SUPERSCRIPTS)
    t = re.sub(r"(?<=[A-Za-z])·(?=[A-Za-z])", " ", t)
    return re.sub(r"(?<=[a-zA-Z])\^(?=[-\d])", "", t)


def parse(raw: str | None) -> dict:
    """lo, hi, their other readings, unit and whether a number was found; ranges are put in order."""
    none = {"lo": None, "hi": None, "alt_lo": None, "alt_hi": None, "unit": None}
    if not raw:
        return none
    t = plain(raw)
    unit = a = b = None
    for one, two in ((_ONE, _RANGE), (_ONE_ANY, _RANGE_ANY)):
        m = two.search(t)
        n = one.search(t)
        if m and (not n or m.end() >= n.start()):
            a, b, spelled = m[1], m[2], m[3]
        elif n:
            a, b, spelled = n[1], None, n[2]
        else:
            continue
        unit = unit_of(spelled)
        break
    if unit is None:
        rest = _NOISE.sub(" ", t)
        if m := _PH.search(rest):
            unit, rest = "pH", rest[m.end():] if _BARE.search(rest[m.end():]) else rest
        elif "fraction" in rest.lower():
            unit = "fraction"
        if m := _PAIR.search(rest):
            a, b = m[1], m[2]
        elif m := _BARE.search(rest):
            a = m[0]
        else:
            return none | {"unit": unit}
    lo, alt_lo = number(a)
    hi, alt_hi = number(b) if b else (lo, alt_lo)
    if lo is None or hi is None:
        return none | {"unit": unit}
    if alt_lo is not None or alt_hi is not None:
        alt_lo, alt_hi = sorted((lo if alt_lo is None else alt_lo, hi if alt_hi is None else alt_hi))
    lo, hi = sorted((lo, hi))
    return {"lo": lo, "hi": hi, "alt_lo": alt_lo, "alt_hi": alt_hi, "unit": unit}
