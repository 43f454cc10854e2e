"""Readable and matching forms of names and quantities, built from tables of rules; null in, null out.

The tables hold fixed values: what is rewritten into what. The expressions are made from them in one place and run
inside the JVM. Characters are folded to their compatibility form one by one; of those that stand for several letters
only the ones listed are resolved.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements and the oxidation states whose notation is kept apart, by element.
OXIDATION_STATES = {"V": ["II", "III", "IV", "V"], "Cr": ["II", "III"]}
# Ions of one charge that differ in a digit only; pattern (before superscripts become digits) and what is shown.
IONS = [(r"\bVO\s*²\s*⁺", "VO^2+"), (r"\bVO\s*\^\s*2\s*\+", "VO^2+"), (r"\bVO\s*₂\s*⁺", "VO2+"), (r"\bVO\s*2\s*\+", "VO2+"), (r"\bV\s*4\s*\+", "V4+")]
# Characters that stand for several letters.
SEVERAL = {"℃": "°C", "℉": "°F", "㎛": "um", "㎜": "mm", "㎝": "cm", "㎎": "mg", "㎏": "kg", "㎖": "ml", "…": "...", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "№": "No"}
# Symbols and what they are written as.
SYMBOLS = {"−": "-", "–": "-", "—": "-", "‐": "-", "≥": ">=", "≤": "<=", "•": "·", "∙": "·", "μ": "u", "°C": "degc", "°c": "degc", "°": ""}
# Radicals and their spellings.
RADICALS = {
    "oh_radical": [r"(?:·|\.)\s*OH\b", r"\bOH\s+radicals?\b", r"\bhydroxyl\s+radicals?\b"],
    "o2_radical": [r"(?:·|\.)\s*O2\s*-?\b", r"\bO2\s+radical\s+anion\b", r"\bsuperoxide\s+radicals?\b"],
    "so4_radical": [r"\bSO4\s*(?:·|-?radical)?\s*-?\b"],
}
# Ratios of units, with the power of what is below; the power 1 need not be written.
RATIOS = [("mA", "cm", 2), ("W", "cm", 2), ("mg", "L", 1), ("g", "L", 1), ("mol", "L", 1)]
# Formulas that are spelled with blanks between their elements.
FORMULAS = [("ba", "ti", "o", "3"), ("bi", "fe", "o", "3")]


def _single() -> dict[str, str]:
    """Characters of the basic plane whose compatibility form is one other character."""
    forms = ((chr(c), unicodedata.normalize("NFKC", chr(c))) for c in range(0xA0, 0x10000) if not 0xD800 <= c < 0xE000 and not 0xF900 <= c < 0xFB00)
    return {a: b for a, b in forms if a != b and len(b) == 1 and a not in SEVERAL}


SINGLE = _single()


def ratio_words(text: Column) -> Column:
    """Ratios of units in one spelling."""
    for top, under, power in RATIOS:
        tail = rf"(?:\^?\s*-?\s*{power})" + ("?" if power == 1 else "")
        text = F.regexp_replace(text, rf"(?i){top}\s*(?:/|\s+)\s*{under}\s*{tail}", f"{top}/{under}{power if power > 1 else ''}".lower())
    return text


def radical_names(text: Column) -> Column:
    for name, spellings in RADICALS.items():
        for pattern in spellings:
            text = F.regexp_replace(text, f"(?i){pattern}", name)
    return text


def readable(text: Column, lower: bool = False) -> Column:
    """One spelling for display: ions kept apart, compatibility forms, symbols, radicals, units, blanks around punctuation."""
    for pattern, shown in IONS:
        text = F.regexp_replace(text, f"(?i){pattern}", shown.replace("$", r"\$"))
    for element, states in OXIDATION_STATES.items():
        for state in states:
            text = F.regexp_replace(text, rf"(?i)\b{element}\s*\(\s*{state}\s*\)", f"{element}({state})")
    for source, target in SEVERAL.items():
        text = F.replace(text, F.lit(source), F.lit(target))
    text = F.translate(text, "".join(SINGLE), "".join(SINGLE.values()))
    for source, target in SYMBOLS.items():
        text = F.replace(text, F.lit(source), F.lit(target))
    text = ratio_words(radical_names(text))
    text = F.regexp_replace(text, r"\s+", " ")
    text = F.regexp_replace(text, r"\s*([/+(),;:])\s*", "$1")
    text = F.regexp_replace(text, r"\s*-\s*", "-")
    text = F.regexp_replace(text, r"""^[ \t\r\n"']+|[ \t\r\n"']+$""", "")
    return F.lower(text) if lower else text


def key_of(low: Column) -> Column:
    """The compact key of a readable text in lower case."""
    for parts in FORMULAS:
        low = F.regexp_replace(low, r"\b" + r"\s*".join(parts) + r"\b", "".join(parts))
    return F.regexp_replace(low, r"[\s\"'`~!?,.;:()\[\]{}_]", "")


def match_key(text: Column) -> Column:
    """Compact key for comparisons, never for display: readable, lower case, without blanks and punctuation."""
    return key_of(readable(text, lower=True))
