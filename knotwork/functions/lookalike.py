"""Folding of characters that look the same, as JVM-side column expressions.

The tables below are fixed values: pairs of a foreign letter and the Latin letter it is drawn like,
ligatures with the letters they join, and the code points of spaces and invisible characters.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Foreign look-alike letters, in the order of the Latin letters they resemble.
CYRILLIC = {
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y", "Ү": "Y",
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "Ї": "Ï", "ї": "ï", "Ё": "Ë", "ё": "ë",
}
GREEK = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ο": "o", "ν": "v", "ι": "i", "ϲ": "c", "ϳ": "j",
}
SYMBOLS = {"µ": "μ", "Ω": "Ω", "K": "K", "Å": "Å", "º": "°", "˚": "°", "∙": "·", "⋅": "·", "・": "·", "ı": "i", "ɡ": "g", "ⅼ": "l", "ꞏ": "·"}
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "℃": "°C", "℉": "°F", "ĳ": "ij", "Ĳ": "IJ", "№": "No", "…": "..."}
ROMAN = {"Ⅰ": "I", "Ⅱ": "II", "Ⅲ": "III", "Ⅳ": "IV", "Ⅴ": "V", "Ⅵ": "VI", "Ⅶ": "VII", "Ⅷ": "VIII", "Ⅸ": "IX", "Ⅹ": "X", "ⅰ": "i", "ⅱ": "ii", "ⅲ": "iii", "ⅳ": "iv", "ⅴ": "v", "ⅵ": "vi", "ⅶ": "vii", "ⅷ": "viii", "ⅸ": "ix", "ⅹ": "x"}
SPACES = r"[\t\n\x0b\x0c\r \x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
INVISIBLE = r"[\u0000-\u0008\u000e-\u001f\u007f-\u0084\u0086-\u009f\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff\ufff9-\ufffb]"


def _letters() -> dict[str, str]:
    wide = {chr(0xFF00 + i): chr(0x20 + i) for i in range(1, 95)}  # full-width forms of printable ASCII
    return wide | CYRILLIC | GREEK | SYMBOLS


LETTERS = _letters()
_TABLE = {ord(k): v for k, v in LETTERS.items()}


def fold(text: Column) -> Column:
    """One form for texts that look the same: case, digits in superscript and dashes stay as they are.

    Composed and decomposed accents stay apart here; comparing under an accent-sensitive Unicode collation equates them.

    Null stays null; the empty text stays empty; blanks of any kind become one space, without those at the ends.
    """
    out = F.regexp_replace(text, INVISIBLE, "")
    for source, target in (LIGATURES | ROMAN).items():
        out = F.replace(out, F.lit(source), F.lit(target))
    out = F.translate(out, "".join(LETTERS), "".join(LETTERS.values()))
    return F.trim(F.regexp_replace(out, SPACES, " "))


def fold_py(text: str) -> str:
    """The same for one Python string, for code that already runs in an Arrow batch."""
    out = re.sub(INVISIBLE, "", text)
    for source, target in (LIGATURES | ROMAN).items():
        if source in out:
            out = out.replace(source, target)
    out = unicodedata.normalize("NFC", out.translate(_TABLE))
    return re.sub(SPACES, " ", out).strip(" ")
