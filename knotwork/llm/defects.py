"""Defective answers found by noisy labelling functions, whose votes an expectation-maximization label model combines.

Every labelling function votes + (the defect), - (not the defect) or 0 (no say). The functions of a defect look at
different things: the text's own form, phrases, and counts over all answers of how often a context of one to six tokens
ends a sentence. The model of each defect learns the functions' accuracies from the counts of the vote patterns alone;
there are at most 3^8 patterns, so they fit on the driver whatever the number of answers. A pair keeps every defect
whose posterior exceeds the defect's cutoff. The cutoffs are validated on corpus pairs that were damaged on purpose and
on the invented pairs of `defect_examples`; one half chooses them, `validation` reports the other half.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.functions.lookalike import fold_py
from knotwork.functions.sizes import small_side
from knotwork.llm.defect_examples import EXAMPLES
from knotwork.llm.language import HAN, SETS, detect
from knotwork.session import durable

DEFECTS = ["empty", "copied_question", "other_language", "refusal", "truncated"]
# What stands for an absent answer, labels before an answer.
PLACEHOLDERS = frozenset("n/a|na|n.a|none|null|nil|tbd|tba|todo|nan|empty|blank|no answer|no answer provided|no answer given|no answer available|not available|not applicable|not provided|no response|no reply|no content|no text|no output|missing|undefined|unknown|pending|to be added|to be completed|keine antwort|sans réponse|sin respuesta|nessuna risposta|нет ответа|无|无回答|没有回答|answer|a|ans|response|reply|answer here|placeholder|lorem ipsum|insert answer here|your answer|your answer here|output|result|xxx|void|redacted".split("|"))
LABEL = re.compile(r"^\s*(?:\*\*|#+ ?)?(?:(?:final |short |model |my )?answer|ans|a|response|reply|(?:the |your )?question(?: is| was)?|you (?:asked|want(?:ed)? to know)|i was asked|q|user|assistant|prompt|antwort|frage|réponse|respuesta|pregunta|risposta|domanda|ответ|вопрос|回答|答|问题?|问)(?:\*\*)?\s*[:：.)-]\s*(?:\*\*)?\s*", re.I)
_TOKEN = re.compile(r"[㐀-鿿぀-ヿ가-힯]|[^\W\d_]+(?:['’\-][^\W\d_]+)*|\d+(?:[.,]\d+)*|\n|[^\w\s]")
_WORD = re.compile(r"[㐀-鿿]|[^\W_]+(?:[-'.,/][^\W_]+)*")
_HAN = re.compile(r"[㐀-鿿]")
_STOP = frozenset(".!?。！？…")
_CLOSERS = "\"'”’»)]}」』）】*_ "
_MARKER = re.compile(r"^\s*(?:[-*+•]|\(?\d{1,3}[.)]|\(?[a-z][.)]|#+|\|)\s*$")
# Abbreviations that end in a stop without ending a sentence.
_ABBREVIATED = re.compile(r"(?:\b(?:e\.g|i\.e|cf|ca|vs|fig|figs|tab|no|nr|dr|prof|approx|resp|incl|eq|sec|ref|refs|z\.b|d\.h|bzw|p\.ex)\.|\b(?:dr|prof|mr|mrs|ms)\. \w\.)$", re.I)
# Phrases by which an answer is declined.
ACT = r"(?:answer|respond|reply|comment|discuss|say|tell|help|assist|provide|give|offer|opine|address|assess|judge|determine|decide|share|handle|speak|engage|advise|conclude|evaluate)"
UNABLE = re.compile(
    rf"\b(?:(?:can|could|may|might|must|will|would|shall|should)(?: ?not|n't)|can't|won't|(?:am|'m|are|is|be|been) (?:just |simply |currently )?(?:not able|unable|not in a position|not allowed|not permitted|not authori[sz]ed|not at liberty|not comfortable|not qualified|not possible|not appropriate)|unable|have to (?:refuse|decline|pass)|has to (?:refuse|decline)|must (?:refuse|decline|pass)|refuse|decline|would rather not|prefer not|not (?:be )?(?:possible|appropriate|able)|impossible|inappropriate|prevents? (?:me|us)|prohibits? (?:me|us)|beyond (?:me|us)|not willing)\b(?:\W+\w+){{0,5}}?\W+{ACT}(?:s|ing|ed|d)?\b"
    r"|\b(?:i|we) (?:do not|don't|did not) (?:know|have (?:access|enough|sufficient|any)|wish to|want to|feel able)|\bnot something (?:i|we|this|that i)\b|\b(?:no|not any|without an?) (?:reply|answer|statement|response|conclusion|comment) (?:is|can|could|are|was)\b|(?:question|matter|point) (?:stays|remains|is left|must stay) open|(?:falls?|lies?|is|are) (?:well )?(?:outside|beyond) (?:of )?(?:what|my|our|the scope)|(?:decline|refuse|must pass|have to pass)\b.{0,30}\b(?:request|question|this|that)\b|\bcannot be (?:answered|determined|decided|inferred)|\bno way to (?:tell|know|answer)|\bleave (?:this|that|the question) (?:open|unanswered)|\bwould be speculat|\bnot (?:for me|for us) to\b|\b(?:guidelines|policy|policies|rules)\b.{0,30}\b(?:prevent|prohibit|forbid|do not allow|don't allow)"
    r"|\bkann (?:ich|dazu|diese|das|die|wir)\b.{0,50}\bnicht\b|weiß (?:ich|es) nicht|\bich weiß nicht|\bkeine (?:antwort|angaben?|aussage) (?:möglich|machen|geben)|\bne (?:peux|puis|peut|pouvons)\b.{0,25}\bpas\b|\bne sai[st] pas|\bno (?:puedo|podemos|se puede)\b|\bno (?:lo )?sé\b|\bnon (?:posso|possiamo|so)\b|не (?:могу|можем|знаю|удаётся|удается)|невозможно|无法|不能回答|不知道|抱歉|不便",
    re.I,
)
LACK = re.compile(
    r"\b(?:not (?:enough|sufficient)|insufficient|in ?adequate|too little|no (?:relevant|sufficient|suitable|usable|such))\b.{0,40}\b(?:information|evidence|context|data|details?|material|sources?|passages?|documents?)\b|\b(?:missing|lacking|lack of|absent) (?:information|evidence|context|data|details?)|\b(?:none|no part|nothing|not one|neither|no(?:ne)?) (?:of|in|from|within) (?:the|these|those|my|our|all)\b.{0,40}\b(?:passages?|sources?|chunks?|excerpts?|documents?|context|texts?|materials?|papers?|evidence|snippets?|results?)\b"
    r"|\b(?:passages?|sources?|chunks?|excerpts?|documents?|context|texts?|materials?|papers?|evidence|snippets?|report|article)\b.{0,30}\b(?:do(?:es)? not|don't|doesn't|did not|fails? to|never|says? nothing|is silent|are silent|lacks?|gives? no|contains? no|offers? no|holds? no|provides? no)\b|\bnicht genug|keine ausreichenden|unzureichend|pas assez|insuffisant\w*|no hay suficiente|insuficiente|недостаточно|信息不足|没有足够|没有提到|未提及",
    re.I,
)
PERSONA = re.compile(r"\bas an? (?:ai\b|(?:large )?language model|(?:virtual |helpful )?assistant|chatbot|bot\b)|\bi(?:'m| am) (?:just |only |merely )?an? (?:ai\b|(?:large )?language model|assistant|chatbot)|\bthis (?:assistant|bot|chatbot|model) (?:can|will|would|is|have|has|must|do)|for (?:safety|policy|legal|security) reasons|questions (?:of this kind|like this)|my (?:guidelines|instructions|programming|training)|\bals ki\b|en tant qu'ia|como (?:una )?ia\b|как ии\b|作为.{0,6}(?:ai|人工智能|语言模型)", re.I)
FILLER = re.compile(r"^\W*(?:sorry|apolog|i(?:'m| am) (?:sorry|afraid)|unfortunately|regrettably|sadly|with regret|let me know|you (?:may|might|could|can) (?:want|wish|ask|try|consult|contact|rephrase)|try |please|feel free|is there anything|i hope|thank|maybe |perhaps |consult |contact |rephrase|kindly|hopefully|leider|désolé|lamentablemente|к сожалению|很抱歉)", re.I)


# At least one of these is in every ASCII sentence the three patterns above can match.
_HINTS = (" no", "cannot", "n't", "unable", "refus", "declin", "must pass", "to pass", "impossible", "inappropriate", "prevent", "prohibit", "forbid", "beyond", "outside", "s open", "left open", "stay open", "leave", "unanswered", "speculat", "insufficient", "inadequate", "in adequate", "too little", "missing", "lack", "absent", "neither", "fail", "never", "silent", "as a ", "as an ", "i'm", "i am", "assistant", " bot", "chatbot", "language model", "this model", "reasons", "questions of this", "questions like", " my ", "als ki", "'ia", " ia", "nicht", "kein", "unzureichend", " pas ", "insuffi", "ne sai")


def squeeze(text: str) -> str:
    return "\n".join(fold_py(x) for x in text.splitlines())


def _tokens(text: str) -> list[str]:
    return _WORD.findall(text.lower())


# --- labelling functions: one character a function ---


def empty_votes(answer: str) -> str:
    """Letters or digits at all; a placeholder; a label and nothing behind it; a bracket and little in it; length."""
    body = answer.strip()
    letters = len(re.sub(r"[\W_]+", "", body))
    bare = body.strip(" .-<>()[]{}*_\"'!:").lower()
    label = LABEL.match(body + " ") is not None and not re.sub(r"[\W_]+", "", LABEL.sub("", body + " "))
    framed = re.fullmatch(r"[\[({<][^\[\](){}<>]{0,40}[\])}>]", body) is not None
    return ("+" if not letters else "0") + ("+" if bare in PLACEHOLDERS else "0") + ("+" if label else "0") + ("+" if framed else "0") + ("-" if letters > 20 or letters and bare not in PLACEHOLDERS and not label and not framed else "0")


def copied_votes(question: str, answer: str) -> str:
    """The same letters; words in common; letters in order; words the question does not have."""
    if len(answer) > 2.5 * len(question) + 80:
        return "0--0"
    q, a = _tokens(LABEL.sub("", question, 1)), _tokens(LABEL.sub("", answer, 1))
    a = a[: len(a) - 1] if len(a) > 1 and LABEL.match(a[-1] + ":") and a[-1] not in q else a  # a label behind it
    if not q or not a:
        return "0-00"
    own = set(q)
    inside, cover = sum(w in own for w in a) / len(a), len(own & set(a)) / len(own)
    new = [w for w in a if w not in own]
    near = "-"
    if cover > 0.5 and inside > 0.5:
        x, y = "".join(q), "".join(a)
        near = "+" if max(SequenceMatcher(None, x, y, autojunk=False).ratio(), SequenceMatcher(None, x * 2, y, autojunk=False).ratio()) >= 0.85 else "-"
    return ("+" if q == a or q * 2 == a else "0") + ("+" if inside >= 0.7 and cover >= 0.6 else "-") + near + ("+" if len(new) <= 4 and cover >= 0.6 else "-" if len(new) > 5 or cover < 0.4 else "0")


def language_votes(question: str, answer: str) -> str:
    """Languages named by common words; the question's own common words in the answer; script; sentence by sentence."""
    q = detect(question, 2)
    if q is None:
        return "0000"
    a = detect(answer, 3)
    words = re.findall(r"[^\W\d_]+(?:'[^\W\d_]+)?", answer)
    low = [w for w in words if w[0].islower()] if q != "zh" else words
    han, cyrillic = len(_HAN.findall(answer)), len(re.findall(r"[Ѐ-ӿ]", answer))
    if q == "zh":
        own, many = han / max(1, han + len(low)), han + len(low)
    else:
        own, many = sum(w.lower() in SETS[q] for w in words) / max(1, len(low)), len(low)
    named = "0" if a is None else "-" if a == q else "+"
    share = "0" if many < 6 else "+" if own < 0.09 else "-" if own > 0.16 else "0"
    script = {"zh": han, "ru": cyrillic}.get(q, 0)
    other = (0 if q == "zh" else han) + (0 if q == "ru" else cyrillic // 4)
    drawn = "+" if other >= 4 and other > script or q in ("zh", "ru") and not script and many >= 6 else "-" if script > 3 else "0"
    parts = [detect(p, 2) for p in re.split(r"(?<=[.!?。！？])\s*", answer) if len(p) > 25]
    parts = [p for p in parts if p]
    each = "0" if not parts else "-" if q in parts else "+"
    return named + share + drawn + each


def _sentences(text: str) -> list[str]:
    return [p for p in re.split(r"(?<=[.!?。！？])\s+|(?<=[。！？])|\n+", re.sub(r"[ \t]+", " ", text.replace("’", "'")).strip()) if p.strip()]


def refusal_votes(answer: str) -> str:
    """Declining phrases near the start of a sentence; lack of material; persona; nothing said beside; a short answer that opens so."""
    if len(answer.strip()) < 6:
        return "--000"
    parts = _sentences(answer)
    near = lambda pattern, p: (m := pattern.search(p)) is not None and m.start() <= 45
    hinted = [not p.isascii() or any(h in low for h in _HINTS) for p, low in zip(parts, (f" {p.lower()}" for p in parts))]
    unable = [h and near(UNABLE, p) for p, h in zip(parts, hinted)]
    lack = [h and near(LACK, p) for p, h in zip(parts, hinted)]
    persona = [h and near(PERSONA, p) for p, h in zip(parts, hinted)]
    marked = [u or k or s for u, k, s in zip(unable, lack, persona)]
    filler = [bool(FILLER.match(p)) for p in parts]
    rest = sum(len(_tokens(p)) for p, m, f in zip(parts, marked, filler) if not m and not f)
    said = any(re.search(r"\d\s?(?:%|°|[a-zA-Z]{1,3}\b)|: ", p) for p, m in zip(parts, marked) if m)
    full = "+" if any(marked) and rest <= 3 and not said else "-"
    opens = "+" if marked and (marked[0] or filler[0] and any(marked[:2])) and len(answer) < 280 and rest <= 6 else "-" if not any(marked) else "0"
    return ("+" if any(unable) else "0") + ("+" if any(lack) else "0") + ("+" if any(persona) else "0") + full + opens


def truncated_votes(answer: str) -> str:
    """A stop at the end; an open bracket or quotation; a joining mark; a bare list mark; a bare name or number as the whole answer."""
    body = answer.rstrip()
    tokens = _TOKEN.findall(body)
    if len(re.sub(r"[\W_]+", "", body)) < 1 or not tokens:
        return "-0000"
    last_line = body.splitlines()[-1]
    core = body.rstrip(_CLOSERS)
    marker = _MARKER.match(last_line) is not None and len(body) > len(last_line) + 1
    stopped = bool(core) and core[-1] in _STOP and not marker and not _ABBREVIATED.search(core[-12:]) or core != body and body[-1] in ")]" and bool(re.search(r"[.!?。！？]\s*[\[(][^\[\]()]{1,40}[\])]$", body[-60:]))
    opened = body.count("(") > body.count(")") or body.count("[") > body.count("]") or body.count("“") > body.count("”") or body.count('"') % 2 == 1
    joined = body[-1] in ",;:–—(/&=-" and not LABEL.fullmatch(last_line.strip() + " ") and re.search(r"[^\W_]", body) is not None
    words = _tokens(body)
    return ("-" if stopped else "0") + ("+" if opened and not stopped else "0") + ("+" if joined and not stopped else "0") + ("+" if marker else "0") + ("-" if _brief(body, words) else "0")


def _brief(body: str, words: list[str]) -> bool:
    """A lone name, number or short phrase: nothing before it tells whether it is whole."""
    return "\n" not in body and len(words) <= 6 and not (words and words[-1] in _FUNCTION) and body[-1:] not in tuple(",;:–—(/&=-")


_FUNCTION = frozenset().union(*SETS.values()) | HAN - {"了", "的"}


# --- contexts: how often the last one to six tokens end a sentence ---

ORDERS = 6
_TITLES = frozenset("dr prof mr mrs ms mme hr fr".split())
BITS = 22  # the set of contexts asked for is sent as a bitmap of 2^22 bits (512 KB), whatever their number


@lru_cache(maxsize=1 << 18)
def _number(token: str) -> int:
    return int.from_bytes(hashlib.blake2b(token.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def _forms(text: str) -> tuple[list[str], list[bool]]:
    """Tokens as the contexts see them (digits alike, names alike, the first word of a sentence in lower case) and which are ends."""
    raw = _TOKEN.findall(text)
    out, ends, fresh = [], [], True
    for i, t in enumerate(raw):
        short = t == "." and i > 0 and (raw[i - 1].lower() in _TITLES or len(raw[i - 1]) == 1 and raw[i - 1].isupper() and i > 1 and (raw[i - 2] == "." or raw[i - 2].lower() in _TITLES))
        end = t == "\n" or t in _STOP and not short and (i + 1 == len(raw) or not (raw[i + 1][0].islower() or raw[i + 1][0].isdigit()))
        ends.append(end)
        out.append("^" if end else "0" if t[0].isdigit() else t.lower() if fresh or not t[0].isupper() else "N")
        fresh = end or fresh and not t[0].isalnum()
    return out, ends


def _contexts(numbers: np.ndarray, reach: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order the hash of the context that ends at each token and whether it stays within the sentence (its beginning included)."""
    out, h = [], np.zeros(len(numbers), dtype=np.uint64)
    for k in range(ORDERS):
        back = np.roll(numbers, k)
        back[:k] = 0
        h = (h ^ back) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        out.append((h + np.uint64(k + 1), reach >= k))
    return out


def _reach(ends: np.ndarray) -> np.ndarray:
    """Tokens since the last end, counting the end as one."""
    at = np.arange(len(ends))
    return at - np.maximum.accumulate(np.where(ends, at, 0))


def tail_contexts(answer: str) -> tuple[list[int], int] | None:
    """Hashes of the contexts at the end of an answer that does not stop (0 where there is none), and of its last word as written."""
    body = answer.rstrip()
    forms, ends = _forms(body[-600:] if len(body) > 600 else body)
    if not forms or ends[-1] or _brief(body, _tokens(body)):
        return None
    numbers = np.array([_number("^"), *map(_number, forms)], dtype=np.uint64)
    reach = _reach(np.array([True, *ends]))
    found = [int(h[-1].astype(np.int64)) if ok[-1] else 0 for h, ok in _contexts(numbers, reach)]
    last = re.search(r"[^\W\d_]+$", body[-80:])
    return found, int(np.uint64(_number("w " + last[0].lower())).astype(np.int64)) if last and not _HAN.search(last[0]) else 0


def _count_contexts(bitmap: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            forms, ends, words, skip = [], [], [], []
            for answer in batch["answer"]:
                body = squeeze(answer or "").rstrip()
                f, e = _forms(body)
                if not f:
                    continue
                forms += ["^", *f]
                ends += [True, *e]
                skip += [False] * len(f) + [True]  # the last token says nothing of what may follow it
                words += re.findall(r"[^\W\d_]+(?=[\W\d_])", body.lower())
            if not forms:
                continue
            over = np.array(ends)
            numbers, reach = np.fromiter(map(_number, forms), dtype=np.uint64, count=len(forms)), _reach(over)
            goes = np.append(~over[1:], True)
            use = ~np.array(skip) & ~over
            keys, stops = [], []
            for h, ok in _contexts(numbers, reach):
                at = np.flatnonzero(use & ok)
                at = at[_marked(bitmap, h[at])]
                keys.append(h[at])
                stops.append(~goes[at])
            w = np.fromiter((_number("w " + x) for x in words), dtype=np.uint64, count=len(words))
            w = w[_marked(bitmap, w)]
            keys.append(w)
            stops.append(np.zeros(len(w), dtype=bool))
            key, stop = np.concatenate(keys), np.concatenate(stops)
            unique, at = np.unique(key, return_inverse=True)
            ended, seen = np.bincount(at, weights=stop, minlength=len(unique)), np.bincount(at, minlength=len(unique))
            yield pd.DataFrame({"h": unique.astype(np.int64), "ends": ended.astype(np.int64), "seen": seen.astype(np.int64)})

    return run


def _marked(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h >> np.uint64(64 - BITS)
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


# --- the vote table ---

VOTES = "answer_id bigint, kind string, empty string, copied_question string, other_language string, refusal string, truncated string, lang string, tail array<bigint>, half string"


def _votes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for answer_id, question, answer, kind, half in batch.itertuples(index=False, name=None):
            q, a = squeeze(question or ""), squeeze(answer or "")
            form = truncated_votes(a)
            tail = tail_contexts(a) if form[0] == "0" else None
            out.append((answer_id, kind, empty_votes(a), copied_votes(q, a), language_votes(q, a), refusal_votes(a), form, detect(q, 2), None if tail is None else [*tail[0], tail[1]], half))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in VOTES.split(", ")])


def _damage(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each pair damaged in one way, picked by its id (kind: half/defect); a way that the pair does not allow gives none."""
    declined = [a for _, a, kind in EXAMPLES if kind == "refusal"]
    nothing = [a for _, a, kind in EXAMPLES if kind == "empty"]
    for batch in batches:
        out = []
        rows = [(int.from_bytes(hashlib.blake2b(f"{i}".encode(), digest_size=6).digest(), "little"), half, q, a) for i, half, q, a in batch[["answer_id", "half", "question", "answer"]].itertuples(index=False, name=None)]
        langs = [detect(q, 2) for _, _, q, _ in rows]
        for n, (seed, half, q, a) in enumerate(rows):
            pick = lambda items, shift=1: items[(seed >> shift) % len(items)]
            way, damaged = DEFECTS[(seed >> 40) % len(DEFECTS)], None
            if way == "truncated" and re.search(r"[.!?。！？]\s*$", a) and len(a) > 60:
                cut = a[: int(len(a) * (0.3 + 0.65 * ((seed >> 8) % 1000) / 1000))].rstrip()
                damaged = cut if cut and cut[-1] not in _STOP else None
            elif way == "copied_question":
                words = q.split(" ")
                gone = (seed >> 4) % max(1, len(words))
                damaged = pick([q, q.lower(), q.upper(), "Question: " + q, f'"{q}"', " ".join(words[:gone] + words[gone + 1 :]) if len(words) > 4 else q])
            elif way in ("refusal", "empty"):
                damaged = pick(declined if way == "refusal" else nothing, 3)
            elif way == "other_language":
                far = next((m for m in range(n + 1, min(n + 60, len(rows))) if langs[m] and langs[n] and langs[m] != langs[n] and detect(rows[m][3], 3) == langs[m]), None)
                damaged = rows[far][3] if far is not None else None
            if damaged is not None:
                out.append((f"{half}/{way}", q, damaged))
        yield pd.DataFrame(out, columns=["kind", "question", "answer"])


def vote_table(pairs: DataFrame) -> DataFrame:
    """One row an answer_id with the vote string of each defect's functions and kind null; and the damaged and invented
    pairs with their kind. Every pair with a question and an answer over 40 characters is damaged in one way and counts
    as sound as it is, in the half named (other pairs have none). Redelivered rows count once; null texts are empty."""
    spark = pairs.sparkSession
    rows = durable(pairs.where("answer_id is not null").select("answer_id", "question", "answer").dropDuplicates(["answer_id"]))
    half = F.when(F.pmod(F.xxhash64("answer_id", F.lit(3)), F.lit(2)) == 0, "fit").otherwise("held")
    rows = rows.withColumn("half", F.when((F.col("question") != "") & (F.length("answer") > 40), half))
    known = [("held/" + (k or "none") if n % 2 else "fit/" + (k or "none"), q, a) for n, (q, a, k) in enumerate(EXAMPLES)]
    damaged = rows.where("half is not null").mapInPandas(_damage, "kind string, question string, answer string")
    test = damaged.unionByName(spark.createDataFrame(known, "kind string, question string, answer string"))
    test = test.select(F.lit(-1).cast("bigint").alias("answer_id"), "question", "answer", "kind", F.lit(None).cast("string").alias("half"))
    every = rows.withColumn("kind", F.lit(None).cast("string")).unionByName(test).select("answer_id", "question", "answer", "kind", "half")
    votes = durable(every.repartition(2 * spark.sparkContext.defaultParallelism).mapInPandas(_votes, VOTES))
    asked = votes.where("tail is not null").select(F.explode("tail").alias("h")).where("h <> 0").distinct()
    slot = F.shiftrightunsigned("h", 64 - BITS)
    parts = asked.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")).collect()
    bitmap = np.zeros(1 << (BITS - 3), dtype=np.uint8)
    for bucket, bits in parts:
        # Bucket b holds the numbers (b - 1) * 32768 + 1 .. b * 32768; position p stands for number (b - 1) * 32768 + 1 + p; 0 has the bucket 1, position 0.
        at = np.flatnonzero(np.unpackbits(np.frombuffer(bytes(bits), dtype=np.uint8), bitorder="little")) + (bucket - 1) * 32768
        for shift in (0, 1):
            n = at + shift
            n = n[n < 1 << BITS]
            np.bitwise_or.at(bitmap, n >> 3, (1 << (n & 7)).astype(np.uint8))
    sent = spark.sparkContext.broadcast(bitmap)
    count = lambda b: _count_contexts(sent.value)(b)
    counts = rows.select("answer").repartition(2 * spark.sparkContext.defaultParallelism).mapInPandas(count, "h bigint, ends bigint, seen bigint").groupBy("h").agg(F.sum("ends").alias("ends"), F.sum("seen").alias("seen"))
    # A tail that many answers share is one row from here on.
    tails = votes.where("tail is not null").select("tail").distinct().withColumn("tail_no", F.xxhash64("tail"))
    each = tails.select("tail_no", F.posexplode("tail").alias("k", "h")).where("h <> 0").join(durable(counts), "h", "left")
    of = lambda k, c: F.coalesce(F.max(F.when(F.col("k") == k, F.col(c))), F.lit(0))
    wide = each.groupBy("tail_no").agg(*[of(k, "ends").alias(f"e{k}") for k in range(ORDERS)], *[of(k, "seen").alias(f"s{k}") for k in range(ORDERS)], of(ORDERS, "seen").alias("word_seen"), F.max((F.col("k") == ORDERS).cast("int")).alias("has_word"))
    share = lambda k: F.col(f"e{k}") / F.greatest(F.col(f"s{k}"), F.lit(1))
    say = lambda k, least, low, high: F.when(F.col(f"s{k}") >= least, F.when(share(k) <= low, "+").when(share(k) >= high, "-").otherwise("0"))
    dangling = F.when((F.col("s0") >= 20) & (share(0) < 0.004), "+").otherwise("0")
    fragment = F.when((F.col("has_word") == 1) & (F.col("word_seen") <= 1), "+").otherwise("0")
    far = F.coalesce(say(5, 3, 0.02, 0.4), say(4, 3, 0.02, 0.4), say(3, 3, 0.02, 0.4), F.lit("0"))
    near = F.when(far != "0", "0").otherwise(F.coalesce(say(2, 5, 0.02, 0.3), say(1, 5, 0.02, 0.3), F.lit("0")))  # a longer context says more
    judged = wide.select("tail_no", F.concat(dangling, fragment, near, far).alias("by_count"))
    joined = votes.withColumn("tail_no", F.xxhash64("tail")).join(small_side(durable(judged), 200_000), "tail_no", "left")
    return joined.withColumn("truncated", F.concat("truncated", F.coalesce("by_count", F.lit("0000")))).select("answer_id", "kind", "half", "lang", *DEFECTS)


class LabelModel:
    """Two classes, functions independent given the class, fitted by expectation-maximization under sign constraints.

    A function's + speaks for the defect by odds of at least 3, its - against it by as much, neither by more than 1000;
    its silence says nothing, so that no class can be made of answers on which nothing was said. The fitted odds are
    drawn half-way (in logarithms) to the start of 100 to 1: a function that mostly speaks alone cannot be told right or
    wrong from the patterns, and keeps that.
    """

    START = np.log(np.array([100.0, 1.0, 1 / 100]))

    LOW = np.log(np.array([3.0, 1.0, 1e-3]))
    HIGH = np.log(np.array([1e3, 1.0, 1 / 3]))

    def __init__(self, patterns: list[str], counts: np.ndarray, prior: float = 0.1, rounds: int = 200):
        columns = self._columns(patterns)
        self.prior, functions = prior, columns.shape[1]
        self.odds = np.tile(self.START, (functions, 1))
        total = max(counts.sum(), 1.0)
        for _ in range(rounds):
            p = self._posterior(columns)
            mass = np.stack([p * counts, (1 - p) * counts])
            self.prior = float(np.clip((mass[0].sum() + 0.5) / (total + 10), 0.02, 0.3))
            tables = np.stack([[np.bincount(columns[:, i], weights=m, minlength=3) for m in mass] for i in range(functions)]) + 0.5
            tables /= tables.sum(axis=2, keepdims=True)
            new = (np.clip(np.log(tables[:, 0]) - np.log(tables[:, 1]), self.LOW, self.HIGH) + self.START) / 2
            moved, self.odds = np.abs(new - self.odds).max(), new
            if moved < 1e-6:
                break

    @staticmethod
    def _columns(patterns: list[str]) -> np.ndarray:
        return np.array([["+0-".index(ch) for ch in p] for p in patterns], dtype=int).reshape(len(patterns), -1)

    def _posterior(self, columns: np.ndarray) -> np.ndarray:
        log = np.log(self.prior / (1 - self.prior)) + self.odds[np.arange(columns.shape[1])[None], columns].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(log, -700, 700)))

    def posterior(self, patterns: list[str]) -> np.ndarray:
        return self._posterior(self._columns(patterns)) if patterns else np.zeros(0)


def _cutoff(scores: np.ndarray, truth: np.ndarray, weights: np.ndarray) -> float:
    """The cutoff with the best F1 on the validation pairs, in the middle of its gap, between a half and 0.95."""
    points = np.unique(np.concatenate([[0.0, 1.0], scores]))
    best, at = -1.0, 0.5
    for low, high in zip(points, points[1:]):
        cut = (low + high) / 2
        over = scores > cut
        f1 = 2 * (weights * truth * over).sum() / max(1e-9, (weights * over).sum() + (weights * truth).sum())
        if f1 > best + 1e-12:
            best, at = f1, cut
    return float(min(max(at, 0.5), 0.95))


def _fitted(votes: DataFrame, defect: str) -> tuple[LabelModel, float, list] | None:
    rows = votes.where("kind is null").groupBy(defect).count().collect()
    if not rows:
        return None
    model = LabelModel([r[0] for r in rows], np.array([r[1] for r in rows], dtype=float))
    test = votes.where("kind is not null").groupBy(defect, "kind", "lang").count().collect()
    test += votes.where("kind is null and half is not null").groupBy(defect, F.concat("half", F.lit("/none")).alias("kind"), "lang").count().collect()
    kinds = [r for r in test if r["kind"].endswith(("/none", "/" + defect))]
    fit = [r for r in kinds if r["kind"].startswith("fit/")]
    bad, weights = np.array([r["kind"].endswith(defect) for r in fit], dtype=bool), np.array([float(r["count"]) for r in fit])
    weights[~bad] *= weights[bad].sum() / max(1.0, weights[~bad].sum())  # sound and damaged pairs weigh alike: a pair is damaged in one way of several
    cut = _cutoff(model.posterior([r[0] for r in fit]), bad, weights) if fit else 0.5
    return model, cut, [r for r in kinds if r["kind"].startswith("held/")]


def find_defects(pairs: DataFrame) -> DataFrame:
    """answer_id, defect_type, defect_no, posterior: one row for every defect of every pair whose posterior exceeds the cutoff.

    Null and blank answers are `empty`; a null question leaves the votes on copies and languages out; repeated
    answer_ids count once; an empty table gives no rows.
    """
    votes = durable(vote_table(pairs))
    spark = votes.sparkSession
    marked = None
    for n, defect in enumerate(DEFECTS):
        fitted = _fitted(votes, defect)
        if fitted is None:
            continue
        model, cut, _ = fitted
        seen = [r[0] for r in votes.where("kind is null").select(defect).distinct().collect()]  # at most 3^9 patterns
        over = [(s, float(p)) for s, p in zip(seen, model.posterior(seen)) if p > cut]
        if over:
            table = spark.createDataFrame(over, f"{defect} string, posterior double")
            part = votes.where("kind is null").join(F.broadcast(table), defect).select("answer_id", F.lit(defect).alias("defect_type"), F.lit(n).alias("defect_no"), "posterior")
            marked = part if marked is None else marked.unionByName(part)
    if marked is None:
        return spark.createDataFrame([], "answer_id bigint, defect_type string, defect_no int, posterior double")
    return marked


def validation(pairs: DataFrame) -> DataFrame:
    """defect_type, lang, damaged, found, sound, wrongly_found, cutoff: the held-out half of the damaged and invented pairs.

    `sound` are the pairs as they are, so those of them that are defective count as wrongly found.
    """
    votes = durable(vote_table(pairs))
    out = []
    for defect in DEFECTS:
        fitted = _fitted(votes, defect)
        if fitted is None:
            continue
        model, cut, held = fitted
        tally: dict[str, list[int]] = {}
        for r, p in zip(held, model.posterior([r[0] for r in held])):
            at = tally.setdefault(r["lang"] or "und", [0, 0, 0, 0])
            bad = r["kind"].endswith(defect)
            at[0 if bad else 2] += r["count"]
            at[1 if bad else 3] += r["count"] * bool(p > cut)
        out += [(defect, lang, *t, round(cut, 4)) for lang, t in sorted(tally.items())]
    return votes.sparkSession.createDataFrame(out, "defect_type string, lang string, damaged long, found long, sound long, wrongly_found long, cutoff double")
