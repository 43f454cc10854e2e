"""Text statistics of every document, exact ranks within each language, and outlier scores from their tail probabilities.

Statistics are computed over whole texts. Each (language, statistic) is ranked over the distinct texts by a
range-partitioned sort with partition offsets, which gives every value its empirical tail probabilities. A class (list,
table, junk) has a combined tail probability, the largest of those of its statistics; a document is a candidate of the
class where that lies under the language's cutoff, and an exact check of what most of the text is follows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knotwork.functions.sizes import small_side
from knotwork.llm.language import HAN, MAIN
from knotwork.session import durable

STATS = ["n_words", "word_len", "symbol_share", "digit_share", "stop_lines", "common_share", "distinct_share", "item_share", "cell_share", "noise_share"]
LOW, HIGH = "low", "high"
# Fixed choice: the tail of each statistic in which texts stop looking like prose.
TAILS = {"word_len": (LOW, HIGH), "symbol_share": (HIGH,), "digit_share": (HIGH,), "stop_lines": (LOW,), "common_share": (LOW, HIGH), "distinct_share": (LOW,), "item_share": (HIGH,), "cell_share": (HIGH,), "noise_share": (HIGH,)}
# Fixed choice: the statistics whose tails make up a class.
CLASSES = {"list": (("item_share", HIGH), ("common_share", LOW)), "table": (("cell_share", HIGH), ("common_share", LOW)), "junk": (("noise_share", HIGH),)}
PRIOR_TEXTS = 50  # weight, in texts, of the ranks over all languages in those of one language
SLACK = 0.05  # by how much a class's cutoff exceeds the share of the language's texts that is no prose
EVERY = frozenset().union(*MAIN.values())
_ITEM = re.compile(r"^(?:[-*+•‣·▪◦●○■□–—>]|\d{1,3}[.)]|\(\d{1,3}\)|\[\d{1,3}\]|\[[ xX✓✔]?\]|[☐☑☒✓✔]|[a-zA-Z][.)]|\([a-z]\)|[ivx]{1,4}[.)])\s+")
_LEADER = re.compile(r"(?:\.{3,}|…|(?:\s\.){3,}|_{3,}|\t)\s*\d+(?:[,\s-]+\d+)*$|,\s*\d{1,4}(?:[,–-]\s*\d{1,4})*$")
_GLOSS = re.compile(r"^[^:.!?]{2,60}:\s*\S[^.!?]{0,40}$")
_REFERENCE = re.compile(r"\((?:19|20)\d\d[a-z]?\)|\b(?:19|20)\d\d\b[a-z]?.*(?:\d+\s*[:,(]|pp?\.|doi|et al|vol)|et al\.|\bdoi\b", re.I)
_RULE = re.compile(r"^[\s|+\-=:_─━│┼┌┐└┘├┤┬┴*#]{3,}$")
_LATEX = re.compile(r"\\(?:begin|end)\{(?:tabular|table|array|longtable)|\\(?:hline|toprule|midrule|bottomrule)|&.*\\\\\s*$")
_TABLE_TAG = re.compile(r"</?(?:table|tr|td|th|tbody|thead)\b", re.I)
_TAG = re.compile(r"<[^<>\n]{1,200}>|&(?:#\d+|\w+);")
_HEX = re.compile(r"^(?:[0-9a-fA-F]{6,16}[:\s]\s*)?(?:[0-9a-fA-F]{2,4}\s+){4,}")
_CLUMP = re.compile(r"[bcdfghjklmnpqrstvwxz]{4,}")
_BROKEN = re.compile("�|[ÂÃÐÑâ][-¿‚„†‡‰‹Œ‘’“”•–—™›œžŸ€ƒ…ˆ˜Šš¡-¿]")
_CJK = re.compile("[㐀-鿿]")
_SPLIT = re.compile(r"\s*[;,|•·]\s+|\s+[/|·•–-]\s+|\s*[;；、]\s*")
_PLAIN = re.compile(" (?:the|is|was|a|of|to|der|die|das|und|war|wurde|la|el|le|se|les|est|été|una?|в|и|на|не|с) ")
_MARKS = re.compile(r"[|\t&<\\─│┌└├━]|;(?! )| ;|,\S|  |\.\.\.|…|^[-+=:_]{3}|^[0-9a-fA-F]{2,16}[:\s]+[0-9a-fA-F]{2}\s|\d$")
_HEXWORD = re.compile(r"[0-9a-f]+$")
_GAP = re.compile(r"\S\s{2,}(?=\S)")
_SENTENCES = re.compile(r"[a-zа-я]\.\s+[A-ZА-Я]")
_SYMBOL = re.compile(r"[^\w\s]|_")
_ODD = re.compile("[�ÂÃÐÑâ]")
_ENDS = tuple(".!?。！？:;…\"”’)»")


def _kind(line: str) -> str:
    """prose, item, cell, noise, short, gap (wide blanks) or rule: what a line, stripped, looks like."""
    if line[-1] in ".!?。！？" and len(line) > 60 and line[0].isalpha() and "|" not in line and "\t" not in line and "  " not in line and "<" not in line and "\\" not in line and "..." not in line and line.count(";") < 3 + len(line) // 100 and _PLAIN.search(line):
        return "prose"
    words = line.lower().split()
    n = len(words)
    common = sum(map(EVERY.__contains__, words))
    han = 0 if line.isascii() else len(_CJK.findall(line))
    size = n + han // 2
    item = _ITEM.match(line)
    if _MARKS.search(line):
        if _TABLE_TAG.search(line) or _LATEX.search(line):
            return "cell"
        if line[0] in "|+-=:_─━│┌└├" and _RULE.match(line):
            return "rule"
        if _HEX.match(line) and sum(len(w) <= 4 and bool(_HEXWORD.match(w)) for w in words) > 0.6 * n:
            return "noise"
        bars, tabs = line.count("|"), line.count("\t")
        if tabs >= 1 and common < 0.25 * n and size < 60 and not _LEADER.search(line) or bars >= 2 and line[0] == "|" or bars >= 1 and line.count(" | ") == bars and common < 0.2 * n and _cells(line.split("|")):
            return "cell"
        if "  " in line and common < 0.25 * n and not item and not _LEADER.search(line) and _GAP.search(line):
            return "gap"
        if common <= 0.25 * n:
            semis, commas = line.count(";"), line.count(",")
            if semis and (line.count("; ") < semis or line.count(" ; ") == semis) and _cells(line.split(";")):
                return "cell"
            if commas and line.count(", ") < commas and _cells(line.split(",")):
                return "cell"
        tags = _TAG.findall(line)
        if tags and sum(map(len, tags)) > 0.4 * len(line):
            return "noise"
        if common <= 0.3 * n and size <= 16 and _LEADER.search(line):
            return "item"
    if n <= 2 and len(line) > 40 and not han and " " not in line:
        return "noise"
    if item:
        if _REFERENCE.search(line):
            return "item"
        rest = size - 1
        if rest <= 3 or not (line.endswith((".", "!", "?", "。", "！", "？")) and rest >= 7) and (common <= 0.34 * n or rest <= 10):
            return "item"
        return "prose"
    if common > 0.2 * n and size > 10:
        return "prose"
    if common <= 0.2 * n and size <= 40 and _REFERENCE.search(line):
        return "item"
    if common <= 0.16 * max(n, 1):
        parts = [p for p in _SPLIT.split(line) if p]
        if len(parts) >= 4 and size / len(parts) <= 9 and not _SENTENCES.search(line):
            return "item"
    if size <= 10 and not line.endswith((".", "!", "?", "。", "！", "？")) and common <= 0.35 * n and _GLOSS.match(line):
        return "item"
    if size <= 8 and not line.endswith(_ENDS) and common <= 0.3 * n:
        return "short"
    return "prose"


def _cells(fields: list[str]) -> bool:
    """Whether fields look like a table's row: some are numbers or blanks marks, the others short."""
    kept = [f.strip() for f in fields]
    plain = sum(bool(re.fullmatch(r"[-–—+±<>≤≥~]?\s*[\d.,]+\s*\S{0,6}|n\.?d\.?|n/?a|-+|–|—|", f, re.I)) for f in kept)
    return len(kept) >= 2 and all(len(f) <= 60 for f in kept) and (plain >= 0.3 * len(kept) or len(kept) >= 3 and all(len(f.split()) <= 5 for f in kept))


def describe(text: str) -> tuple:
    """The statistics of one text in the order of STATS, its language, and the shares of its lines' characters by kind."""
    words = text.lower().split()
    n = len(words)
    chars = max(1, len(text) - sum(map(text.count, " \n\t\r")))
    counts = {k: 0 for k in MAIN}
    tally = Counter(words)
    common = 0
    for w in EVERY.intersection(tally):
        c = tally[w]
        common += c
        for k, s in MAIN.items():
            if w in s:
                counts[k] += c
    han = 0
    if not text.isascii() and _CJK.search(text):
        found = _CJK.findall(text)
        han = len(found)
    language = max(counts, key=counts.get)
    if han * 3 > chars:
        language, common_share = "zh", sum(c in HAN for c in found) / han
        units = han
    else:
        common_share, units = common / max(1, n), n
        if counts[language] < 2:
            language = None
    lines = [x for raw in text.splitlines() if (x := raw.strip())]
    seen = Counter(lines)
    sizes = {"prose": 0, "item": 0, "cell": 0, "noise": 0, "short": 0, "rule": 0, "gap": 0}
    stop_lines = 0
    for line in lines:
        stop_lines += line.endswith(_ENDS)
        kind = _kind(line)
        if seen[line] >= 4 and len(lines) >= 6 and kind != "rule" and (len(line) > 6 or seen[line] > 0.5 * len(lines)) and seen[line] * 6 > len(lines):
            kind = "noise"
        sizes[kind] += len(line)
    total = max(1, sum(sizes.values()))
    many = len(lines) >= 3
    # A table's rules and its wide gaps count with the cells; short lines are a list where several make up the text.
    if sizes["gap"] + sizes["rule"] + sizes["cell"] > 0.3 * total or sizes["cell"]:
        sizes["cell"] += sizes["gap"] + sizes["rule"]
    else:
        sizes["noise" if sizes["gap"] > sizes["prose"] and len(seen) < 0.5 * len(lines) else "prose"] += sizes["gap"] + sizes["rule"]
    short = sum(1 for x in seen if len(x.split()) <= 8)
    sizes["item" if many and (sizes["item"] or short >= 3) and sizes["short"] + sizes["item"] > 0.4 * total else "prose"] += sizes["short"]
    digits = sum(map(text.count, "0123456789"))
    symbols = len(_SYMBOL.findall(text))
    letters = chars - digits - symbols
    broken = len(_BROKEN.findall(text)) / chars if not text.isascii() and _ODD.search(text) else 0.0
    distinct = len(tally) / max(1, n)
    noise = sizes["noise"] / total
    structured = (sizes["item"] + sizes["cell"]) / total
    if broken > 0.02:
        noise = 1.0
    elif n >= 8 and distinct < 0.25 and common_share < 0.25 and max((c for w, c in tally.items() if len(w) >= 4), default=0) > 0.2 * n:
        noise = max(noise, 0.9)
    elif han * 3 <= chars and structured < 0.5:
        if n >= 8 and common_share < 0.04 and _clumps(tally) > 0.3:
            noise = max(noise, 0.95)  # letters that make no words
        elif n >= 12 and (common_share > 0.75 or common_share > 0.62 and distinct < 0.75):
            noise = max(noise, 0.9)  # common words only, in no sentence
        elif symbols > 0.35 * chars and common_share < 0.1:
            noise = max(noise, 0.9)
        elif n >= 1 and chars / n > 25 and common_share < 0.05:
            noise = max(noise, 0.9)
    elif structured >= 0.5 and symbols - text.count(".") > 0.45 * chars and common_share < 0.05 and letters < 0.35 * chars and sizes["cell"] < 0.8 * total:
        noise = max(noise, 0.9)
    values = (float(units), chars / max(1, n), symbols / chars, digits / chars, stop_lines / max(1, len(lines)), common_share, distinct, sizes["item"] / total, sizes["cell"] / total, noise)
    return (*values, language)


def _clumps(tally: Counter) -> float:
    """Share of the longer Latin words with four consonants in a row or no vowel."""
    latin = [w for w in tally if w.isalpha() and w.isascii() and len(w) >= 3]
    return sum(bool(_CLUMP.search(w)) or not re.search("[aeiouy]", w) for w in latin) / max(1, len(latin))


def _describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = [(i, h, *describe(text), lang) for i, h, text, lang in batch.itertuples(index=False, name=None)]
        frame = pd.DataFrame(out, columns=["doc_id", "text_hash", *STATS, "found", "lang"])
        frame["lang"] = frame["found"].where(frame["found"].notna(), frame["lang"])
        yield frame.drop(columns="found")


def statistics(documents: DataFrame) -> DataFrame:
    """doc_id, text_hash, the statistics and the language (by the text's own words, else as stated, else `und`). Null and blank texts are left out; each doc_id counts once."""
    rows = documents.where("doc_id is not null and text is not null").where(F.col("text").rlike(r"[^\s\p{Z}\p{Cf}\p{Cc}]")).select("doc_id", F.xxhash64("text").alias("text_hash"), "text", "lang")
    out = rows.mapInPandas(_describe, "doc_id bigint, text_hash bigint, " + ", ".join(f"{s} double" for s in STATS) + ", lang string")
    return out.withColumn("lang", F.coalesce("lang", F.lit(NONE))).dropDuplicates(["doc_id"])


NONE, ALL = "und", "*"  # texts without a known language; the ranks over all languages


def tail_probabilities(stats: DataFrame, names: list[str]) -> DataFrame:
    """(lang, stat, value) with the shares of the language's distinct texts at or below and at or above the value; the rows of `*` are over all languages.

    A text counts once however many documents hold it, and equal values are counted before the sort, so a value that a
    third of the documents share is one row. The sort is range-partitioned; a partition's running count is shifted by
    the totals of the partitions before it (one row a partition, language and statistic).
    """
    once = stats.dropDuplicates(["text_hash"])
    long = once.select("lang", F.explode(F.array(*[F.struct(F.lit(i).alias("stat"), F.col(n).alias("value")) for i, n in enumerate(names)])).alias("s")).select("lang", "s.stat", "s.value")
    counts = long.groupBy("lang", "stat", "value").count()
    counts = durable(counts)
    counts = counts.unionByName(counts.groupBy("stat", "value").agg(F.sum("count").alias("count")).withColumn("lang", F.lit(ALL)))
    ranged = durable(counts.repartitionByRange("stat", "lang", "value").withColumn("part", F.spark_partition_id()))
    inside = Window.partitionBy("part", "lang", "stat").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = ranged.withColumn("upto", F.sum("count").over(inside))
    totals = ranged.groupBy("part", "lang", "stat").agg(F.sum("count").alias("n"))
    group = Window.partitionBy("lang", "stat")
    offsets = totals.select("part", "lang", "stat", (F.sum("n").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")).alias("before"), F.sum("n").over(group).alias("all"))
    placed = running.join(small_side(offsets), ["part", "lang", "stat"])
    at_or_below = F.col("before") + F.col("upto")
    return placed.select("lang", "stat", "value", "count", "all", (at_or_below / F.col("all")).alias("below"), ((F.col("all") - at_or_below + F.col("count")) / F.col("all")).alias("above"))


def blended(tails: DataFrame) -> DataFrame:
    """The languages' tails, each leaning on those over all languages with the weight of PRIOR_TEXTS texts; texts of no known language lean on them wholly."""
    pooled = tails.where(F.col("lang") == ALL).select("stat", "value", F.col("below").alias("all_below"), F.col("above").alias("all_above"))
    own = F.when(F.col("lang") == NONE, 0).otherwise(F.col("all"))
    mean = lambda c: ((own * F.col(c) + PRIOR_TEXTS * F.col(f"all_{c}")) / (own + PRIOR_TEXTS)).alias(c)
    return tails.where(F.col("lang") != ALL).join(pooled, ["stat", "value"]).select("lang", "stat", "value", "count", mean("below"), mean("above"))


HOT = 20_000  # a value that more texts share is joined by broadcast; of n texts at most n / HOT values a statistic are


def outlier_scores(stats: DataFrame, names: list[str] | None = None) -> DataFrame:
    """The statistics with `score` (sum of -log tail probabilities over all tails that matter), `peak` (the largest of them), `peers` (documents of the language) and, for each class, its combined tail probability `p_<class>`. `names` are the statistics to rank, all with tails if not given."""
    names = names or list(TAILS)
    tails = durable(blended(tail_probabilities(stats, names)))
    longest = F.explode(F.array(*[F.struct(F.lit(i).alias("stat"), F.col(n).alias("value")) for i, n in enumerate(names)])).alias("s")
    long = stats.select("doc_id", "lang", longest).select("doc_id", "lang", "s.stat", "s.value")
    hot = tails.where(F.col("count") >= HOT).select("lang", "stat", "value", F.struct("below", "above").alias("hot"))
    first = long.join(small_side(hot), ["lang", "stat", "value"], "left")
    cold = first.where("hot is null").drop("hot").join(tails.where(F.col("count") < HOT).drop("count"), ["lang", "stat", "value"])
    both = cold.select("doc_id", "stat", "below", "above").unionByName(first.where("hot is not null").select("doc_id", "stat", "hot.below", "hot.above"))
    worst = None
    for i, n in enumerate(names):
        p = F.least(F.lit(1.0), *[F.col("below" if t == LOW else "above") for t in TAILS[n]])
        worst = F.when(F.col("stat") == i, p) if worst is None else worst.when(F.col("stat") == i, p)
    joint = lambda parts: F.max(F.coalesce(*[F.when(F.col("stat") == names.index(n), F.col("below" if t == LOW else "above")) for n, t in parts]))
    scores = both.withColumn("penalty", -F.log(worst)).groupBy("doc_id").agg(F.round(F.sum("penalty"), 4).alias("score"), F.round(F.max("penalty"), 4).alias("peak"), *[joint(parts).alias(f"p_{c}") for c, parts in CLASSES.items()])
    peers = small_side(stats.groupBy("lang").agg(F.count("*").alias("peers")))
    return stats.join(scores, "doc_id").join(peers, "lang")


DECIDING = sorted({n for parts in CLASSES.values() for n, _ in parts})
SHARES = {"list": "item_share", "table": "cell_share", "junk": "noise_share"}


def classify(documents: DataFrame, names: list[str] | None = None) -> DataFrame:
    """doc_id, the statistics, lang, score, peak, the classes' tail probabilities and doc_class (prose, list, table, junk).

    A document is a candidate of the classes whose combined tail probability is under the language's cutoff, which lies
    SLACK over the share of its distinct texts that are no prose by the exact shares (so that a language full of lists
    keeps its lists). Of the candidates' classes the one that makes up over half of the text is taken, else, where the
    classes together make up over 0.6, the one with the least tail probability. Ties share their ranks; an empty table
    gives no rows; very long texts are read whole.
    """
    scored = durable(outlier_scores(durable(statistics(documents)), names))
    structured = F.greatest(*[F.col(s) for s in SHARES.values()]) > 0.5
    share = F.avg(structured.cast("double")) * 1.1 + SLACK
    once = scored.dropDuplicates(["text_hash"])
    overall = once.agg(share).first()[0]
    lean = F.when(F.col("lang") == NONE, 0).otherwise(F.count("*"))
    cutoffs = once.groupBy("lang").agg(((lean * share + PRIOR_TEXTS * F.lit(overall).cast("double")) / (lean + PRIOR_TEXTS)).alias("cutoff"))
    open_to = {c: F.col(f"p_{c}") <= F.col("cutoff") for c in CLASSES}
    total = sum(F.when(open_to[c], F.col(s)).otherwise(0.0) for c, s in SHARES.items())
    most = F.when(open_to["junk"] & (F.col("noise_share") > 0.5), "junk").when(open_to["table"] & (F.col("cell_share") > 0.5) & (F.col("cell_share") >= F.col("item_share")), "table").when(open_to["list"] & (F.col("item_share") > 0.5), "list")
    likeliest = F.array_min(F.array(*[F.struct(F.when(open_to[c], F.col(f"p_{c}")).otherwise(2.0).alias("p"), (-F.col(s)).alias("share"), F.lit(c).alias("c")) for c, s in SHARES.items()]))
    out = scored.join(small_side(cutoffs), "lang").withColumn("doc_class", F.coalesce(most, F.when(total > 0.6, likeliest.c), F.lit("prose")))
    return out.withColumn("candidate", F.coalesce(*[F.when(open_to[c], True) for c in CLASSES], F.lit(False))).drop("text_hash", "cutoff")
