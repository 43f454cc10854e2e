"""Readers of the interchange formats: key-value JSON, JSON lines, corpora, graphs, configuration.

Pickled files are not read: loading them would run code from the file.
"""

from __future__ import annotations

import json
import re
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TEXT_SUFFIXES = (".md", ".markdown", ".txt")
ALLOWED_UPLOADS = (".txt", ".md", ".pdf", ".docx", ".doc")


def kv_json(spark: SparkSession, path: str) -> DataFrame:
    """key, value (JSON text) of a file holding one JSON object; a missing file gives no rows. A leading byte-order mark is ignored."""
    if "://" not in path and not os.path.exists(path):
        return spark.createDataFrame([], "key string, value string")
    whole = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^﻿", "").alias("t"))
    return whole.select(F.explode(F.from_json("t", "map<string,string>")).alias("key", "value"))


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines file; blank and undecodable lines are skipped."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", f"{schema}, _broken string", {"columnNameOfCorruptRecord": "_broken"}).alias("r")).where("r is not null and r._broken is null").select("r.*").drop("_broken")


def unique_contexts(spark: SparkSession, path: str) -> DataFrame:
    """context, place: the distinct `context` fields of a JSON-lines file by first occurrence."""
    rows = jsonl(spark, path, "context string").where("context is not null").withColumn("place", F.monotonically_increasing_id())
    return rows.groupBy("context").agg(F.min("place").alias("place"))


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """name, content of the text files under a folder, each headed by its name."""
    rows = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).load(path).select(F.col("value"), F.input_file_name().alias("file"))
    kept = rows.where(F.lower("file").rlike(r"\.(md|markdown|txt)$"))
    name = F.element_at(F.split("file", "/"), -1)
    return kept.select(name.alias("name"), F.concat(F.lit("# Source File: "), name, F.lit("\n\n"), "value").alias("content"))


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """name, size, md5, content of uploaded files: text as UTF-8, other kinds through the optional readers, else what decodes."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    from collections.abc import Iterator

    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["content"] = [_text_of(n, bytes(c)) for n, c in zip(batch["name"], batch["body"])]
            yield batch[["name", "size", "md5", "content"]]

    allowed = F.lower(name).rlike("(" + "|".join(s.replace(".", r"\.") for s in ALLOWED_UPLOADS) + ")$")
    return rows.where(allowed).select(name.alias("name"), F.col("length").alias("size"), F.md5("content").alias("md5"), F.col("content").alias("body")).mapInPandas(run, "name string, size bigint, md5 string, content string")


def _text_of(name: str, body: bytes) -> str:
    import io

    low = name.lower()
    if low.endswith(".pdf"):
        try:
            from pypdf import PdfReader
        except ImportError as e:
            raise RuntimeError(f"{name}: no PDF reader is installed") from e
        return "\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(body)).pages)
    if low.endswith(".docx"):
        import zipfile
        from xml.etree import ElementTree

        with zipfile.ZipFile(io.BytesIO(body)) as z:
            root = ElementTree.fromstring(z.read("word/document.xml"))
        space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
        return "\n".join("".join(t.text or "" for t in p.iter(f"{space}t")) for p in root.iter(f"{space}p"))
    return body.decode("utf-8", "ignore")


def graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a GraphML file: id, data map; source, target, data map. Quotes around values are taken off."""
    whole = spark.read.text(path, wholetext=True)
    bare = lambda c: F.regexp_replace(c, r'^"|"$', "")
    unescape = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&quot;"), F.lit('"')), F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))
    keys = F.map_from_entries(F.transform(F.regexp_extract_all("value", F.lit(r"(<key [^>]*>)"), F.lit(1)), lambda k: F.struct(F.regexp_extract(k, r'\bid="([^"]*)"', 1), F.regexp_extract(k, r'attr\.name="([^"]*)"', 1))))
    doc = whole.select("value", keys.alias("names"))

    def part(tag: str) -> DataFrame:
        each = doc.select("names", F.explode(F.regexp_extract_all("value", F.lit(rf"(?s)(<{tag} .*?(?:</{tag}>|/>))"), F.lit(1))).alias("x"))
        data = F.map_from_entries(F.transform(F.regexp_extract_all("x", F.lit(r"(?s)(<data [^>]*>.*?</data>)"), F.lit(1)), lambda t: F.struct(F.regexp_extract(t, r'key="([^"]*)"', 1).alias("k"), bare(unescape(F.regexp_extract(t, r"(?s)<data [^>]*>(.*?)</data>", 1))).alias("v"))))
        return each.withColumn("d", data).withColumn("data", F.transform_keys("d", lambda k, _: F.coalesce(F.try_element_at(F.col("names"), k), k)))

    attribute = lambda n: bare(unescape(F.regexp_extract("x", rf'{n}="([^"]*)"', 1)))
    return part("node").select(attribute("id").alias("id"), "data"), part("edge").select(attribute("source").alias("source"), attribute("target").alias("target"), "data")


def config(path: str | Path) -> dict:
    """A YAML or JSON configuration file; an empty or missing one is an empty dict."""
    path = Path(path)
    if not path.exists():
        return {}
    text = path.read_text(encoding="utf-8-sig")
    if path.suffix in (".yaml", ".yml"):
        import yaml

        return yaml.safe_load(text) or {}
    return json.loads(text or "{}")


def registry(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Canonical entities of configuration files (under `entities` or `canonical_entities`), in file order; missing files are skipped."""
    rows = []
    for path in paths:
        data = config(path)
        for e in data.get("entities") or data.get("canonical_entities") or []:
            rows.append((len(rows) + 1, e["canonical_id"], e.get("canonical_name"), e.get("entity_type"), e.get("semantic_group"), e.get("parent_id"), list(e.get("aliases") or [])))
    return spark.createDataFrame(rows, "entity_no bigint, canonical_id string, canonical_name string, entity_type string, semantic_group string, parent_id string, aliases array<string>")


def gold_facts(spark: SparkSession, path: str) -> DataFrame:
    """fact_id, claim, required (array of kind, element) from a list or {gold_facts: [...]}.

    Entities and mechanisms are required as they are named; conditions and measurements under the id that their type,
    value and unit make.
    """
    from knotwork.operators.evaluate import expected_condition, expected_metric

    data = json.loads(Path(path).read_text(encoding="utf-8-sig"), strict=False)
    rows, facts = [], []
    number = lambda v: float(v) if isinstance(v, (int, float)) or isinstance(v, str) and re.fullmatch(r"[-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?", v) else None
    for i, f in enumerate(data["gold_facts"] if isinstance(data, dict) else data):
        fact_id = str(f.get("fact_id", i))
        facts.append((i, fact_id, f.get("claim")))
        need = [("entities", x, None, None) for x in f.get("required_entities") or []]
        need += [("conditions", c.get("quantity_type") or c.get("type") or c.get("canonical_id") or "", number(c.get("value")), c.get("unit")) for c in f.get("required_conditions") or []]
        need += [("measurements", m.get("metric_type") or m.get("type") or m.get("canonical_id") or "", number(m.get("value")), m.get("unit")) for m in f.get("required_metrics") or []]
        need += [("mechanisms", x, None, None) for x in f.get("required_mechanisms") or []]
        rows += [(i, n, *r) for n, r in enumerate(need)]
    each = spark.createDataFrame(rows, "at bigint, n int, kind string, name string, value double, unit string")
    kind, name, value, unit = (F.col(c) for c in ("kind", "name", "value", "unit"))
    element = F.when(kind == "conditions", expected_condition(name, value, unit)).when(kind == "measurements", expected_metric(name, value, unit)).otherwise(name)
    required = each.select("at", "n", "kind", element.alias("element")).groupBy("at").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "kind", "element"))), lambda x: F.struct(x.kind.alias("kind"), x.element.alias("element"))).alias("required"))
    whole = spark.createDataFrame(facts, "at bigint, fact_id string, claim string").join(required, "at", "left")
    return whole.select("fact_id", "claim", F.coalesce("required", F.array().cast("array<struct<kind:string,element:string>>")).alias("required"))


def answers(spark: SparkSession, path: str) -> DataFrame:
    """question_id, question, answer of the three shapes: a list, {answers: [...]}, or question -> answer or object."""
    data = json.loads(Path(path).read_text(encoding="utf-8-sig"))
    if isinstance(data, dict):
        data = data["answers"] if isinstance(data.get("answers"), list) else [({"question": q} | a) if isinstance(a, dict) else {"question": q, "answer": a} for q, a in data.items()]
    rows = [(str(a.get("question_id", i)), a.get("question"), a.get("answer")) for i, a in enumerate(data)]
    return spark.createDataFrame(rows, "question_id string, question string, answer string")


def vectors(spark: SparkSession, path: str) -> DataFrame:
    """vec_id, embedding of a vector store file: {data: [{__id__, ...}], matrix: base64 of float32 rows}."""
    import base64

    import numpy as np

    data = json.loads(Path(path).read_text(encoding="utf-8-sig"))
    ids = [r["__id__"] for r in data["data"]]
    matrix = np.frombuffer(base64.b64decode(data["matrix"]), dtype="<f4").reshape(len(ids), -1) if ids else []
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in zip(ids, matrix)], "vec_id string, embedding array<float>")


def databases(root: str, table: str = "edges") -> list[str]:
    """Names of the databases under a folder: sub-folders that hold the given table, by their manifest or as a folder."""
    base = Path(root)
    holds = lambda p: table in config(p / "_manifest.json") or (p / table).is_dir() and any((p / table).iterdir())
    return sorted(p.name for p in base.iterdir() if p.is_dir() and holds(p)) if base.is_dir() else []
