"""Model output turned into rows: delimited records and tolerant JSON, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.functions.text import clean, strip

ENTITY, LOW, HIGH = '"Entity"', '"Low-order Hyperedge"', '"High-order Hyperedge"'


def split_records(text: Column, markers: list[str]) -> Column:
    """The text cut at any of the markers, stripped, without empty parts."""
    import re

    pattern = "|".join(re.escape(m) for m in markers)
    return F.filter(F.transform(F.split(text, pattern), strip), lambda x: x != "")


def attributes(record: Column, delimiter: str = r" \| ") -> Column:
    """The parts of a bracketed record."""
    return F.transform(F.split(F.regexp_extract(record, r"(?s)\((.*)\)", 1), delimiter), strip)


def entity_records(df: DataFrame, record: str, keep: list[str]) -> DataFrame:
    """keep, entity_name, entity_type, description, additional: of records headed "Entity" with four parts or more."""
    a = df.withColumn("a", attributes(F.col(record))).where((F.size("a") >= 4) & (F.get("a", F.lit(0)) == ENTITY))
    return a.select(*keep, F.upper(clean(F.get("a", F.lit(1)))).alias("entity_name"), F.upper(clean(F.get("a", F.lit(2)))).alias("entity_type"), clean(F.get("a", F.lit(3))).alias("description"), F.array_join(F.slice("a", 5, F.greatest(F.size("a") - 4, F.lit(0))), "; ").alias("additional"))


def edge_records(df: DataFrame, record: str, keep: list[str], head: str, tail: int) -> DataFrame:
    """keep, vertices, description, keywords, weight: the last `tail` parts are description, (a generalisation that is not kept,) keywords, weight (0.75 if no number)."""
    a = df.withColumn("a", attributes(F.col(record))).where((F.size("a") >= tail + 3) & (F.get("a", F.lit(0)) == head))
    names = F.transform(F.slice("a", 2, F.size("a") - tail - 1), lambda x: F.upper(clean(x)))
    at = lambda i: F.get("a", F.size("a") - i)
    return a.select(*keep, names.alias("vertices"), clean(at(tail)).alias("description"), clean(at(2)).alias("keywords"), F.coalesce(F.try_to_number(F.regexp_extract(at(1), r"^[-+]?[0-9]+(?:\.[0-9]+)?$", 0), F.lit("S9999999.999999")).cast("double"), F.lit(0.75)).alias("weight"))


def json_array_text(raw: Column) -> Column:
    """The JSON array in a model's answer: fences off, from the first [ to the last ] (a lone object is wrapped), trailing commas out, `[]` if there is none."""
    bare = F.regexp_replace(raw, r"```[a-zA-Z]*", "")
    array = F.regexp_extract(bare, r"(?s)(\[.*\])", 1)
    one = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    found = F.when(array != "", array).when(one != "", F.concat(F.lit("["), one, F.lit("]"))).otherwise(F.lit("[]"))
    return F.regexp_replace(found, r",\s*([\]}])", "$1")


def json_rows(raw: Column, schema: str) -> Column:
    """Array of structs; malformed text gives an empty array."""
    return F.coalesce(F.from_json(json_array_text(raw), f"array<{schema}>"), F.array().cast(f"array<{schema}>"))


def json_object_text(raw: Column) -> Column:
    return F.regexp_extract(raw, r"(?s)(\{.*\})", 1)


def keyword_lists(raw: Column) -> Column:
    """entity and theme keywords of a keyword answer, each joined by commas; older names of the fields count too, condition keywords go to the entities."""
    kinds = "struct<entity_keywords array<string>, low_level_keywords array<string>, theme_keywords array<string>, high_level_keywords array<string>, condition_keywords array<string>>".replace("s array", "s:array")
    parsed = F.from_json(json_object_text(raw), kinds)
    none = F.array().cast("array<string>")
    low = F.concat(F.coalesce(parsed.low_level_keywords, parsed.entity_keywords, none), F.coalesce(parsed.condition_keywords, none))
    return F.struct(F.array_join(low, ", ").alias("low"), F.array_join(F.coalesce(parsed.high_level_keywords, parsed.theme_keywords, none), ", ").alias("high"))


def scores(raw: Column, name: str = "Score") -> Column:
    return F.transform(F.regexp_extract_all(raw, F.lit(rf'"{name}":\s*"?([0-9]+)'), F.lit(1)), lambda x: x.cast("int"))


def messages(df: DataFrame, keep: list[str], column: str) -> DataFrame:
    """keep, pos, role, content: alternating user and assistant by place."""
    return df.select(*keep, F.posexplode(column).alias("pos", "content")).select(*keep, "pos", F.when(F.col("pos") % 2 == 0, "user").otherwise("assistant").alias("role"), "content")
