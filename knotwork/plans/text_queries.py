"""Queries of chunking, parsing and scalar text functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.functions import text as x
from knotwork.operators import chunking as c
from knotwork.operators import parsing as p
from knotwork.plans import name_sql as n
from knotwork.session import table


def chunk_windows(spark: SparkSession, d: str) -> DataFrame:
    return c.windows(table(spark, d, "documents").dropDuplicates(["doc_id"]), 100, 20).select("doc_id", "chunk_order_index", "tokens", F.md5("content").alias("content_md5"))


def chunk_heading(spark: SparkSession, d: str) -> DataFrame:
    return c.by_heading(table(spark, d, "documents")).select("doc_id", "source_chunk_id", F.md5("content").alias("content_md5"))


def doc_key_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return c.dedupe_documents(table(spark, d, "documents"))


def new_doc_anti(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null").withColumn("doc_key", c.document_key(F.col("text")))
    return docs.where("section is null").select("doc_id", "doc_key").join(docs.where("section is not null").select("doc_key").distinct(), "doc_key", "left_anti").select("doc_id", "doc_key")


def chunk_key(spark: SparkSession, d: str) -> DataFrame:
    return c.chunk_keys(table(spark, d, "documents").select("doc_id", "paper_id", "text"), "paper_id", "text", "doc_id").select("doc_id", "chunk_key")


def context_window3(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "parsed_quantity").where("chunk_id is not null").select("chunk_id", "quantity_id", "raw").dropDuplicates(["quantity_id"])
    return c.context_windows(rows, "chunk_id", "quantity_id", "raw")


def unique_contexts(spark: SparkSession, d: str) -> DataFrame:
    return c.unique_contexts(table(spark, d, "rewritten_hyperedge").select("edge_id", "description"), "description", "edge_id")


def char_truncate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(F.substring("text", 1, 512)).alias("head_md5"), F.length(F.substring("text", 1, 512)).alias("head_chars"))


def token_budget(spark: SparkSession, d: str) -> DataFrame:
    return c.token_budget(table(spark, d, "documents"), "section", "text")


_RECORD = {"entity": ("(\"Entity\" | ", "p_name", " | ", "p_type", " | made by ", "p_brand", " &amp; co | size ", "p_size", ")"), "low": ("(\"Low-order Hyperedge\" | ", "p_name", " | ", "p_brand", " | made by | maker,", "p_type", " | ", "p_size", ")"), "high": ("(\"High-order Hyperedge\" | ", "p_name", " | ", "p_brand", " | ", "p_type", " | described | general | kind | n/a)")}


def _record(kind: str) -> F.Column:
    return F.concat(*[F.col(s).cast("string") if s.startswith("p_") else F.lit(s) for s in _RECORD[kind]])


def _record_sql(kind: str) -> str:
    return " || ".join(s if s.startswith("p_") else "'" + s + "'" for s in _RECORD[kind])


def record_split(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(_record("entity"), F.lit("\n"), _record("low"), F.lit("\n \n"), _record("high"), F.lit("<|COMPLETE|>"))
    return table(spark, d, "part").select("p_partkey", F.posexplode(p.split_records(text, ["\n", "<|COMPLETE|>"])).alias("pos", "record"))


def entity_record_parse(spark: SparkSession, d: str) -> DataFrame:
    return p.entity_records(table(spark, d, "part").withColumn("r", _record("entity")), "r", ["p_partkey"])


def low_edge_parse(spark: SparkSession, d: str) -> DataFrame:
    return p.edge_records(table(spark, d, "part").withColumn("r", _record("low")), "r", ["p_partkey"], p.LOW, 3)


def high_edge_parse(spark: SparkSession, d: str) -> DataFrame:
    return p.edge_records(table(spark, d, "part").withColumn("r", _record("high")), "r", ["p_partkey"], p.HIGH, 4)


def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(x.clean(F.col("text"))).alias("cleaned_md5"))


def is_number(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "parsed_quantity").select("quantity_id", "raw").distinct().select("quantity_id", x.is_number(F.regexp_replace("raw", "[^0-9.+-]", "")).alias("numeric"))


def json_extract(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit("Here you are: "), F.col("props"), F.lit(" done"))
    return table(spark, d, "events").select("event_id", F.from_json(p.json_object_text(raw), "k int").k.alias("k"))


def json_array_parse(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit('```json\n[{"name": "'), F.col("p_name"), F.lit('", "type": "'), F.col("p_type"), F.lit('",}, {"name": "'), F.col("p_brand"), F.lit('"},]\n```'))
    return table(spark, d, "part").select("p_partkey", F.posexplode(p.json_rows(raw, "struct<name:string,type:string>")).alias("pos", "e")).select("p_partkey", "pos", "e.name", "e.type")


def relation_object_parse(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit('{"low_order_relations": [{"source": "'), F.col("p_name"), F.lit('", "target": "'), F.col("p_brand"), F.lit('"}], "high_order_hyperedges": "none"}'))
    parsed = F.from_json(p.json_object_text(raw), "low_order_relations array<struct<source:string,target:string>>")
    return table(spark, d, "part").select("p_partkey", F.explode(parsed.low_order_relations).alias("r")).select("p_partkey", "r.source", "r.target")


def keyword_parse(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit('ok {"high_level_keywords": ["'), F.col("p_type"), F.lit('"], "low_level_keywords": ["'), F.col("p_name"), F.lit('", "'), F.col("p_brand"), F.lit('"]}'))).otherwise(F.concat(F.lit('{"theme_keywords": ["'), F.col("p_type"), F.lit('"], "entity_keywords": ["'), F.col("p_name"), F.lit('"], "condition_keywords": ["'), F.col("p_size").cast("string"), F.lit('"]}')))
    return table(spark, d, "part").select("p_partkey", p.keyword_lists(raw).alias("k")).select("p_partkey", "k.low", "k.high")


def message_pack(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "evaluate_qa_answers").select("answer_id", "question", "answer").distinct()
    return p.messages(rows.select("answer_id", F.array("question", "answer").alias("m")), ["answer_id"], "m")


def score_extract(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_partkey", F.concat(F.lit('{"Helpful": {"Score": '), F.col("p_size").cast("string"), F.lit(', "Explanation": "x"}, "Depth": {"Score": "7"}}')).alias("raw"))
    return rows.select("p_partkey", p.scores(F.col("raw")).alias("scores"))


def csv_rows(spark: SparkSession, d: str) -> DataFrame:
    line = F.to_csv(F.struct("p_partkey", "p_name", "p_brand"))
    return table(spark, d, "part").select(F.from_csv(line, "k bigint, name string, brand string").alias("r")).select("r.*")


def text_match_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "alias_match").select("match_id", "canonical_name").distinct().select("match_id", x.match_key(F.col("canonical_name")).alias("match_key"))


def unit_words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "parsed_quantity").select("quantity_id", "raw").distinct().select("quantity_id", x.unit_words(F.col("raw")).alias("text"))


def eval_normalize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "parsed_quantity").select("quantity_id", "raw").distinct().select("quantity_id", x.normalise(F.col("raw")).alias("normal"), x.compact(F.col("raw")).alias("compact"))


def unit_slug(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "parsed_quantity").select("unit").distinct().select("unit", x.compared_unit_slug(F.col("unit")).alias("slug"))


def query_terms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "evaluate_qa_answers").select("answer_id", "question").distinct().select("answer_id", x.terms(F.col("question")).alias("terms"))


def hash_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.md5("p_name").alias("m"), F.sha1("p_name").alias("s"), F.substring(F.sha2("p_name", 256), 1, 12).alias("short"))


def redact_text(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit('{"api_key": "'), F.col("p_brand"), F.lit('", "model": "'), F.col("p_name"), F.lit('"} token='), F.col("p_type"))
    return table(spark, d, "part").select("p_partkey", x.redact(raw).alias("shown"))


def split_keys(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat_ws(",", "p_brand", F.lit(""), F.concat("p_type", F.lit(";\n "), "p_name"))
    return table(spark, d, "part").select("p_partkey", F.filter(F.transform(F.split(raw, r"[\n,;]+"), x.strip), lambda k: k != "").alias("keys"))


def strip_sources(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat("p_name", F.lit("\n\nSources:\n- "), "p_brand")
    return table(spark, d, "part").select("p_partkey", x.strip(F.substring_index(raw, "Sources:", 1)).alias("answer"))


def safe_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", x.safe_name(F.concat_ws(" ", "source", "section")).alias("name"))


def entity_rows(spark: SparkSession, d: str) -> DataFrame:
    """Quantities as standard rows: a value or a range, not both."""
    rows = table(spark, d, "parsed_quantity").select("quantity_id", "quantity_type", "raw", "value", "min_value", "max_value", "unit").distinct()
    return rows.select("quantity_id", F.coalesce("quantity_type", "raw", F.lit("")).alias("entity_name"), "value", F.when(F.col("value").isNull(), F.col("min_value")).alias("value_min"), F.when(F.col("value").isNull(), F.col("max_value")).alias("value_max"), "unit")


def relation_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "rewritten_hyperedge").select("edge_id", "vertices", "strength").distinct()
    return rows.select("edge_id", F.when(F.size("vertices") > 2, "High-order").otherwise("Low-order").alias("level"), (F.coalesce("strength", F.lit(5)) / 10).alias("weight"))


QUERIES = {f.__name__: f for f in (chunk_windows, chunk_heading, doc_key_dedupe, new_doc_anti, chunk_key, context_window3, unique_contexts, char_truncate, token_budget, record_split, entity_record_parse, low_edge_parse, high_edge_parse, clean_text, is_number, json_extract, json_array_parse, relation_object_parse, keyword_parse, message_pack, score_extract, csv_rows, text_match_key, unit_words, eval_normalize, unit_slug, query_terms, hash_keys, redact_text, split_keys, strip_sources, safe_names, entity_rows, relation_rows)}

_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_NORMAL = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(lower(coalesce({}, '')), '−', '-'), '–', '-'), '—', '-'), 'cm-2', 'cm2'), 'cm^2', 'cm2'), 'cm²', 'cm2'), 'ma\\s*(?:/|\\s+)\\s*cm\\s*-?\\s*2', 'ma/cm2', 'g'), 'mol\\s*(?:/|\\s+)\\s*l(?:-1)?', 'mol/l', 'g'), 'mmol\\s*(?:/|\\s+)\\s*l(?:-1)?', 'mmol/l', 'g'), 'mmol\\s*(?:/|\\s+)\\s*g', 'mmol/g', 'g'), '°\\s*c|degc', 'c', 'g'), '[^a-z0-9.%/+:-]+', ' ', 'g'), '\\s+', ' ', 'g'))"
_CLEAN = _STRIP.format("regexp_replace(replace(replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[\\x00-\\x1f\\x7f-\\x{{9f}}]', '', 'g')")
_TOKENS = "list_filter(string_split_regex({}, '\\s+'), lambda x: x <> '')"
_Q = "q AS (SELECT DISTINCT quantity_id, quantity_type, raw, value, min_value, max_value, unit, chunk_id FROM parsed_quantity)"
_TERM_STOP = ", ".join(f"'{w}'" for w in x.TERM_STOP)
_KEY = n.key("{}").replace("{", "{{").replace("}", "}}").replace("{{}}", "{}", 1)
ORACLES = {
    "chunk_windows": f"""WITH t AS (SELECT DISTINCT doc_id, {_TOKENS.format('text')} AS t FROM documents WHERE text IS NOT NULL), s AS (SELECT doc_id, t, unnest(generate_series(0, len(t) - 1, 80)) AS start FROM t WHERE len(t) > 0)
        SELECT doc_id, (start // 80)::INT AS chunk_order_index, least(100, len(t) - start)::INT AS tokens, md5(array_to_string(t[start + 1 : start + 100], ' ')) AS content_md5 FROM s""",
    "chunk_heading": f"""WITH p AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '(?m)^(#{{1,6}}[ \\t]*Chunk[ \\t]+[A-Za-z0-9_.-])', chr(1) || '\\1', 'g'), chr(1))) AS part FROM documents),
        n AS (SELECT doc_id, regexp_extract(part, '^#{{1,6}}[ \\t]*Chunk[ \\t]+([A-Za-z0-9_.-]+)', 1) AS source_chunk_id, {_STRIP.format("regexp_replace(part, '^[^\\n]*\\n?', '')")} AS content FROM p WHERE regexp_matches(part, '^#{{1,6}}[ \\t]*Chunk[ \\t]+'))
        SELECT doc_id, source_chunk_id, md5(content) AS content_md5 FROM n WHERE content <> ''""",
    "doc_key_dedupe": f"SELECT 'doc-' || md5({_STRIP.format('text')}) AS doc_key, min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "new_doc_anti": f"WITH t AS (SELECT doc_id, section, 'doc-' || md5({_STRIP.format('text')}) AS doc_key FROM documents WHERE text IS NOT NULL) SELECT doc_id, doc_key FROM t WHERE section IS NULL AND doc_key NOT IN (SELECT doc_key FROM t WHERE section IS NOT NULL)",
    "chunk_key": """WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(coalesce(paper_id, ''), '[^A-Za-z0-9._-]', '', 'g'), '^[._-]+|[._-]+$', '', 'g') AS n, md5(coalesce(text, '')) AS h FROM documents), f AS (SELECT n, arg_min(h, doc_id) AS fh FROM t GROUP BY n)
        SELECT doc_id, CASE WHEN n = '' THEN 'chunk-' || h WHEN h = fh THEN n ELSE n || '-' || right(h, 8) END AS chunk_key FROM t JOIN f USING (n)""",
    "context_window3": f"WITH {_Q} SELECT chunk_id, quantity_id, concat_ws(' ', raw, lead(raw, 1) OVER w, lead(raw, 2) OVER w) AS context FROM q WHERE chunk_id IS NOT NULL WINDOW w AS (PARTITION BY chunk_id ORDER BY quantity_id)",
    "unique_contexts": "SELECT description, min(edge_id) AS edge_id FROM rewritten_hyperedge WHERE description IS NOT NULL GROUP BY 1",
    "char_truncate": "SELECT doc_id, md5(left(text, 512)) AS head_md5, length(left(text, 512))::INT AS head_chars FROM documents",
    "token_budget": f"SELECT section, sum(greatest(1, len({_TOKENS.format("coalesce(text, '')")})))::BIGINT AS token_budget FROM documents GROUP BY 1",
    "record_split": f"WITH t AS (SELECT p_partkey, list_filter(list_transform(string_split_regex({_record_sql('entity')} || chr(10) || {_record_sql('low')} || chr(10) || ' ' || chr(10) || {_record_sql('high')} || '<|COMPLETE|>', '\\n|<\\|COMPLETE\\|>'), lambda x: trim(x)), lambda x: x <> '') AS r FROM part) SELECT p_partkey, (generate_subscripts(r, 1) - 1)::INT AS pos, unnest(r) AS record FROM t",
    "entity_record_parse": "SELECT p_partkey, upper(p_name) AS entity_name, upper(p_type) AS entity_type, 'made by ' || p_brand || ' & co' AS description, 'size ' || p_size AS additional FROM part",
    "low_edge_parse": "SELECT p_partkey, [upper(p_name), upper(p_brand)] AS vertices, 'made by' AS description, 'maker,' || p_type AS keywords, p_size::DOUBLE AS weight FROM part",
    "high_edge_parse": "SELECT p_partkey, [upper(p_name), upper(p_brand), upper(p_type)] AS vertices, 'described' AS description, 'kind' AS keywords, 0.75::DOUBLE AS weight FROM part",
    "clean_text": f"SELECT doc_id, md5({_CLEAN.format('text')}) AS cleaned_md5 FROM documents",
    "is_number": f"WITH {_Q} SELECT quantity_id, regexp_full_match(regexp_replace(raw, '[^0-9.+-]', '', 'g'), '[-+]?[0-9]*\\.?[0-9]+') AS numeric FROM q",
    "json_extract": "SELECT event_id, json_extract(props, '$.k')::INT AS k FROM events",
    "json_array_parse": "SELECT p_partkey, 0 AS pos, p_name AS name, p_type AS type FROM part UNION ALL SELECT p_partkey, 1, p_brand, NULL FROM part",
    "relation_object_parse": "SELECT p_partkey, p_name AS source, p_brand AS target FROM part",
    "keyword_parse": "SELECT p_partkey, p_name || ', ' || CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_size::VARCHAR END AS low, p_type AS high FROM part",
    "message_pack": "WITH t AS (SELECT DISTINCT answer_id, question, answer FROM evaluate_qa_answers) SELECT answer_id, 0 AS pos, 'user' AS role, question AS content FROM t UNION ALL SELECT answer_id, 1, 'assistant', answer FROM t",
    "score_extract": "SELECT p_partkey, [p_size, 7] AS scores FROM part",
    "csv_rows": "SELECT p_partkey AS k, p_name AS name, p_brand AS brand FROM part",
    "text_match_key": f"SELECT match_id, {_KEY.format('canonical_name')} AS match_key FROM (SELECT DISTINCT match_id, canonical_name FROM alias_match)",
    "unit_words": f"WITH {_Q} SELECT quantity_id, {n.units('raw')} AS text FROM q",
    "eval_normalize": f"WITH {_Q} SELECT quantity_id, {_NORMAL.format('raw')} AS normal, replace({_NORMAL.format('raw')}, ' ', '') AS compact FROM q",
    "unit_slug": f"""WITH u AS (SELECT DISTINCT unit, {_NORMAL.format('unit')} AS n FROM parsed_quantity), s AS (SELECT unit, CASE WHEN n IN ('%', 'percent') THEN 'percent' WHEN n IN ('degree', 'deg') THEN 'degree' WHEN n IN ('cycle', 'cycles') THEN 'cycle' ELSE replace(replace(n, ' ', ''), '/', '_') END AS slug FROM u)
        SELECT unit, CASE WHEN slug = '' THEN 'unitless' ELSE slug END AS slug FROM s""",
    "query_terms": f"WITH t AS (SELECT DISTINCT answer_id, question FROM evaluate_qa_answers) SELECT answer_id, list_sort(list_distinct(list_filter(list_transform(list_filter(regexp_extract_all(question, '([a-zA-Z][a-zA-Z0-9.+/-]*|[0-9]+(?:\\.[0-9]+)?)', 1), lambda w: length(w) > 1), lambda w: {_NORMAL.format('w')}), lambda w: w <> '' AND w NOT IN ({_TERM_STOP})))) AS terms FROM t",
    "hash_keys": "SELECT p_partkey, md5(p_name) AS m, sha1(p_name) AS s, left(sha256(p_name), 12) AS short FROM part",
    "redact_text": "SELECT p_partkey, '{\"api_key\": \"***\", \"model\": \"' || p_name || '\"} token=***' AS shown FROM part",
    "split_keys": "SELECT p_partkey, [p_brand, p_type, p_name] AS keys FROM part",
    "strip_sources": "SELECT p_partkey, p_name AS answer FROM part",
    "safe_names": "WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(concat_ws(' ', source, section), '[^A-Za-z0-9_\\x{4e00}-\\x{9fff}\\-]', '_', 'g'), '^[0-9]+', '') AS n FROM documents) SELECT doc_id, CASE WHEN n = '' THEN 'default' ELSE n END AS name FROM t",
    "entity_rows": f"WITH {_Q} SELECT quantity_id, coalesce(quantity_type, raw, '') AS entity_name, value, CASE WHEN value IS NULL THEN min_value END AS value_min, CASE WHEN value IS NULL THEN max_value END AS value_max, unit FROM q",
    "relation_rows": "SELECT edge_id, CASE WHEN len(vertices) > 2 THEN 'High-order' ELSE 'Low-order' END AS level, coalesce(strength, 5) / 10 AS weight FROM (SELECT DISTINCT edge_id, vertices, strength FROM rewritten_hyperedge)",
}
