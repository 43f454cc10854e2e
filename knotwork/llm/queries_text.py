"""Queries on texts: equal-looking values, oversized documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.functions.lookalike import LETTERS, LIGATURES, ROMAN
from knotwork.llm.chunks import split_oversized
from knotwork.llm.quality import DECIDING, classify
from knotwork.llm.unify import corpus_values, equal_looking_pairs, unify
from knotwork.session import table


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    pieces = split_oversized(table(spark, folder, "documents"), table(spark, folder, "hyperrag_settings"), with_text=False)
    return pieces.where("piece_no = 0 and n_pieces > 1").select("doc_id")


def p5_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return split_oversized(table(spark, folder, "documents"), table(spark, folder, "hyperrag_settings"))


def _values(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_values(table(spark, folder, "canonical_entity"), table(spark, folder, "parsed_quantity"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return equal_looking_pairs(_values(spark, folder))


def p6_unified(spark: SparkSession, folder: str) -> DataFrame:
    """Every value with the canonical member of its class."""
    return unify(_values(spark, folder)).select("src", "id", "pos", "canonical", F.col("variants").cast("bigint").alias("variants"))


QUERIES = {"p5_found": p5_found, "p5_pieces": p5_pieces, "p6_found": p6_found, "p6_unified": p6_unified}


def _fold_sql(column: str) -> str:
    out = f"regexp_replace({column}, '[\\x00-\\x08\\x0e-\\x1f\\x7f-\\x{{84}}\\x{{86}}-\\x{{9f}}\\x{{ad}}\\x{{34f}}\\x{{61c}}\\x{{115f}}\\x{{1160}}\\x{{17b4}}\\x{{17b5}}\\x{{180b}}-\\x{{180f}}\\x{{200b}}-\\x{{200f}}\\x{{202a}}-\\x{{202e}}\\x{{2060}}-\\x{{206f}}\\x{{fe00}}-\\x{{fe0f}}\\x{{feff}}\\x{{fff9}}-\\x{{fffb}}]', '', 'g')"
    for source, target in (LIGATURES | ROMAN).items():
        out = f"replace({out}, '{source}', '{target}')"
    quoted = [x.replace("'", "''") for x in ("".join(LETTERS), "".join(LETTERS.values()))]
    out = f"translate({out}, '{quoted[0]}', '{quoted[1]}')"
    return f"trim(regexp_replace(nfc_normalize({out}), '[\\t\\n\\x0b\\x0c\\r \\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+', ' ', 'g'))"


_VALUES_SQL = """
v AS (
    SELECT 'canonical_entity' AS src, '' AS scope, entity_no AS id, (generate_subscripts(match_strings, 1) - 1)::BIGINT AS pos, unnest(match_strings) AS text FROM canonical_entity
    UNION ALL
    SELECT DISTINCT 'parsed_quantity', chunk_id, quantity_id, 0::BIGINT, raw FROM parsed_quantity
)"""

ORACLES = {
    "p5_found": """
        WITH d AS (SELECT chunk_token_size AS s FROM hyperrag_settings WHERE source = 'default'),
        t AS (SELECT doc_id, lower(trim(source)) AS src, len(regexp_extract_all(text, '[^ \\t\\r\\n]+')) AS n FROM documents WHERE text IS NOT NULL)
        SELECT doc_id FROM t LEFT JOIN hyperrag_settings h ON h.source = coalesce(t.src, 'default')
        WHERE n > coalesce(h.chunk_token_size, (SELECT s FROM d))""",
    "p6_found": f"""
        WITH {_VALUES_SQL}, f AS (SELECT *, {_fold_sql('text')} AS k FROM v WHERE text IS NOT NULL AND scope IS NOT NULL)
        SELECT a.src, a.id AS a_id, a.pos AS a_pos, b.id AS b_id, b.pos AS b_pos
        FROM f a JOIN f b ON a.src = b.src AND a.scope = b.scope AND a.k = b.k AND a.text <> b.text AND (a.id < b.id OR (a.id = b.id AND a.pos < b.pos))""",
    "p6_unified": f"""
        WITH {_VALUES_SQL}, t AS (SELECT DISTINCT text, {_fold_sql('text')} AS k FROM v WHERE text IS NOT NULL),
        w AS (SELECT text, count(*) OVER (PARTITION BY k) AS variants, first_value(text) OVER (PARTITION BY k ORDER BY length(regexp_replace(text, '[ -~]', '', 'g')), length(text), text) AS canonical FROM t)
        SELECT v.src, v.id, v.pos, w.canonical, coalesce(w.variants, 0)::BIGINT AS variants FROM v LEFT JOIN w ON v.text = w.text""",
}


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return classify(table(spark, folder, "documents"), DECIDING).where("doc_class <> 'prose'").select("doc_id", "doc_class")


def p10_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's statistics, outlier score, the classes' tail probabilities and class."""
    out = classify(table(spark, folder, "documents"))
    return out.select(*[F.round(c, 4).alias(c) if t == "double" else c for c, t in out.dtypes])


QUERIES |= {"p10_found": p10_found, "p10_statistics": p10_statistics}
