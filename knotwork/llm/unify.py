"""Texts that look the same brought to one form.

Look-alikes are mapped to one letter, the mapped values are grouped in SQL under the accent-sensitive Unicode
collation (which equates composed and decomposed accents and ignores invisible marks, and keeps case, accents,
superscripts and dashes apart), a canonical member is chosen for each class and joined back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.functions.lookalike import fold
from knotwork.functions.sizes import join_hot
from knotwork.session import durable


def unify(values: DataFrame, text: str = "text") -> DataFrame:
    """Adds `canonical` (the class's member with the fewest characters outside ASCII, then the shortest, then the
    first in order) and `variants` (how many different texts the class has) to every row.

    Columns of these names are replaced. A null text has a null canonical and 0 variants. Texts of only blanks or invisible characters form one class.
    Repeated texts are reduced to one before the grouping, so a text that fills a third of the table costs one row
    there, and hot texts are joined back by broadcast.
    """
    spark = values.sparkSession
    values = values.drop("canonical", "variants")
    texts = values.where(F.col(text).isNotNull()).select(F.col(text).alias("t")).distinct()
    folded = durable(texts.withColumn("k", fold(F.col("t"))))  # folded once for the grouping and for the join back
    classes = spark.sql(
        """
        WITH class AS (
            SELECT k COLLATE UNICODE AS form, count(*) AS variants,
                   min(struct(length(regexp_replace(t, '[ -~]', '')), length(t), t)).t AS canonical
            FROM {folded} GROUP BY k COLLATE UNICODE
        )
        SELECT f.t AS unify_text, c.canonical, c.variants
        FROM {folded} f JOIN class c ON f.k COLLATE UNICODE = c.form
        WHERE c.variants > 1
        """,
        folded=folded,
    )
    joined = join_hot(values, durable(classes.withColumnRenamed("unify_text", text)), [text], "left")
    alone = F.when(F.col(text).isNull(), 0).otherwise(1).cast("bigint")
    return joined.withColumns({"canonical": F.coalesce("canonical", text), "variants": F.coalesce("variants", alone)})


def equal_looking_pairs(values: DataFrame) -> DataFrame:
    """Pairs of differing texts of one class and scope. `values`: src, scope, id, pos, text, in any number of sources.

    Only values of classes with more than one text take part; rows with a null scope are in no pair.
    """
    varied = durable(unify(values).where("variants > 1 and scope is not null").select("src", "scope", "id", "pos", "text", "canonical"))
    a, b = (varied.select(*[F.col(c).alias(f"{s}_{c}") for c in varied.columns]) for s in "ab")
    same = (F.col("a_src") == F.col("b_src")) & (F.col("a_scope") == F.col("b_scope")) & (F.col("a_canonical") == F.col("b_canonical"))
    order = (F.col("a_id") < F.col("b_id")) | ((F.col("a_id") == F.col("b_id")) & (F.col("a_pos") < F.col("b_pos")))
    return a.join(b, same & order & (F.col("a_text") != F.col("b_text"))).select(F.col("a_src").alias("src"), "a_id", "a_pos", "b_id", "b_pos")


def corpus_values(canonical: DataFrame, quantities: DataFrame) -> DataFrame:
    """The two tables' texts as src, scope, id, pos, text: match strings in one scope, raw texts by chunk."""
    names = canonical.select(F.lit("canonical_entity").alias("src"), F.lit("").alias("scope"), F.col("entity_no").alias("id"), F.posexplode("match_strings").alias("pos", "text"))
    raws = quantities.select(F.lit("parsed_quantity").alias("src"), F.col("chunk_id").alias("scope"), F.col("quantity_id").alias("id"), F.lit(0).alias("pos"), F.col("raw").alias("text")).dropDuplicates(["id"])
    return names.withColumn("pos", F.col("pos").cast("bigint")).unionByName(raws.withColumn("pos", F.col("pos").cast("bigint")))
