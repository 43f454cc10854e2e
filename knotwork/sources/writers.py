"""Writers: staged table commits, JSON lines, CSV summaries, run configuration without secrets."""

from __future__ import annotations

import json
import re
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SECRET = re.compile(r"key|token|secret|password|authorization", re.I)


def _swap(spark: SparkSession, staging: str, path: str) -> None:
    """Put the staged folder in the target's place; the old one is moved aside first and deleted last."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target, new, old = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, staging, f"{path.rstrip('/')}._old-{uuid.uuid4().hex}"))
    fs = target.getFileSystem(conf)
    had = fs.exists(target)
    if had and not fs.rename(target, old):
        raise OSError(f"cannot move {path} aside")
    if not fs.rename(new, target):
        if had:
            fs.rename(old, target)
        raise OSError(f"cannot move the new table to {path}")
    if had:
        fs.delete(old, True)


def commit_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Write beside the target and swap, so readers see the old table or the new one; the target may be an input of `df`."""
    staging = f"{path.rstrip('/')}._staging-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(staging)
    _swap(df.sparkSession, staging, path)


MANIFEST = "_manifest.json"


def _manifest(spark: SparkSession, root: str) -> dict[str, str]:
    """Which folder each table of the root is in, as the last commit left it."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{MANIFEST}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return {}
    stream = fs.open(path)
    try:
        return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def commit_all(frames: dict[str, DataFrame], root: str) -> None:
    """All frames to their tables under the root at once: they are written to a new version, then one manifest is swapped in.

    Readers that open tables by `committed` see all of the old versions or all of the new ones, whatever fails. Versions
    that no table uses any more are deleted last.
    """
    root = root.rstrip("/")
    spark = next(iter(frames.values())).sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.hadoop.fs
    before, version = _manifest(spark, root), f"_versions/{uuid.uuid4().hex}"
    for name, df in frames.items():
        df.write.mode("errorifexists").parquet(f"{root}/{version}/{name}")
    after = before | {name: f"{version}/{name}" for name in frames}
    part, target = hadoop.Path(f"{root}/{MANIFEST}.{uuid.uuid4().hex}"), hadoop.Path(f"{root}/{MANIFEST}")
    fs = target.getFileSystem(conf)
    stream = fs.create(part, True)
    stream.write(bytearray(json.dumps(after).encode("utf-8")))
    stream.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
    hadoop.FileContext.getFileContext(target.toUri(), conf).rename(part, target, options)
    for name in frames:
        if name in before:
            fs.delete(hadoop.Path(f"{root}/{before[name]}"), True)


def committed(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the root: its version in the manifest, else the plain folder of its name."""
    root = root.rstrip("/")
    return spark.read.parquet(f"{root}/{_manifest(spark, root).get(name, name)}")


def jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def split_errors(df: DataFrame, error: str, path: str) -> None:
    """Good rows and rows with an error, each as JSON lines in a folder of its own."""
    df.where(F.col(error).isNull()).drop(error).write.mode("overwrite").json(f"{path.rstrip('/')}/rows")
    df.where(F.col(error).isNotNull()).write.mode("overwrite").json(f"{path.rstrip('/')}/errors")


def summary_csv(df: DataFrame, columns: list[str], path: str) -> None:
    """A summary (few rows) as one CSV file with a header and the columns in this order, missing ones as 0."""
    given = set(df.columns)
    df.select(*[F.coalesce(F.col(c), F.lit(0)).alias(c) if c in given and dict(df.dtypes)[c] != "string" else F.col(c) if c in given else F.lit(0).alias(c) for c in columns]).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def redact(value):
    """The value without what stands under secret names, at any depth."""
    if isinstance(value, dict):
        return {k: "***" if SECRET.search(str(k)) and v else redact(v) for k, v in value.items()}
    return [redact(v) for v in value] if isinstance(value, list) else value


def run_config(settings: dict, path: str) -> None:
    target = Path(path)
    part = target.with_name(target.name + ".part")
    part.write_text(json.dumps(redact(settings), ensure_ascii=False, indent=2), encoding="utf-8")
    part.replace(target)
