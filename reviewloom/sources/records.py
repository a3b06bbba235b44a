"""JSON record files: reading with their errors, writing, manifests and registries."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewloom.functions.text import PY_LINE_END, js_trim, py_strip

CORRUPT = "_corrupt_record"

COMMENT = T.StructType().add("path", "string").add("line", "integer").add("body", "string").add("author", "string")
FILE = T.StructType().add("path", "string").add("status", "string").add("additions", "long").add("deletions", "long").add("before", "string").add("after", "string")
#: A landed pull request.
RAW = (
    T.StructType().add("host", "string").add("repository", "string").add("pullNumber", "long").add("title", "string").add("baseSha", "string").add("mergeCommitSha", "string").add("sourceUrl", "string")
    .add("mergedAt", "string").add("licenseSpdx", "string").add("licenseStatus", "string").add("files", T.ArrayType(FILE)).add("reviewComments", T.ArrayType(COMMENT)).add("collectedAt", "string")
)


def numbered_lines(spark: SparkSession, path: str, flavour: str = "js") -> DataFrame:
    """(_raw, _line, _at) of the non-blank lines of a file or of files, trimmed; both numbers are per file.

    ``_line`` counts from 1: with ``js`` the non-blank lines, which end at line feeds;
    with ``py`` all physical lines, which also end at the other line ends that Python
    knows. ``_at`` counts non-blank lines from 0. A large file is read in blocks by many tasks; a
    line's number is its place in its block plus the lines of the blocks before,
    which are a row for each block.
    """
    own = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    if flavour == "py":
        ends = F.split(F.regexp_replace("value", r"\r$", ""), PY_LINE_END, -1)
        lines = own.select("file", "block", F.explode_outer(ends).alias("value")).withColumn("raw", py_strip(F.col("value")))
    else:
        lines = own.withColumn("raw", js_trim(F.col("value")))
    # Within a task rows keep the order of the file; the number's lower bits count them.
    placed = lines.select("file", "block", F.col("raw").alias("_raw"), F.monotonically_increasing_id().alias("mid"), (F.col("raw") != "").cast("long").alias("full"))
    blocks = placed.groupBy("file", "block").agg(F.min("mid").alias("first"), F.count(F.lit(1)).alias("n"), F.sum("full").alias("n_full"))
    past = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.select("file", "block", "first", F.coalesce(F.sum("n").over(past), F.lit(0)).alias("lines"), F.coalesce(F.sum("n_full").over(past), F.lit(0)).alias("fulls"))
    # Non-blank lines are counted on their own, so that their places have no gaps.
    kept = placed.where("full = 1").withColumn("at", F.monotonically_increasing_id())
    kept_first = kept.groupBy("file", "block").agg(F.min("at").alias("first_at"))
    out = kept.join(before.join(kept_first, ["file", "block"]), ["file", "block"])
    at = F.col("at") - F.col("first_at") + F.col("fulls")
    line = at + 1 if flavour == "js" else F.col("mid") - F.col("first") + F.col("lines") + 1
    return out.select("_raw", line.alias("_line"), at.alias("_at"))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, numbered: str | None = None) -> DataFrame:
    """Records by an explicit schema, with ``_corrupt_record`` and ``_raw``, the line itself; blank lines are skipped.

    ``numbered`` (``js`` or ``py``) adds ``_line`` as in :func:`numbered_lines`.
    """
    if numbered:
        lines = numbered_lines(spark, path, numbered).drop("_at")
    else:
        lines = spark.read.text(path, lineSep="\n").select(js_trim(F.col("value")).alias("_raw")).where("_raw <> ''")
    parsed = lines.withColumn("_r", F.from_json("_raw", T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}))
    return parsed.select("_r.*", "_raw", *(["_line"] if numbered else []))


def checked(df: DataFrame) -> DataFrame:
    """The records alone; raises as soon as a line could not be parsed, with its number if lines are numbered."""
    said = F.concat(F.lit("invalid JSON on line "), F.col("_line").cast("string")) if "_line" in df.columns else F.concat(F.lit("invalid JSON line: "), F.substring(CORRUPT, 1, 200))
    return df.where(F.when(F.col(CORRUPT).isNull(), True).otherwise(F.raise_error(said))).drop(CORRUPT, "_raw", "_line")


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object for each row; nulls are left out."""
    df.write.mode("overwrite").json(path)


def read_package_manifests(spark: SparkSession, path: str) -> DataFrame:
    deps = T.MapType(T.StringType(), T.StringType())
    return spark.read.schema(T.StructType().add("dependencies", deps).add("devDependencies", deps)).option("multiLine", True).json(path).withColumn("path", F.col("_metadata.file_path"))


def write_manifest(df: DataFrame, path: str) -> dict:
    """A one-row frame as indented JSON with a closing line end; folders are made. Returns the object."""
    rows = df.limit(2).toJSON().collect()
    if len(rows) != 1:
        raise ValueError("a manifest is one row")
    return write_json(json.loads(rows[0]), path)


def write_json(value: dict, path: str) -> dict:
    """Indented JSON with a closing line end; folders are made. Returns the object."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(json.dumps(value, indent=2, ensure_ascii=False) + "\n")
    return value


def read_registry(spark: SparkSession, folder: str) -> DataFrame:
    """(path, found, status, version, adapter_type, rank) of the manifests that ``registry.json`` of a folder lists, in its order (``ord``).

    A registry is a short list, read on the driver; a manifest that is missing is a row that says so.
    """
    with open(os.path.join(folder, "registry.json"), encoding="utf-8") as f:
        listed = json.load(f)["manifests"]
    rows = []
    for i, name in enumerate(listed):
        at = os.path.join(folder, name)
        if not os.path.isfile(at):
            rows.append((i, name, False, None, None, None, None))
            continue
        with open(at, encoding="utf-8") as f:
            value = json.load(f)
        adapter = value.get("adapter") or {}
        rows.append((i, name, True, value.get("status"), value.get("version"), adapter.get("type"), adapter.get("rank")))
    return spark.createDataFrame(rows, "ord int, path string, found boolean, status string, version string, adapter_type string, rank int")
