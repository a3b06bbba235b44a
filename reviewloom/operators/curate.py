"""Exact dedup, hash split and manifest of a training set."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.functions.contract import DATASET_MANIFEST, NOT_JSON, TRAINING_EXAMPLE, load_contract, violations
from reviewloom.functions.hashing import BUCKET_SPACE, canonical_checksum, hash_bucket, set_checksum_tree, set_checksums_in_order
from reviewloom.functions.vocabulary import literal_rows
from reviewloom.sources.records import numbered_lines, write_json
from reviewloom.sources.scratch import written

#: The splits, and the reference from a manifest to its schema.
SPLITS = ("train", "val", "test")
MANIFEST_SCHEMA = "../../schemas/dataset-manifest.schema.json"
#: Checksum of a set without members.
EMPTY_SET = hashlib.sha256(b"").hexdigest()


def dedup_exact(df: DataFrame, checksum: str = "checksum") -> DataFrame:
    """One row per checksum. Rows of a checksum are canonically equal, so which one stays is not observable."""
    return df.dropDuplicates([checksum])


def split_bounds(val_ratio: float, test_ratio: float) -> tuple[int, int]:
    """Upper bucket bounds of val and of test; each ratio in [0, 1) and their sum below 1."""
    if not (0 <= val_ratio < 1 and 0 <= test_ratio < 1 and val_ratio + test_ratio < 1):
        raise ValueError("split ratios must be in [0, 1) with a sum below 1")
    return int(val_ratio * BUCKET_SPACE), int((val_ratio + test_ratio) * BUCKET_SPACE)


def split_of(checksum: Column, seed: int, val_ratio: float = 0.1, test_ratio: float = 0.1) -> Column:
    """Split of a record: val, then test, then train, along its hash bucket."""
    val, test = split_bounds(val_ratio, test_ratio)
    b = hash_bucket(checksum, seed)
    return F.when(b < val, "val").when(b < test, "test").otherwise("train")


def split_manifest(df: DataFrame, checksum: str = "checksum", split: str = "split", in_order: bool = False) -> DataFrame:
    """Count and set checksum of all three splits, those without rows included.

    The checksum is the root of :func:`set_checksum_tree`, made by executors alone. With
    ``in_order`` it is one SHA-256 over all sorted digests, for manifests that are to equal
    ones made so; the digests then pass the driver in order as this is called.
    """
    if in_order:
        have = set_checksums_in_order(df, split, checksum)
        rows = [(s, *have.get(s, (0, EMPTY_SET))) for s in SPLITS]
        return literal_rows(df.sparkSession, ("split", "n", "checksum"), rows).select("split", F.col("n").cast("long").alias("n"), "checksum")
    roots = set_checksum_tree(df.select(F.col(split).alias("split"), F.col(checksum).alias("_member")), ["split"], "_member", "checksum")
    names = literal_rows(df.sparkSession, ("split",), [(s,) for s in SPLITS])
    # A row a split, three at most.
    return names.join(F.broadcast(roots.where(F.col("split").isin(*SPLITS))), "split", "left").select("split", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.coalesce("checksum", F.lit(EMPTY_SET)).alias("checksum"))


def manifest_record(dataset_id: str, version: str, seed: int, splits: dict[str, tuple[int, str]], source_checksum: str | None = None) -> dict:
    """The manifest of a split: identity, seed, counts and checksums; ``splits`` has (members, checksum) by name."""
    have = {s: splits.get(s, (0, EMPTY_SET)) for s in SPLITS}
    return {
        "$schema": MANIFEST_SCHEMA,
        "datasetId": dataset_id,
        "version": version,
        "splitSeed": seed,
        "counts": {s: n for s, (n, _) in have.items()},
        "checksums": {s: c for s, (_, c) in have.items()},
        "sourceExamplesChecksum": source_checksum,
    }


def checked_manifest(spark: SparkSession, manifest: dict) -> dict:
    """``manifest`` itself; raises with the first thing that breaks its contract."""
    bad = literal_rows(spark, ("raw",), [(json.dumps(manifest),)]).select(violations(F.col("raw"), DATASET_MANIFEST).alias("bad")).first()["bad"]
    if bad:
        raise ValueError(f"invalid manifest: {bad[0]}")
    return manifest


def unique_records(raw: DataFrame) -> DataFrame:
    """(checksum, _raw) of raw JSON records, one for each canonical checksum, the first in the file."""
    summed = raw.withColumn("checksum", canonical_checksum(F.col("_raw")))
    return summed.groupBy("checksum").agg(F.min_by("_raw", "_line").alias("_raw"))


def checked_records(raw: DataFrame, contract: dict) -> DataFrame:
    """``raw`` (_raw, _line, _at) itself, after all its records have been checked in one pass.

    Raises for the first line that is not JSON, with its physical number, or else for the first
    record that breaks the contract, with its index among the records.
    """
    found = raw.select("_line", "_at", violations(F.col("_raw"), contract).alias("errors")).where(F.size("errors") > 0)
    first = F.get("errors", F.lit(0))
    broken = found.agg(F.min(F.when(first == NOT_JSON, F.col("_line"))).alias("line"), F.min(F.struct("_at", first.alias("message"))).alias("record")).first()
    if broken["line"] is not None:
        raise ValueError(f"example {broken['line']}: invalid JSON")
    if broken["record"] is not None:
        raise ValueError(f"example {broken['record']['_at']}: {broken['record']['message']}")
    return raw


def curate(spark: SparkSession, examples: str, dataset_id: str, version: str, seed: int, manifest: str | None = None, contract: dict | str = TRAINING_EXAMPLE, in_order: bool = False) -> tuple[DataFrame, dict]:
    """Load, validate, dedup, split and write: ((checksum, _raw, split), manifest) of a JSONL file of training examples.

    A line that is not JSON fails with its physical line number, the first record that
    breaks the contract with its index among the records, both before anything is
    written. ``contract``: a JSON Schema document, or the path of one. Lines are numbered and
    canonical checksums taken once, and written. The splits' checksums and that of all records are digests of their sets of
    canonical checksums, as in :func:`split_manifest`.
    """
    raw = written(numbered_lines(spark, examples, "py"), "lines")
    checked_records(raw, load_contract(spark, contract) if isinstance(contract, str) else contract)
    rows = written(unique_records(raw), "unique-records").withColumn("split", split_of(F.col("checksum"), seed))
    splits = {r["split"]: (r["n"], r["checksum"]) for r in split_manifest(rows, in_order=in_order).collect()}
    if in_order:
        whole = set_checksums_in_order(rows.withColumn("all", F.lit("all")), "all", "checksum").get("all", (0, EMPTY_SET))[1]
    else:
        whole = set_checksum_tree(rows, [], "checksum", "whole").first()["whole"]
    record = checked_manifest(spark, manifest_record(dataset_id, version, seed, splits, whole))
    if manifest:
        write_json(record, manifest)
    return rows, record
