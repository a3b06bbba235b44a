"""Contract checks as columns of messages: training examples, dataset manifests, model manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.functions.vocabulary import ADAPTER_TYPES, CONFIDENCES, LANGUAGES, MODEL_STATUSES, SEVERITIES, SOURCE_TYPES

SEMVER = r"^\d+\.\d+\.\d+$"


def _messages(checks: list[tuple[str, Column]]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(text)) for text, bad in checks]))


def _one_of(name: str, c: Column, values: tuple[str, ...]) -> tuple[str, Column]:
    return f"{name}: not one of the allowed values", ~c.isin(*values)


def example_errors() -> Column:
    """Messages for flat training rows (language, code, category, confidence, confidence_score, severity, summary, source_type, source_url)."""
    need = ("language", "code", "category", "confidence", "severity", "summary", "source_type", "source_url")
    checks = [(f"{n}: required", F.col(n).isNull()) for n in need]
    checks += [
        _one_of("language", F.col("language"), LANGUAGES),
        _one_of("confidence", F.col("confidence"), CONFIDENCES),
        _one_of("severity", F.col("severity"), SEVERITIES),
        _one_of("source_type", F.col("source_type"), SOURCE_TYPES),
        ("code: empty", F.col("code") == ""),
        ("confidence_score: outside of 0 to 1", (F.col("confidence_score") < 0) | (F.col("confidence_score") > 1)),
    ]
    return _messages(checks)


def rejects(df: DataFrame, row_id: str) -> DataFrame:
    """(row id, message), a row for each violation."""
    return df.select(row_id, F.explode(example_errors()).alias("message"))


def valid_or_fail(df: DataFrame, row_id: str) -> DataFrame:
    """``df`` itself; raises, naming the first invalid row by its id, if there is one."""
    first = rejects(df, row_id).orderBy(row_id, "message").limit(1).collect()
    if first:
        raise ValueError(f"invalid example at {first[0][0]}: {first[0][1]}")
    return df


def manifest_errors() -> Column:
    """Messages for dataset manifests (dataset_id, version, split_seed, n_train, n_val, n_test)."""
    counts = [(f"{c}: negative or missing", F.col(c).isNull() | (F.col(c) < 0)) for c in ("n_train", "n_val", "n_test")]
    return _messages([("dataset_id: required", F.coalesce("dataset_id", F.lit("")) == ""), ("version: not a version", ~F.coalesce("version", F.lit("")).rlike(SEMVER)), ("split_seed: required", F.col("split_seed").isNull()), *counts])


def model_errors() -> Column:
    """Messages for registry entries (path, found, status, version, adapter_type, rank): a missing file says only that."""
    bad = _messages(
        [
            _one_of("status", F.coalesce("status", F.lit("")), MODEL_STATUSES),
            ("version: not a version", ~F.coalesce("version", F.lit("")).rlike(SEMVER)),
            _one_of("adapter type", F.col("adapter_type"), ADAPTER_TYPES),
            ("rank: below 1", F.col("rank") < 1),
        ]
    )
    return F.when(~F.col("found"), F.array(F.lit("file is missing"))).otherwise(bad)


def training_config(rank: Column, targets: Column) -> Column:
    """Adapter defaults: rank 16, query and value projections."""
    return F.struct(F.coalesce(rank, F.lit(16)).alias("rank"), F.coalesce(targets, F.array(F.lit("q_proj"), F.lit("v_proj"))).alias("targets"))
