"""Normalisation of examples and their projection to training rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.functions.text import blank_to_null, js_trim
from reviewloom.operators.label import _first_of_each


def unique_strings(items: Column) -> Column:
    """Trimmed, without empty ones, the first of each."""
    return F.array_distinct(F.filter(F.transform(items, js_trim), lambda x: x != ""))


def normalize_signals(signals: Column) -> Column:
    """Trimmed summaries and comments (a blank comment is null), no blank summary, the first of each (category, summary, confidence)."""
    trimmed = F.transform(
        signals,
        lambda s: F.struct(
            s["category"].alias("category"),
            s["confidence"].alias("confidence"),
            s["severity"].alias("severity"),
            js_trim(s["summary"]).alias("summary"),
            blank_to_null(js_trim(s["reviewer_comment"])).alias("reviewer_comment"),
        ),
    )
    full = F.filter(trimmed, lambda s: s["summary"] != "")
    return _first_of_each(full, lambda s: F.struct(s["category"], s["summary"], s["confidence"]))


def render_changes(changes: Column) -> Column:
    """``// path`` and the new text of each change that has one, parted by blank lines."""
    full = F.filter(changes, lambda c: F.length(c["after"]) > 0)
    return F.array_join(F.transform(full, lambda c: F.concat(F.lit("// "), c["path"], F.lit("\n"), c["after"])), "\n\n")


def project_training(examples: DataFrame) -> DataFrame:
    """One training row for each signal of an example with an allowed licence and code to show."""
    open_ = examples.where(F.col("license_status") == "allowed").withColumn("code", render_changes(F.col("changes"))).where(F.col("code") != "")
    first = lambda name: F.get(F.col(name), F.lit(0))
    return open_.select(
        "language",
        first("frameworks").alias("framework"),
        first("libraries").alias("library"),
        first("databases").alias("database"),
        "code",
        F.lit("commit").alias("source_type"),
        "source_url",
        "repository",
        "commit_sha",
        "spdx",
        F.explode("signals").alias("signal"),
    ).select("*", "signal.*").drop("signal").withColumn("context", F.col("reviewer_comment"))
