"""Landed pull requests with their signals to dataset examples, and whole-example normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.functions.text import blank_to_null, js_trim
from reviewloom.operators.ingest import complete_pairs, language_of_files
from reviewloom.operators.label import example_id
from reviewloom.operators.project import normalize_signals, unique_strings

#: Lists of an example that name technologies.
LISTS = ("frameworks", "libraries", "databases", "tools")


def code_changes(files: Column) -> Column:
    """Files with both sides, as changes: their status is left out."""
    return F.transform(complete_pairs(files), lambda f: F.struct(*[f[c].alias(c) for c in ("path", "before", "after", "additions", "deletions")]))


def provenance(host: Column, repository: Column, merge_commit: Column, source_url: Column, spdx: Column, license_status: Column, collected_at: Column) -> Column:
    """Where an example is from; an empty licence is none."""
    cells = {
        "host": host,
        "repository": repository,
        "commit_sha": merge_commit,
        "source_url": source_url,
        "license_spdx": blank_to_null(spdx),
        "license_status": license_status,
        "collected_at": collected_at,
    }
    return F.struct(*[c.alias(n) for n, c in cells.items()])


def to_examples(raw: DataFrame) -> DataFrame:
    """One example for each row of (host, repository, merge_commit_sha, source_url, spdx, license_status, collected_at, files, signals).

    (id, language, frameworks, libraries, databases, tools, changes, signals, provenance):
    the language is that of the first file with a known one, whether it has both
    sides or not; the technology lists are empty. All within the row.
    """
    nested = raw.select(
        language_of_files(F.col("files")).alias("language"),
        *[F.array().cast("array<string>").alias(c) for c in LISTS],
        code_changes(F.col("files")).alias("changes"),
        "signals",
        provenance(*[F.col(c) for c in ("host", "repository", "merge_commit_sha", "source_url", "spdx", "license_status", "collected_at")]).alias("provenance"),
    )
    return nested.select(example_id(F.col("provenance.repository"), F.col("provenance.commit_sha"), F.col("changes"), F.col("signals")).alias("id"), "*")


def normalize_examples(examples: DataFrame) -> DataFrame:
    """Trimmed and distinct technologies, normalised signals, trimmed repository and source url; the id stays."""
    trimmed = F.col("provenance").withField("repository", js_trim(F.col("provenance.repository"))).withField("source_url", js_trim(F.col("provenance.source_url")))
    return examples.withColumns({**{c: unique_strings(F.col(c)) for c in LISTS}, "signals": normalize_signals(F.col("signals")), "provenance": trimmed})
