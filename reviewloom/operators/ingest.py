"""Landed pull-request records to dataset examples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.functions.vocabulary import ALLOWED_LICENSES, FILE_STATUSES, LANGUAGE_SUFFIXES

#: Largest file content that is decoded, in bytes; pages of the pull-request listing and their size.
MAX_CONTENT, MAX_PAGES, PER_PAGE = 200_000, 10, 50


def language_of(path: Column) -> Column:
    """Language by suffix, case-sensitive; null for others."""
    out = F.lit(None).cast("string")
    for language, suffixes in reversed(LANGUAGE_SUFFIXES):
        hit = F.lit(False)
        for s in suffixes:
            hit = hit | F.endswith(path, F.lit(s))
        out = F.when(hit, language).otherwise(out)
    return out


def dialect_of(path: Column) -> Column:
    """Grammar of a script path: tsx for .jsx and .tsx, typescript for the others, null if it is no script."""
    return F.when(path.rlike(r"\.[jt]sx$"), "tsx").when(path.rlike(r"\.[mc]?[jt]s$"), "typescript")


def extension_of(path: Column) -> Column:
    """From the last dot on; empty without one."""
    return F.regexp_extract(path, r"\.[^.]*$", 0)


def supported(path: Column, languages: Sequence[str]) -> Column:
    suffixes = [s for language, all_of in LANGUAGE_SUFFIXES if language in languages for s in all_of]
    return extension_of(path).isin(suffixes)


def language_of_files(files: Column) -> Column:
    """Language of the first file, in order, that has a known one, else javascript. ``files``: array of struct with path."""
    known = F.filter(F.transform(files, lambda f: language_of(f["path"])), lambda x: x.isNotNull())
    return F.coalesce(F.try_element_at(known, F.lit(1)), F.lit("javascript"))


def license_spdx(landed: Column) -> Column:
    """NOASSERTION stands for no licence."""
    return F.nullif(landed, F.lit("NOASSERTION"))


def license_status(spdx: Column) -> Column:
    return F.when(spdx.isNull() | (spdx == ""), "unknown").when(spdx.isin(*ALLOWED_LICENSES), "allowed").otherwise("review-required")


def file_status(status: Column) -> Column:
    return F.when(status.isin(*FILE_STATUSES), status).otherwise("modified")


def complete_pairs(files: Column) -> Column:
    """Files with both sides; an empty side is a value."""
    return F.filter(files, lambda f: f["before"].isNotNull() & f["after"].isNotNull())


def decoded_content(content: Column, encoding: Column, size: Column) -> Column:
    """Text of a base64 payload, bad bytes replaced; null if it is missing, too large or encoded otherwise."""
    plain = F.make_valid_utf8(F.unbase64(F.regexp_replace(content, r"\s", "")).cast("string"))
    return F.when((size <= MAX_CONTENT) & (encoding == "base64"), plain)


def merged_since(pulls: DataFrame, since=None, max_pages: int = MAX_PAGES, per_page: int = PER_PAGE) -> DataFrame:
    """Merged pull requests of the newest pages (``updated_at`` descending, then ``number``).

    The page cap and the stop at the first older one hold for the stream of closed
    pull requests as it is listed, so they come before the merged filter. The
    listing is a top-k: each partition keeps its own newest rows first.
    """
    newest = pulls.orderBy(F.desc("updated_at"), F.desc("number")).limit(max_pages * per_page)
    if since is not None:
        newest = newest.where(F.col("updated_at") >= F.lit(since))
    return newest.where(F.col("merged_at").isNotNull() & (F.coalesce("merge_commit_sha", F.lit("")) != ""))


def assemble(pulls: DataFrame, files: DataFrame, comments: DataFrame, licenses: DataFrame) -> DataFrame:
    """One row for each pull request with its files and comments nested, and its repository's licence."""
    key = ["repository", "number"]
    nested = lambda df, name: df.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("ord", *[c for c in df.columns if c not in (*key, "ord")]))).alias(name))
    out = pulls.join(nested(files, "files"), key, "left").join(nested(comments, "comments"), key, "left").join(licenses, "repository", "left")
    return out.withColumns({"spdx": license_spdx(F.col("spdx")), "license_status": license_status(license_spdx(F.col("spdx")))})


def latest(df: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """The last row of each key by ``order``, in one aggregation with map-side combine."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_last")).select(*key, "_last.*")
