"""Proposed signals, review files and their promotion to examples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from reviewloom.functions.text import first_keyword, truncate
from reviewloom.functions.vocabulary import KEYWORD_FAMILIES
from reviewloom.operators.ingest import latest

Families = Sequence[tuple[str, str, Sequence[str]]]


def _family_hits(text: Column, families: Families) -> Column:
    """Array of (category, severity, keyword) of the families that match, in order."""
    cells = [F.struct(F.lit(c).alias("category"), F.lit(s).alias("severity"), first_keyword(text, k).alias("keyword")) for c, s, k in families]
    return F.filter(F.array(*cells), lambda x: x["keyword"].isNotNull())


def _of_title(title: Column, families: Families) -> Column:
    return F.transform(
        _family_hits(title, families),
        lambda x: F.struct(
            x["category"].alias("category"),
            F.lit("possible").alias("confidence"),
            x["severity"].alias("severity"),
            F.concat(F.lit("PR title suggests a "), x["category"], F.lit(' change: "'), title, F.lit('"')).alias("summary"),
            F.lit(None).cast("string").alias("reviewer_comment"),
            F.concat(F.lit("title-keyword:"), x["keyword"]).alias("rule"),
            title.alias("evidence"),
        ),
    )


def _of_comment(comment: Column, families: Families) -> Column:
    body, path = comment["body"], comment["path"]
    where = F.when(F.coalesce(path, F.lit("")) != "", F.concat(F.lit(" in "), path)).otherwise("")
    return F.transform(
        _family_hits(body, families),
        lambda x: F.struct(
            x["category"].alias("category"),
            F.lit("likely").alias("confidence"),
            x["severity"].alias("severity"),
            F.concat(F.lit("Reviewer comment suggests a "), x["category"], F.lit(" finding"), where, F.lit(".")).alias("summary"),
            body.alias("reviewer_comment"),
            F.concat(F.lit("review-comment-keyword:"), x["keyword"]).alias("rule"),
            truncate(body).alias("evidence"),
        ),
    )


def bound(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _first_of_each(items: Column, key) -> Column:
    """Keeps the first item of each key, in order; a key is a struct or string of the item.

    Keys are sorted with their places, so the first place of each stands beside
    another key; items and keys are evaluated once.
    """

    def firsts(ranked: Column) -> Column:
        fresh = F.filter(ranked, lambda x, j: (j == 0) | ~x["k"].eqNullSafe(F.get(ranked, j - 1)["k"]))
        return F.sort_array(F.transform(fresh, lambda x: x["i"]))

    def kept(all_items: Column) -> Column:
        ranked = F.sort_array(F.transform(all_items, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"))))
        return F.transform(bound(ranked, firsts), lambda i: F.get(all_items, i))

    return bound(items, kept)


def proposals(title: Column, comments: Column, families: Families = KEYWORD_FAMILIES) -> Column:
    """Title hits, then comment hits in order, the first of each (category, rule, evidence).

    ``comments`` is an array of struct(path, body). All within the row: no explode, no shuffle.
    """
    of_comments = F.flatten(F.transform(F.coalesce(comments, F.array()), lambda c: _of_comment(c, families)))
    key = lambda p: F.concat_ws(":", p["category"], p["rule"], p["evidence"])
    return _first_of_each(F.concat(F.coalesce(_of_title(title, families), F.array()), of_comments), key)


def review_file(raw: DataFrame, families: Families = KEYWORD_FAMILIES) -> DataFrame:
    """(repository, pull_number, source_url, title, proposals) of the pull requests that have a proposal."""
    found = raw.select("repository", "pull_number", "source_url", "title", proposals(F.col("title"), F.col("comments"), families).alias("proposals"))
    return found.where(F.size("proposals") > 0)


def without_bookkeeping(items: Column) -> Column:
    return F.transform(items, lambda p: p.dropFields("rule", "evidence"))


def promote(raw: DataFrame, review: DataFrame, order: str = "ord") -> DataFrame:
    """Raw rows joined with the last review entry of their key; entries emptied by the reviewer drop out.

    The key is compared as text. Raw duplicates are kept.
    """
    entry = latest(review.select("repository", F.col("pull_number").cast("string").alias("_pr"), "proposals", order), ["repository", "_pr"], order)
    joined = raw.withColumn("_pr", F.col("pull_number").cast("string")).join(entry.drop(order), ["repository", "_pr"])
    return joined.where(F.size("proposals") > 0).withColumn("signals", without_bookkeeping(F.col("proposals"))).drop("_pr", "proposals")


def not_promoted(raw: DataFrame, review: DataFrame) -> DataFrame:
    """Raw rows without any review entry."""
    keys = review.select("repository", F.col("pull_number").cast("string").alias("_pr")).distinct()
    return raw.withColumn("_pr", F.col("pull_number").cast("string")).join(keys, ["repository", "_pr"], "left_anti").drop("_pr")


def example_id(repository: Column, commit: Column, changes: Column, signals: Column) -> Column:
    """SHA-256 of the JSON of these parts in this order, nulls left out."""
    return F.sha2(F.to_json(F.struct(repository.alias("repository"), commit.alias("commitSha"), changes.alias("changes"), signals.alias("signals"))), 256)


def counted(df: DataFrame, observation: Observation, **conditions: Column) -> DataFrame:
    """``df`` itself; as it runs, ``observation`` gets its rows (``total``) and the rows of each condition, without another pass."""
    counts = [F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in conditions.items()]
    return df.observe(observation, F.count(F.lit(1)).alias("total"), *counts)
