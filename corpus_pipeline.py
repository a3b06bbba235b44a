"""A corpus from raw documents to packed sequences, in five stages.

Each stage gets all that its predecessor kept, as a Parquet table, and returns
the rows that go on; all but the last return the columns of ``documents``.

Nulls and odd input, in every stage: an empty table gives an empty one. Null ids
are ids like any other. Repeated rows are judged alike, and stay or go together
until near-dedup, which keeps one of them. More columns, with whatever names, are
passed on unread by all stages but packing, which drops them. Texts of any length
are read whole. What a null or empty text means is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.llm import decontamination, line_dedup, packing, quality_classifier, simhash
from reviewloom.llm.queries import graded_labels
from reviewloom.llm.shared import table, tables_made, written

#: No stage but the first could be put in SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the quality classifier, fitted on the labels, rejects.

    Nothing speaks against a null or empty text, so it stays; without labels of two grades everything does.
    """
    return quality_classifier.classify(docs, graded_labels(spark, sf_dir), drop_rejected=True)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that recur across documents, and documents that had words but nothing else than such lines.

    A null or empty text has no lines to drop and stays; equal texts count once. ``n_chars`` is counted anew.
    """
    out = line_dedup.drop_recurring_lines(docs)
    empty = (F.col("n_dropped") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    columns = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.where(~F.coalesce(empty, F.lit(False))).select(*[columns[c].alias(c) if c in columns else F.col(f"row.`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group of near copies (five-word shingles, similarity 0.8).

    Texts without words, null ones too, are copies of each other. A null id comes before all others; of rows
    of one id, that with the smallest hash of its text stays for the group, and of equal rows any one.
    """
    text_key = F.xxhash64("text").alias("text_key")
    groups = simhash.similar_documents(docs.select(F.struct("doc_id", text_key).alias("id"), "text"), size=5, similarity=0.8, id_col="id")
    stay = groups.where(F.col("id") == F.col("component_id")).select(F.col("id.doc_id").alias("stay_id"), F.col("id.text_key").alias("stay_key")).distinct()
    # Rows go as one struct, so that no column of theirs can clash.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("row_id"), text_key)
    kept = rows.join(stay, rows["row_id"].eqNullSafe(stay["stay_id"]) & (rows["text_key"] == stay["stay_key"]), "left_semi")
    # A document's own repeats are copies of it as well.
    return kept.dropDuplicates(["row_id", "text_key"]).select("row.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item; a null or empty text holds none, nor is there an item without words."""
    return decontamination.drop_leaking(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all that is left, packed into sequences; a null text is an empty one, of its closing id only."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("simhash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of ``documents`` after all stages; of the tables on the way, only the last stage's input stays."""
    docs = table(spark, sf_dir, "documents")
    with tables_made(spark) as drop_but:
        for name, stage in STAGES[:-1]:
            docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            drop_but((name.replace(" ", "-"),))
    return STAGES[-1][1](spark, docs, sf_dir)
