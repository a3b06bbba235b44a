"""Queries: masked token rows, seeded order and batches, positional pairs, loss, paging."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewloom.operators import evaluate, training
from reviewloom.sources.tables import table

MAX_LENGTH = 24
#: Rows of a batch, the tokens that its rows are cut at, and the seed of its order.
BATCH, BATCH_LENGTH, BATCH_SEED = 16, 512, 11


def label_mask(spark, sf):
    words = F.split("text", " ")
    cut = F.floor(F.size(words) / 10).cast("int")
    rows = table(spark, sf, "documents").select("doc_id", training.masked_labels(F.slice(words, F.lit(1), cut), F.slice(words, cut + 1, F.size(words)), MAX_LENGTH).alias("x"))
    return rows.select("doc_id", F.array_join(training.padded(F.col("x.tokens"), F.lit(MAX_LENGTH), "<pad>"), " ").alias("tokens"), F.array_join(training.padded(F.col("x.labels"), F.lit(MAX_LENGTH), training.IGNORED), " ").alias("labels"))


def seeded_shuffle(spark, sf):
    return table(spark, sf, "documents").select("doc_id", training.shuffle_key(F.col("doc_id"), 7).alias("shuffle_key"))


def token_batches(spark, sf):
    """Masked token rows in seeded batches, padded to the longest of each batch."""
    words = F.split("text", " ")
    cut = F.floor(F.size(words) / 10).cast("int")
    masked = training.masked_labels(F.slice(words, F.lit(1), cut), F.slice(words, cut + 1, F.size(words)), BATCH_LENGTH)
    rows = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", masked.alias("x")).select("doc_id", F.col("x.tokens").alias("tokens"), F.col("x.labels").alias("labels"))
    made = training.batches(rows, BATCH, [training.shuffle_key(F.col("doc_id"), BATCH_SEED), F.col("doc_id")], {"tokens": "<pad>", "labels": training.IGNORED})
    digest = lambda c: F.sha2(F.array_join(F.col(f"row.{c}"), " "), 256).alias(c)
    return made.select("batch", F.col("place").cast("long").alias("place"), F.col("longest").cast("long").alias("longest"), F.col("row.doc_id").alias("doc_id"), digest("tokens"), digest("labels"))


def positional_pairs(spark, sf):
    """Each document's language beside that of the document in its place after a seeded shuffle."""
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    both = evaluate.paired_in_order(docs, docs, [training.shuffle_key(F.col("doc_id"), BATCH_SEED), F.col("doc_id")], [F.col("doc_id")])
    return both.select("position", F.col("predicted.doc_id").alias("predicted_id"), F.col("expected.doc_id").alias("expected_id"), F.col("predicted.lang").eqNullSafe(F.col("expected.lang")).alias("same"))


def loss_summary(spark, sf):
    history = F.slice(F.array(F.lit(3.0), F.lit(2.5), F.lit(2.0)), 1, (F.col("doc_id") % 4).cast("int"))
    loss = training.final_loss(history)
    return table(spark, sf, "documents").select("doc_id", F.size(history).cast("long").alias("steps"), F.when(~F.isnan(loss), loss).alias("final_loss"))


def path_encode(spark, sf):
    path = F.concat("source", F.lit("/a b+(c)!~*é/"), "text")
    return table(spark, sf, "documents").select("doc_id", F.sha2(training.encoded_path(path), 256).alias("path"))


def paging(spark, sf):
    k = F.col("page_id")
    link = F.when(k % 3 == 0, F.concat(F.lit('<https://h/p?page=1>; rel="prev", <'), F.col("url"), F.lit('>; rel="next", <https://h/z>; rel="last"'))).when(k % 3 == 1, F.lit('<https://h/z>; rel="last"'))
    wait = training.retry_wait(F.when(k % 5 == 0, 403).otherwise(200), (k % 2).cast("string"), k, F.lit(100))
    return table(spark, sf, "pages").select("page_id", training.next_page(link).alias("next_page"), wait.cast("long").alias("wait"))


QUERIES = {f.__name__: f for f in (label_mask, seeded_shuffle, token_batches, positional_pairs, loss_summary, path_encode, paging)}

_ENCODED = "url_encode(x)"
for _code, _plain in (("%21", "!"), ("%27", "''"), ("%28", "("), ("%29", ")"), ("%2A", "*")):
    _ENCODED = f"replace({_ENCODED}, '{_code}', '{_plain}')"

ORACLES = {
    "label_mask": f"""WITH w AS (SELECT doc_id, string_split(text, ' ') AS ws FROM documents), t AS (SELECT doc_id, ws[1:len(ws) // 10] AS p, ws[1:{MAX_LENGTH}] AS ts FROM w)
SELECT doc_id, array_to_string(ts || list_transform(range(len(ts), {MAX_LENGTH}), lambda i: '<pad>'), ' ') AS tokens,
array_to_string(list_transform(range(1, {MAX_LENGTH + 1}), lambda i: CASE WHEN i <= len(p) OR i > len(ts) THEN '-100' ELSE ts[i] END), ' ') AS labels FROM t""",
    "seeded_shuffle": "SELECT doc_id, sha256('7:' || doc_id) AS shuffle_key FROM documents",
    "token_batches": f"""WITH w AS (SELECT doc_id, string_split(text, ' ')[1:{BATCH_LENGTH}] AS ts, len(string_split(text, ' ')) // 10 AS n, row_number() OVER (ORDER BY sha256('{BATCH_SEED}:' || doc_id) NULLS FIRST, doc_id) - 1 AS position FROM documents WHERE text IS NOT NULL),
b AS (SELECT doc_id, ts, n, position // {BATCH} AS batch, position % {BATCH} AS place, max(len(ts)) OVER (PARTITION BY position // {BATCH}) AS longest FROM w)
SELECT batch::BIGINT AS batch, place::BIGINT AS place, longest::BIGINT AS longest, doc_id, sha256(array_to_string(ts || list_transform(range(len(ts), longest), lambda i: '<pad>'), ' ')) AS tokens,
sha256(array_to_string(list_transform(range(1, longest + 1), lambda i: CASE WHEN i <= n OR i > len(ts) THEN '-100' ELSE ts[i] END), ' ')) AS labels FROM b""",
    "positional_pairs": f"""WITH p AS (SELECT doc_id, lang, row_number() OVER (ORDER BY sha256('{BATCH_SEED}:' || doc_id) NULLS FIRST, doc_id NULLS FIRST) - 1 AS position FROM documents),
e AS (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id NULLS FIRST) - 1 AS position FROM documents)
SELECT position, p.doc_id AS predicted_id, e.doc_id AS expected_id, p.lang IS NOT DISTINCT FROM e.lang AS same FROM p JOIN e USING (position)""",
    "loss_summary": "SELECT doc_id, (doc_id % 4)::BIGINT AS steps, CASE doc_id % 4 WHEN 1 THEN 3.0 WHEN 2 THEN 2.5 WHEN 3 THEN 2.0 END::DOUBLE AS final_loss FROM documents",
    "path_encode": f"SELECT doc_id, sha256(array_to_string(list_transform(string_split(source || '/a b+(c)!~*é/' || text, '/'), lambda x: {_ENCODED}), '/')) AS path FROM documents",
    "paging": "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url END AS next_page, CASE WHEN page_id % 5 = 0 AND page_id % 2 = 0 THEN greatest(page_id - 100, 1) END AS wait FROM pages",
}
