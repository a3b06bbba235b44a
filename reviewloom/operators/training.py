"""Model-side records: masked token rows, seeded order and batches, loss history; and paging of landed listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.operators.numbering import numbered

#: Fixed value: label of tokens that do not count.
IGNORED = "-100"


def masked_labels(prompt: Column, target: Column, max_length: int) -> Column:
    """(tokens, labels): prompt tokens are masked; cut at ``max_length``, so a long prompt leaves no target."""
    tokens = F.slice(F.concat(prompt, target), 1, max_length)
    n = F.size(prompt)
    # No lambda over the tokens: it would take the prompt apart again for each of them.
    labels = F.concat(F.array_repeat(F.lit(IGNORED), F.least(n, F.size(tokens))), F.slice(tokens, n + 1, F.lit(max_length)))
    return F.struct(tokens.alias("tokens"), labels.alias("labels"))


def padded(items: Column, length: Column, filler: str) -> Column:
    """Padded on the right."""
    return F.concat(items, F.array_repeat(F.lit(filler), F.greatest(length - F.size(items), F.lit(0))))


def shuffle_key(row_id: Column, seed: int) -> Column:
    """Ordering by it is a shuffle that depends on the seed and the id only."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), row_id.cast("string")), 256)


def batches(df: DataFrame, size: int, order: Sequence[Column], sequences: dict[str, str]) -> DataFrame:
    """(batch, place, longest, row): every row as a struct in its batch of ``size``, its ``sequences`` padded on the right.

    Batches are numbered without gaps over the whole table in ``order`` (a :func:`shuffle_key`
    for a seeded shuffle), the last may be smaller. ``sequences``: columns of arrays, with the
    filler of each; they are padded to the longest array of the batch, ``longest``. Rows are
    numbered by a distributed sort, and a task never holds more than one batch at a time
    besides. A null array is an empty one. An empty table has no batches.
    """
    if size < 1:
        raise ValueError("a batch has at least one row")
    placed = numbered(df, order).select(F.floor(F.col("position") / size).cast("long").alias("batch"), (F.col("position") % size).cast("int").alias("place"), "row")
    length = F.greatest(*[F.coalesce(F.size(F.col("row")[c]), F.lit(0)) for c in sequences], F.lit(0), F.lit(0))
    whole = placed.groupBy("batch").agg(F.max(length).alias("longest"), F.collect_list(F.struct("place", "row")).alias("rows"))
    each = whole.select("batch", "longest", F.inline("rows"))
    filled = F.col("row")
    for c, filler in sequences.items():
        items = F.coalesce(F.col("row")[c], F.array().cast(df.schema[c].dataType))
        filled = filled.withField(f"`{c}`", F.concat(items, F.array_repeat(F.lit(filler).cast(df.schema[c].dataType.elementType), F.col("longest") - F.size(items))))
    return each.select("batch", "place", "longest", filled.alias("row"))


def final_loss(history: Column) -> Column:
    return F.coalesce(F.try_element_at(history, F.lit(-1)), F.lit(float("nan")))


def encoded_path(path: Column) -> Column:
    """Each segment percent-encoded, the slashes kept."""
    out = F.transform(F.split(path, "/"), lambda x: F.url_encode(x))
    joined = F.array_join(out, "/")
    for code, plain in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        joined = F.replace(joined, F.lit(code), F.lit(plain))
    return joined


def next_page(link: Column) -> Column:
    """Target of the first ``rel="next"`` of a link header, else null."""
    return F.nullif(F.regexp_extract(link, '<([^>]*)>\\s*;\\s*rel="next"', 1), F.lit(""))


def retry_wait(status: Column, remaining: Column, reset: Column, now: Column) -> Column:
    """Seconds to wait, at least 1, where a request was turned down for its rate; else null."""
    return F.when((status == 403) & (remaining == "0"), F.greatest(reset - now, F.lit(1)))
