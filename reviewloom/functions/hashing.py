"""Checksums, hash buckets and order-free set digests."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Size of the bucket space: the first four bytes of a SHA-256 digest.
BUCKET_SPACE = 1 << 32
#: Hex digits that the members of a node share, level by level: 16 million nodes, 4,096 nodes, and the root.
TREE = (6, 3)


def text_checksum(text: Column) -> Column:
    return F.sha2(text, 256)


def hash_bucket(checksum: Column, seed: int) -> Column:
    """First four bytes, big-endian, of SHA-256("seed:checksum")."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), checksum), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def canonical_json(line: str | None) -> str | None:
    """Sorted keys, compact separators, ASCII escapes; None for a line that is not JSON."""
    if line is None:
        return None
    try:
        return json.dumps(json.loads(line), sort_keys=True, separators=(",", ":"), ensure_ascii=True)
    except ValueError:
        return None


@F.pandas_udf(T.StringType())
def canonical_checksum(raw: pd.Series) -> pd.Series:
    """SHA-256 of the canonical JSON of each raw line (Arrow batches; null for broken lines)."""
    forms = raw.map(canonical_json)
    return forms.map(lambda s: None if s is None else hashlib.sha256(s.encode()).hexdigest())


def set_checksum(df: DataFrame, by: list[str], digest: str, out: str) -> DataFrame:
    """SHA-256 of the sorted, concatenated hex digests of each group.

    The definition concatenates all digests of a group, so one row holds 64 bytes
    a member; that is bounded by Spark's 2 GB row, about 30 million members.
    Groups beyond it are to be digested with :func:`set_checksums_in_order`, or with :func:`set_checksum_tree`.
    """
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sha2(F.array_join(F.sort_array(F.collect_list(digest)), ""), 256).alias(out),
    )


def set_checksums_in_order(df: DataFrame, by: str, digest: str) -> dict[str, tuple[int, str]]:
    """(members, SHA-256 of the sorted, concatenated hex digests) of each value of ``by``, for sets of any size.

    SHA-256 has no mergeable state, so the digests are sorted by range and pass the
    driver in order, a few megabytes at a time; none of it is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, digests = b.column(0).to_pylist(), b.column(1).to_pylist()
            starts = [i for i in range(len(names)) if i == 0 or names[i] != names[i - 1]]
            for i, j in zip(starts, [*starts[1:], len(names)], strict=True):
                yield pa.RecordBatch.from_pydict({"part": [names[i]], "n": [j - i], "chunk": ["".join(digests[i:j])]})

    parts = df.select(F.col(by).cast("string").alias("part"), F.col(digest).alias("digest")).sort("part", "digest").mapInArrow(run, "part string, n long, chunk string")
    done: dict[str, tuple[int, object]] = {}
    for r in parts.toLocalIterator(prefetchPartitions=True):
        n, h = done.get(r.part, (0, hashlib.sha256()))
        h.update(r.chunk.encode())
        done[r.part] = (n + r.n, h)
    return {k: (n, h.hexdigest()) for k, (n, h) in done.items()}


def set_checksum_tree(df: DataFrame, by: list[str], digest: str, out: str, widths: Sequence[int] = TREE) -> DataFrame:
    """(by, n, out): order-free digest of each group's set of hex digests, for groups of any size.

    Members that share their first ``widths[0]`` hex digits make a node, whose digest is the
    SHA-256 of theirs, sorted and concatenated; nodes that share the first ``widths[1]`` digits
    make a node of the next level by their prefix' order, and so on up to one root. Each level is an
    aggregation, and no row holds more than a 16^widths[0]-th of a group, or 16^(widths[i] - widths[i + 1])
    nodes. Without ``by`` the whole table is one group, whose root without members is the digest of nothing.
    """
    nodes = df.select(*by, F.col(digest).alias("_key"), F.col(digest).alias("_digest"), F.lit(1).cast("long").alias("_n"))
    for w in (*widths, 0):
        level = nodes.groupBy(*by, F.substring("_key", 1, w).alias("_node")) if w else nodes.groupBy(*by)
        inner = F.transform(F.sort_array(F.collect_list(F.struct("_key", "_digest"))), lambda x: x["_digest"])
        made = level.agg(F.coalesce(F.sum("_n"), F.lit(0).cast("long")).alias("_n"), F.sha2(F.array_join(inner, ""), 256).alias("_digest"))
        nodes = made.withColumnRenamed("_node", "_key")
    return nodes.select(*by, F.col("_n").alias("n"), F.col("_digest").alias(out))
