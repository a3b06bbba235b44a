"""Sharding by a minimax contiguous partition.

Rows with equal texts form an atomic group. Groups are ordered by their text's
SHA-256, and the order is cut into contiguous shards so that the largest shard
is as small as it can be: the smallest feasible capacity is found by binary
search, each candidate checked by filling shards greedily, and the order is cut
where the greedy filling at that capacity cuts.

The search never needs all groups. It works on a summary of the order by leading
hex digits of the key (total size, largest group, number of groups for each
prefix) of which the driver holds a few thousand rows at a time. Treating a
prefix as one block bounds the capacity from above, letting it be cut anywhere
bounds it from below; only prefixes that a cut may fall into are opened by more
digits, until both bounds meet. The result is exact.

Nulls and odd input: a null text has no bytes, size 1 and CRC 0; all null texts
form one group, apart from empty texts. Null ids and repeated rows are rows like
any other. With fewer groups than shards, or no rows, some shards stay empty.
Other columns are not read; an output that has the id's name gets an underscore
before it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.llm.shared import beside, written

#: Hex digits by which a prefix is opened: 16 ** DIGITS rows at most for each.
DIGITS = 3
#: The key of null texts; it sorts before every hex digit.
NULL_KEY = "!"


def _summary(groups: DataFrame, digits: int, within: list[str] | None = None) -> list[tuple]:
    """(prefix, total, largest, groups) by leading digits; ``within`` limits it to shorter prefixes."""
    if within is not None:
        groups = groups.where(F.substring("key", 1, digits - DIGITS).isin(within))
    rows = groups.groupBy(F.substring("key", 1, digits).alias("p")).agg(F.sum("total").alias("t"), F.max("total").alias("m"), F.count(F.lit(1)).alias("n"))
    return [(r.p, r.t, r.m, r.n) for r in rows.collect()]


def _fill(ends: np.ndarray, single: np.ndarray, capacity: int, shards: int, fluid: bool) -> list[int]:
    """Where greedy filling at this capacity ends each shard.

    ``fluid`` lets it stop anywhere inside blocks of several groups.
    """
    at, stops = 0, []
    for _ in range(shards):
        i = int(np.searchsorted(ends, at + capacity, "right"))
        low = int(ends[i - 1]) if i else 0
        at = max(at, at + capacity if fluid and i < len(ends) and not single[i] else low)
        stops.append(min(at, int(ends[-1])))
    return stops


def _smallest(ends: np.ndarray, single: np.ndarray, least: int, shards: int, fluid: bool) -> int:
    """The smallest capacity of at least ``least`` at which all fits."""
    lo, hi = max(least, -(-int(ends[-1]) // shards)), int(ends[-1])
    while lo < hi:
        mid = (lo + hi) // 2
        if _fill(ends, single, mid, shards, fluid)[-1] >= ends[-1]:
            hi = mid
        else:
            lo = mid + 1
    return lo


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[int, list[str]]:
    """(capacity, cut prefixes) for ``groups`` (key, total): a shard ends after all keys of its cut prefix."""
    nodes = sorted(_summary(groups, DIGITS))
    while True:
        if not nodes:
            return 0, []
        ends = np.cumsum([n[1] for n in nodes])
        single = np.array([n[3] == 1 for n in nodes])
        most = max(n[2] for n in nodes)
        low = _smallest(ends, single, most, shards, True)
        high = _smallest(ends, single, max(most, max((n[1] for n in nodes))), shards, False)
        if low == high:
            stops = _fill(ends, single, high, shards, False)
            cuts = [nodes[int(np.searchsorted(ends, s))][0] for s in stops[:-1] if s < ends[-1]]
            return high, cuts
        # A cut may fall anywhere between the tightest and the widest filling.
        first, last = _fill(ends, single, low, shards, False), _fill(ends, single, high, shards, True)
        big = max(n[1] for n in nodes if n[3] > 1)
        hit = {
            i
            for a, b in zip(first[:-1], last[:-1], strict=True)
            for i in range(int(np.searchsorted(ends, a, "right")), min(int(np.searchsorted(ends, b)) + 1, len(nodes)))
        } | {i for i, n in enumerate(nodes) if n[1] == big}
        opened = {i for i in hit if not single[i]}
        if not opened:
            # The bounds can differ only by a block of several groups; the largest one is opened first.
            opened = {max((i for i in range(len(nodes)) if not single[i]), key=lambda i: nodes[i][1])}
        by_length: dict[int, list[str]] = {}
        for i in opened:
            by_length.setdefault(len(nodes[i][0]), []).append(nodes[i][0])
        finer = [n for length, within in by_length.items() for n in _summary(groups, length + DIGITS, within)]
        nodes = sorted([n for i, n in enumerate(nodes) if i not in opened] + finer)


def group_key(text: Column) -> Column:
    return F.coalesce(F.sha2(text, 256), F.lit(NULL_KEY))


def assign_shards(df: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard, key, capacity) for each row of ``df``.

    The law is ``bytes``: shard sizes are near equal, the largest is minimal for
    this order of groups. ``size`` is UTF-8 bytes plus 1, ``slot`` is gapless
    from 0 in each shard, ``key`` names the group.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    text = F.col(text_col)
    rows = df.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("crc"),
        group_key(text).alias("key"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = written(rows, "shard-rows")
    capacity, cuts = minimax_cuts(rows.groupBy("key").agg(F.sum("size").alias("total")), shards)
    # "g" sorts after every hex digit: a key is beyond a cut if it sorts after all keys of the cut's prefix.
    beyond = [(F.col("key") > F.lit(c + "g")).cast("int") for c in cuts]
    shard = sum(beyond, F.lit(0)).cast("int")

    # Slots: rows are numbered within chunks of at most 65,536 rows that the table was written in, so that
    # neither a shard nor a group is ordered by one task; a chunk's offset comes from a row for each chunk.
    placed = rows.withColumns({"shard": shard, "chunk": F.shiftright("row", 16)})
    chunks = placed.groupBy("shard", "chunk").agg(F.count(F.lit(1)).alias("n"))
    offsets = chunks.select("shard", "chunk", (F.sum("n").over(Window.partitionBy("shard").orderBy("chunk")) - F.col("n")).alias("before"))
    inner = F.row_number().over(Window.partitionBy("shard", "chunk").orderBy("row")) - 1
    outputs = {
        "size": F.col("size"),
        "text_crc32": F.col("crc").cast("long"),
        "law": F.lit("bytes"),
        "shard": F.col("shard"),
        "slot": (F.col("before") + inner).cast("long"),
        "grown_shard": F.lit(None).cast("int"),
        "key": F.col("key"),
        "capacity": F.lit(capacity).cast("long"),
    }
    joined = placed.join(offsets, ["shard", "chunk"])
    return joined.select(F.col("id").alias(id_col), *[c.alias(beside(id_col, n)) for n, c in outputs.items()])
