"""Gapless row numbers by a distributed sort.

Rows are dealt by ranges of their order and sorted in place; within a partition
the number is the row's place in it, and what is added are the sizes of the
partitions before, a sum over partitions instead of over rows. No window and no
task ever holds more than a range of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.sources.scratch import written

#: monotonically_increasing_id() has the partition above this bit and the row's place in it below.
_PART_BIT = 33
#: Up to so many runs are broadcast, a few megabytes; beyond, they are joined by a shuffle.
_FEW_RUNS = 100_000


def numbered(df: DataFrame, order: Sequence[Column], by: Sequence[str] = (), parts: int | None = None) -> DataFrame:
    """(row, position): every row as a struct, and its place from 0 among the rows of equal ``by``, ascending in ``order``, nulls first.

    ``by``: names of columns, nulls equal; none numbers the whole table. Ties of ``order`` are
    broken by the place where the rows were read; equal rows differ in nothing else, so a
    third of all rows may be equal. ``parts``: ranges to deal rows into, else as Spark
    chooses. The sorted rows are written to the shared folder once; ``df`` is read twice,
    for its ranges and for its rows. An empty table gives an empty one.
    """
    keys = [F.col(f"`{c}`").alias(f"by{i}") for i, c in enumerate(by)]
    orders = [c.alias(f"order{i}") for i, c in enumerate(order)]
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *keys, *orders, F.monotonically_increasing_id().alias("tie"))
    names = [c for c in rows.columns if c != "row"]
    dealt = rows.repartitionByRange(parts, *names) if parts else rows.repartitionByRange(*names)
    groups = [f"by{i}" for i in range(len(by))]
    placed = written(dealt.sortWithinPartitions(*names).select("row", *groups, F.monotonically_increasing_id().alias("at")), "numbered")
    part = F.shiftright("at", _PART_BIT)
    runs = placed.groupBy(part.alias("part"), *groups).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    if by:
        # A group has a run for each partition it reaches into, so none is larger than the number of partitions.
        before = F.sum("n").over(Window.partitionBy(*groups).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
        runs = written(runs.select("part", *groups, "first", F.coalesce(before, F.lit(0)).alias("before")), "runs")
        few = runs.count() <= _FEW_RUNS
    else:
        # One number a partition.
        sizes, done = sorted(runs.select("part", "first", "n").collect()), 0
        cells = []
        for p, first, n in sizes:
            cells.append((p, first, done))
            done += n
        runs, few = df.sparkSession.createDataFrame(cells, "part long, first long, before long"), True
    runs = runs.select(F.col("part").alias("of_part"), *[F.col(g).alias(f"of_{g}") for g in groups], "first", "before")
    same = part == F.col("of_part")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"of_{g}"))
    joined = placed.join(F.broadcast(runs) if few else runs.hint("shuffle_hash"), same)
    return joined.select("row", (F.col("at") - F.col("first") + F.col("before")).alias("position"))
