"""Helpers shared by the training-data operators: tables, the shared folder, ids."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.sources.scratch import delete, shared_dir, tables_made, written  # noqa: F401 - the operators' way to them


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_written(spark: SparkSession, df: DataFrame) -> None:
    """Remove the files behind a table from :func:`written`, once nothing reads it any more."""
    for f in {p.rpartition("/")[0] for p in df.inputFiles()}:
        delete(spark, f)


def filter_in_arrow(df: DataFrame, keep: Callable[[pa.RecordBatch], pa.Array], rows: int | None = None) -> DataFrame:
    """The rows of ``df``, whatever its columns are named, for which ``keep`` of their batch is true.

    ``rows``: hand out at most so many at a time.
    """
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, rows or max(whole.num_rows, 1)):
                b = whole.slice(start, rows)
                yield pa.RecordBatch.from_arrays(b.filter(keep(b)).columns, names)

    # Names with a dot can't be resolved by mapInArrow itself.
    return df.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(run, df.schema)


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def beside(id_col: str, name: str) -> str:
    """An output's name, with an underscore before it if the id column has it already."""
    return f"_{name}" if name.lower() == id_col.lower() else name


#: A key is hot if it has more than one in HOT_SHARE of all rows, so there are fewer than HOT_SHARE hot keys.
HOT_SHARE = 10_000


def hot_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", counts: tuple[DataFrame, str] | None = None) -> DataFrame:
    """Joins ``left``, whose ``key`` may be skewed, with ``right``, which has each key once.

    Hot keys, fewer than ``HOT_SHARE`` by their definition, are broadcast with
    their rows of ``right``; the others are joined by a shuffle, whatever the size
    of ``right`` is estimated at. ``left`` should be a written table, as it is read
    for the count too; ``counts`` is a table of its keys and the name of their
    number of rows, where that is known. ``how``: inner or left.
    """
    spark = left.sparkSession
    table, n = counts or (left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")), "n")
    total = (table.agg(F.sum(n)).first()[0] or 0) if counts else left.count()
    hot = [r[0] for r in table.where(F.col(n) > max(total // HOT_SHARE, 20)).select(key).collect()]
    right = right.hint("shuffle_hash")
    if not hot:
        return left.join(right, key, how)
    keys = F.broadcast(spark.createDataFrame([(k,) for k in hot], f"{key} {left.schema[key].dataType.simpleString()}"))
    picked = F.broadcast(right.join(keys, key, "left_semi"))
    some = left.join(keys, key, "left_semi").join(picked, key, how)
    rest = left.join(keys, key, "left_anti").join(right, key, how)
    return some.unionByName(rest)


#: Bytes, by count, up to which a side that is joined by skewed keys is broadcast.
SMALL_BYTES = 32 << 20


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], size: int, spread: list[str], how: str = "inner", salts: int = 32) -> DataFrame:
    """Joins ``left``, any of whose ``keys`` may be hot, with ``right``, which has each of them once.

    ``size`` is a bound on the bytes of ``right``, from counts. Up to ``SMALL_BYTES``
    it is broadcast and ``left`` stays where it is. Beyond, ``left`` is salted by a
    hash of its columns ``spread``, ``right`` has a copy for each salt, and both are
    shuffled and sorted, so either may spill and neither is ever broadcast.
    ``how``: inner or left.
    """
    if size <= SMALL_BYTES:
        return left.join(F.broadcast(right), keys, how)
    salted = left.withColumn("salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    copies = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies.hint("merge"), [*keys, "salt"], how).drop("salt")
