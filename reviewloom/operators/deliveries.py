"""Exact dedup of a new delivery against the checksums that are kept already.

A filter of bitmaps over the kept checksums is stored beside them: ``buckets`` rows
of 32,768 bits, each checksum setting ``PROBES`` bits of its bucket. A row of a delivery
whose bits are not all set is new for certain; only the others, all that are kept
and a few that are not, meet the kept checksums, which are stored in buckets by
checksum, so they do not move. Filters of deliveries are merged by bits.

The filter has a fixed size, 17 MB at ``BUCKETS``, so it may be broadcast; it is as good as no filter
once far more than ten million checksums are in it, and then all rows go the exact way, with the same result.

Nulls and odd input: rows without a checksum are left out. Repeated rows, and ties, of a
checksum: one of them stays, any one. Empty deliveries and empty kept sets are sets like
others. All columns of a delivery are passed on, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a filter at most, bits of a row as Spark's bitmaps have them, and bits a checksum sets.
BUCKETS, BITS, PROBES = 4096, 32_768, 4


def _bucket(checksum: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(checksum), F.lit(buckets)).cast("int")


def _positions(checksum: Column) -> list[Column]:
    return [F.pmod(F.xxhash64(checksum, F.lit(i)), F.lit(BITS)).cast("long") for i in range(PROBES)]


def checksum_filter(df: DataFrame, checksum: str = "checksum", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, bits) over the checksums of ``df``; they are shuffled as hashes, before any bitmap is made."""
    if not 0 < buckets <= BUCKETS:
        raise ValueError(f"buckets must be from 1 to {BUCKETS}")
    c = F.col(checksum)
    hashed = df.where(c.isNotNull()).select(_bucket(c, buckets).alias("bucket"), F.array(*_positions(c)).alias("at"))
    placed = hashed.repartition("bucket").select("bucket", F.explode("at").alias("at"))
    return placed.groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("bits"))


def merged_filters(one: DataFrame, other: DataFrame) -> DataFrame:
    """The filter of two sets together; both with the same number of buckets."""
    return one.unionByName(other).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def probably_kept(delivery: DataFrame, kept_filter: DataFrame, checksum: str = "checksum", buckets: int = BUCKETS) -> DataFrame:
    """(row, checksum, probable): false for rows that are new for certain."""
    c = F.col(f"`{checksum}`")
    rows = delivery.where(c.isNotNull()).select(F.struct(*[F.col(f"`{x}`") for x in delivery.columns]).alias("row"), c.alias("checksum"))
    met = rows.withColumn("bucket", _bucket(F.col("checksum"), buckets)).join(F.broadcast(kept_filter), "bucket", "left")
    test = F.lit(True)
    for p in _positions(F.col("checksum")):
        byte = F.conv(F.hex(F.substring("bits", (p / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        test = test & (F.getbit(byte, (p % 8).cast("int")) == 1)
    return met.select("row", "checksum", F.coalesce(F.col("bits").isNotNull() & test, F.lit(False)).alias("probable"))


def new_records(delivery: DataFrame, kept: DataFrame, kept_filter: DataFrame, checksum: str = "checksum", buckets: int = BUCKETS) -> DataFrame:
    """The rows of ``delivery`` with checksums that ``kept`` (checksum, each once) has not, one for each."""
    judged = probably_kept(delivery, kept_filter, checksum, buckets)
    doubtful = judged.where("probable").dropDuplicates(["checksum"]).join(kept.select("checksum").hint("merge"), "checksum", "left_anti")
    return judged.where("NOT probable").dropDuplicates(["checksum"]).unionByName(doubtful).select("row.*")


def keep(df: DataFrame, name: str, path: str, buckets: int = 64, mode: str = "errorifexists") -> DataFrame:
    """The checksums as table ``name`` at ``path``, bucketed and sorted by checksum; ``mode`` append adds a delivery's new ones."""
    # A task has the rows of its own buckets only, so there is a file a bucket, not one for each task and bucket.
    df.select("checksum").repartition(buckets, "checksum").write.mode(mode).option("path", path).bucketBy(buckets, "checksum").sortBy("checksum").saveAsTable(name)
    return df.sparkSession.table(name)
