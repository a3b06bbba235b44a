"""Promotion as reviews land: the last review entry of a pull request, joined with its raw rows.

Raw rows and review entries are two streams with one key. State holds, for each
key, its raw rows and its last entry; whichever comes later finds the other there. An
entry that is edited is landed again with a higher order, and every raw row of
its key is then given anew, as an update with a version, or withdrawn if the reviewer
has emptied the entry. What :func:`settled` makes of the updates equals what
``operators.label.promote`` gives for the same rows as tables.

State is kept per key and dropped ``ttl`` after its last change, so it is bounded by what is
under review; a key with very many raw rows has them in its state, one element each.
Entries of equal order: the one that is handled last stays. Raw rows without
a key, or without an entry, give no update. The state store has to be RocksDB (:func:`stateful`).
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from reviewloom.operators.label import without_bookkeeping

#: Settings of a session whose streams keep such state. State that expires makes Spark plan batches without rows
#: for ever, so that a run through what is there would never end; with rows is when expired state has to be known.
_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}
#: An update of the raw row number ``raw_no`` of its key; ``proposals`` is null where it is withdrawn.
UPDATE = T.StructType().add("repository", "string").add("pr", "string").add("raw_no", "long").add("version", "long").add("raw", "string").add("proposals", "string")
#: Of a key: its last entry, if any, and its number of raw rows; its raw rows.
_ENTRY, _RAW = T.StructType().add("version", "long").add("proposals", "string").add("n_raws", "long"), T.StructType().add("raw", "string")


@contextmanager
def stateful(spark: SparkSession) -> Iterator[None]:
    """Streams started within keep their state in RocksDB; the session's settings come back after."""
    before = {k: spark.conf.get(k, None) for k in _SETTINGS}
    for k, v in _SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class _Promotion(StatefulProcessor):
    """Rows of a key at a time, as plain rows: a data frame for each key costs more than all the rest.

    A call to the state is a round trip as well, so the number of raw rows is kept beside the entry, and those held are
    read only for an entry that gives them anew. Where some have expired, they are the first ones.
    """

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entry = handle.getValueState("entry", _ENTRY, self.ttl_ms)
        self.raws = handle.getListState("raws", _RAW, self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        fresh, last = [], None
        for row in rows:
            if row.raw is not None:
                fresh.append(row.raw)
            elif last is None or row.version >= last[0]:
                last = (row.version, row.proposals)
        version, proposals, n = self.entry.get() or (None, None, 0)
        edited = last is not None and (version is None or last[0] >= version)
        kept = [r[0] for r in self.raws.get()] if edited and n else []
        if edited:
            version, proposals = last
        if fresh:
            self.raws.appendList([(r,) for r in fresh])
        if edited or fresh:
            self.entry.update((version, proposals, n + len(fresh)))
        if version is None:
            return
        given = None if proposals == "[]" else proposals
        for raw_no, raw in enumerate([*kept, *fresh], n - len(kept)):
            yield Row(repository=key[0], pr=key[1], raw_no=raw_no, version=version, raw=raw, proposals=given)

    def close(self) -> None:
        pass


def promotions(raw: DataFrame, review: DataFrame, order: str = "ord", ttl_ms: int | None = None) -> DataFrame:
    """Updates (see ``UPDATE``) of a stream of raw rows and one of review entries, both with repository and pull_number."""
    pr = F.col("pull_number").cast("string").alias("pr")
    none = F.lit(None).cast("string")
    of_raw = raw.select("repository", pr, F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("raw"), F.lit(0).cast("long").alias("version"), none.alias("proposals"))
    of_review = review.select("repository", pr, none.alias("raw"), F.col(order).cast("long").alias("version"), F.to_json("proposals", {"ignoreNullFields": "false"}).alias("proposals"))
    both = of_raw.unionByName(of_review).where("repository IS NOT NULL AND pr IS NOT NULL")
    mode = "processingTime" if ttl_ms else "none"
    return both.groupBy("repository", "pr").transformWithState(_Promotion(ttl_ms), UPDATE, "Append", mode)


def settled(updates: DataFrame, raw_schema: T.StructType, proposals: T.ArrayType) -> DataFrame:
    """The raw rows with the signals of their last update, as ``promote`` gives them; ``updates`` is a table of all of them."""
    # A raw row is given once for each entry, and versions rise, so the highest is the last.
    last = updates.groupBy("repository", "pr", "raw_no").agg(F.max_by(F.struct("raw", "proposals"), "version").alias("x"))
    rows = last.select(F.from_json("x.raw", raw_schema).alias("raw"), F.from_json("x.proposals", proposals).alias("proposals")).where("proposals IS NOT NULL")
    return rows.select("raw.*", without_bookkeeping(F.col("proposals")).alias("signals"))
