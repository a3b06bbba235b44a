"""A set of JSONL parts that is published as a whole, as a Python DataSource.

Tasks write their parts under names of their own, beside those that are there.
What a reader sees is only what ``manifest.json`` lists, and that file is replaced in
one step, once all tasks have ended; so a job that fails, a task that is run twice or an
executor that is lost leaves the set as it was. The manifest has each part's
records, bytes and SHA-256, which a reader checks. The parts of a job are in a folder of
its own, which is removed if the job fails; what a task still writes after that stays there unlisted.

    register(spark); df.write.format("record_set").mode("append").save("/path")

The folder has to be a mount that all executors see. Nulls are left out of
records; an empty table publishes a set without parts. Modes are append and overwrite.
"""

from __future__ import annotations

import contextlib
import datetime
import hashlib
import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

MANIFEST, PARTS = "manifest.json", "parts"


@dataclass
class Part(WriterCommitMessage):
    name: str
    records: int
    bytes: int
    sha256: str


def _plain(value: object) -> object:
    """Without the nulls of records; times as ISO text."""
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items() if v is not None}
    if isinstance(value, list):
        return [_plain(v) for v in value]
    return value.isoformat() if isinstance(value, (datetime.date, datetime.datetime)) else value


def published(folder: str) -> list[Part]:
    """The parts of the set in a folder, none where there is no manifest."""
    try:
        with open(os.path.join(folder, MANIFEST), encoding="utf-8") as f:
            return [Part(**p) for p in json.load(f)["parts"]]
    except FileNotFoundError:
        return []


class RecordSetWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite, self.job = folder, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        os.makedirs(os.path.join(self.folder, PARTS, self.job), exist_ok=True)
        part = Part(f"{self.job}/{uuid.uuid4().hex}.jsonl", 0, 0, "")
        digest, path = hashlib.sha256(), os.path.join(self.folder, PARTS, part.name)
        try:
            with open(path, "wb") as f:
                for batch in iterator:
                    for record in batch.to_pylist():
                        line = (json.dumps(_plain(record), ensure_ascii=False) + "\n").encode()
                        digest.update(line)
                        f.write(line)
                        part.records += 1
                        part.bytes += len(line)
        except BaseException:
            os.remove(path)
            raise
        part.sha256 = digest.hexdigest()
        return part

    def commit(self, messages: list[Part | None]) -> None:
        before = published(self.folder)
        made = sorted((m for m in messages if m is not None and m.records), key=lambda m: m.name)
        parts = made if self.overwrite else before + made
        os.makedirs(self.folder, exist_ok=True)
        draft = os.path.join(self.folder, f".{uuid.uuid4().hex}")
        with open(draft, "w", encoding="utf-8") as f:
            json.dump({"records": sum(p.records for p in parts), "parts": [vars(p) for p in parts]}, f, indent=2)
            f.write("\n")
            f.flush()
            os.fsync(f.fileno())
        os.replace(draft, os.path.join(self.folder, MANIFEST))
        # Parts that were empty or of tasks run twice, and those that are replaced, are listed no more.
        listed = {p.name for p in parts}
        mine = self._own()
        self._remove((mine | {p.name for p in before}) - listed)

    def abort(self, messages: list[Part | None]) -> None:
        self._remove(self._own())

    def _own(self) -> set[str]:
        """The parts that tasks of this job have written, reported or not."""
        folder = os.path.join(self.folder, PARTS, self.job)
        return {f"{self.job}/{n}" for n in os.listdir(folder)} if os.path.isdir(folder) else set()

    def _remove(self, names: set[str]) -> None:
        for name in names:
            if os.path.exists(path := os.path.join(self.folder, PARTS, name)):
                os.remove(path)
        for job in {name.partition("/")[0] for name in names}:
            with contextlib.suppress(OSError):  # parts are left in it
                os.rmdir(os.path.join(self.folder, PARTS, job))


class _PartToRead(InputPartition):
    def __init__(self, part: Part | None):
        self.part = part


class RecordSetReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[InputPartition]:
        return [_PartToRead(p) for p in published(self.folder)] or [_PartToRead(None)]

    def read(self, partition: _PartToRead) -> Iterator[tuple]:
        if (part := partition.part) is None:
            return
        digest = hashlib.sha256()
        with open(os.path.join(self.folder, PARTS, part.name), "rb") as f:
            for line in f:
                digest.update(line)
                yield part.name, line.decode().rstrip("\n")
        if digest.hexdigest() != part.sha256:
            raise ValueError(f"part {part.name} is not what its manifest says")


class RecordSet(DataSource):
    @classmethod
    def name(cls) -> str:
        return "record_set"

    def schema(self) -> str:
        return "part string, record string"

    def _folder(self) -> str:
        return self.options["path"].removeprefix("file://")

    def reader(self, schema) -> RecordSetReader:
        return RecordSetReader(self._folder())

    def writer(self, schema, overwrite: bool) -> RecordSetWriter:
        return RecordSetWriter(self._folder(), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RecordSet)
