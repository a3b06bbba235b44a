"""Promotion as a stream settles on what promotion of tables gives."""

import json

from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewloom.operators.label import promote
from reviewloom.streaming import promotion

PROPOSAL = T.StructType().add("rule", "string").add("category", "string").add("evidence", "string")
RAW = T.StructType().add("repository", "string").add("pull_number", "long").add("title", "string")
REVIEW = T.StructType().add("repository", "string").add("pull_number", "string").add("ord", "long").add("proposals", T.ArrayType(PROPOSAL))


def entry(pr, ord, *categories, repository="r"):
    return {"repository": repository, "pull_number": str(pr), "ord": ord, "proposals": [{"rule": "x", "category": c, "evidence": "e"} for c in categories]}


def raw(pr, title, repository="r"):
    return {"repository": repository, "pull_number": pr, "title": title}


STEPS = [
    ([raw(1, "a"), raw(1, "a"), raw(2, None), raw(9, "never")], [entry(3, 0, "bug")]),
    ([raw(3, "late")], [entry(1, 1, "bug", "test"), entry(1, 2, "security"), entry(2, 3)]),
    ([raw(1, "more"), raw(4, "x", "s")], [entry(2, 5, "bug"), entry(1, 1, "old"), entry(4, 6, "perf", repository="s"), {"repository": None, "pull_number": "1", "ord": 9, "proposals": []}]),
    ([], [entry(3, 7), entry(1, 8, "docs")]),
]


def test_stream_settles_on_the_batch_result(spark, tmp_path):
    for name in ("raw", "review"):
        (tmp_path / name).mkdir()

    def run():
        streams = [spark.readStream.schema(s).json(str(tmp_path / n)) for n, s in (("raw", RAW), ("review", REVIEW))]
        with promotion.stateful(spark):
            q = promotion.promotions(*streams, ttl_ms=3_600_000).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
            try:
                assert q.awaitTermination(100) and q.exception() is None
            finally:
                q.stop()

    for i, (raws, reviews) in enumerate(STEPS):
        # Each step is a run of its own, so state comes back from the checkpoint.
        for name, rows in (("raw", raws), ("review", reviews)):
            (tmp_path / name / f"{i}.json").write_text("".join(json.dumps(r) + "\n" for r in rows))
        run()
        updates = spark.read.parquet(str(tmp_path / "out"))
        got = promotion.settled(updates, RAW, T.ArrayType(PROPOSAL)).collect()
        tables = [spark.read.schema(s).json(str(tmp_path / n)) for n, s in (("raw", RAW), ("review", REVIEW))]
        want = promote(*tables).select(*[F.col(c) for c in (*RAW.names, "signals")]).collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, map(tuple, want)))
    assert {r.title for r in got} == {"a", "more", "x", None} and len(got) == 5


def test_a_fresh_key_takes_three_calls_to_the_state():
    calls, held = [], {}

    class State:
        def __init__(self, name):
            self.name = name

        def __getattr__(self, what):
            def call(*value):
                calls.append((self.name, what))
                if what == "update":
                    held[self.name] = value[0]
                if what == "appendList":
                    held[self.name] = held.get(self.name, []) + value[0]
                return iter(held.get(self.name, [])) if (self.name, what) == ("raws", "get") else held.get(self.name)

            return call

    class Handle:
        def getValueState(self, name, *_):
            return State(name)

        getListState = getValueState

    p = promotion._Promotion(None)
    p.init(Handle())
    row = lambda raw=None, version=0, proposals=None: Row(repository="r", pr="1", raw=raw, version=version, proposals=proposals)
    given = lambda *rows: [(r.raw_no, r.version, r.raw, r.proposals) for r in p.handleInputRows(("r", "1"), iter(rows), None)]
    assert given(row("a"), row(None, 1, "p")) == [(0, 1, "a", "p")]
    assert calls == [("entry", "get"), ("raws", "appendList"), ("entry", "update")]
    assert given(row("b")) == [(1, 1, "b", "p")] and given(row(None, 0, "old")) == []
    assert given(row(None, 2, "[]")) == [(0, 2, "a", None), (1, 2, "b", None)]
    held["raws"] = held["raws"][1:]
    assert given(row(None, 3, "q"), row("c")) == [(1, 3, "b", "q"), (2, 3, "c", "q")]
