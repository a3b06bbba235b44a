"""Shards against an exhaustive minimax partition."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from reviewloom.llm import sharding


def key(t):
    return sharding.NULL_KEY if t is None else hashlib.sha256(t.encode()).hexdigest()


def best_capacity(sizes, shards):
    def fits(c):
        used, at = 1, 0
        for s in sizes:
            if s > c:
                return False
            if at + s > c:
                used, at = used + 1, 0
            at += s
        return used <= shards

    lo, hi = max(sizes), sum(sizes)
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if fits(mid) else (mid + 1, hi)
    return lo


def check(rows, texts, shards):
    size = lambda t: 1 + len((t or "").encode())
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    groups = defaultdict(int)
    for t in texts:
        groups[key(t)] += size(t)
    loads, slots, of = defaultdict(int), defaultdict(list), {}
    for r in rows:
        t = texts[r.doc_id]
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (size(t), zlib.crc32((t or "").encode()), "bytes", None)
        assert of.setdefault(key(t), r.shard) == r.shard
        loads[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    order = [of[k] for k in sorted(groups)]
    assert order == sorted(order) and max(order) < shards
    assert max(loads.values()) == best_capacity([groups[k] for k in sorted(groups)], shards)


def run(spark, texts, shards):
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in enumerate(texts)], "doc_id long, text string, size int, key string")
    return sharding.assign_shards(df, shards).collect()


@pytest.mark.parametrize("digits", [1, 3])
@pytest.mark.parametrize("shards", [1, 3, 8])
def test_minimax(spark, monkeypatch, digits, shards):
    monkeypatch.setattr(sharding, "DIGITS", digits)
    rng = random.Random(shards)
    texts = ["x" * rng.randint(0, 300) + str(rng.randint(0, 400)) for _ in range(500)] + [None] * 9 + [""] * 7 + ["hot"] * 150 + ["é" * 4000]
    check(run(spark, texts, shards), texts, shards)


def test_few_groups_and_no_rows(spark):
    texts = ["same"] * 40 + ["other"]
    check(run(spark, texts, 8), texts, 8)
    assert run(spark, [], 8) == []


def test_null_ids(spark):
    df = spark.createDataFrame([(None, "a")] * 5, "doc_id long, text string")
    assert sorted(r.slot for r in sharding.assign_shards(df, 2).collect()) == [0, 1, 2, 3, 4]
