import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from reviewloom.llm import merkle, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def grow(nodes):
    """Root of a list of digests and, for each, its siblings level by level."""
    at, beside, level = list(range(len(nodes))), [[] for _ in nodes], list(nodes)
    while len(level) > 1:
        runs = [level[i : i + 16] for i in range(0, len(level), 16)]
        for k, i in enumerate(at):
            run = runs[i // 16]
            beside[k].append((i % 16, run))
            at[k] = i // 16
        level = [sha(*r) for r in runs]
    return level[0], beside


def brute(rows):
    """Rows as (doc_id, source, lang, n_chars, text)."""
    first = lambda v: (v is not None, v if v is not None else 0)
    trees = {}
    for r in rows:
        trees.setdefault(r[1], []).append(r)
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    made = {}
    for s in order:
        mine = sorted(trees[s], key=lambda r: (first(r[0]), leaf_of(r)))
        made[s] = (mine, *grow([leaf_of(r) for r in mine]))
    root, tops = grow([made[s][1] for s in order])
    out = []
    for s, top in zip(order, tops, strict=True):
        mine, subroot, paths = made[s]
        for r, path in zip(mine, paths, strict=True):
            given = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                given = (*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]))
            fold, others = leaf_of(given), []
            for slot, run in path + top:
                others += run[:slot] + run[slot + 1 :]
                fold = sha(*run[:slot], fold, *run[slot + 1 :])
            out.append((r[0], leaf_of(r), subroot, root, sha(*others), fold, fold == root))
    return out


def same(spark, rows, got):
    want = brute(rows)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(r[0], r[4], r[2], r[1], r[3]) for r in rows], SCHEMA).repartition(parts)


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    same(spark, rows, queries.op11_merkle_manifest(spark, sf))


@pytest.mark.parametrize("parts", [1, 7])
def test_many_levels_and_sources(spark, parts):
    hot = [(i, "hot", "en", 3, f"Text {i}") for i in range(700)]
    few = [(i, f"s{i}", None, None, "Ab") for i in range(20)]
    runs = [(i, "Z", "de", 1, "x") for i in range(17)] + [(i, "z", "de", 1, "X") for i in range(16)]
    rows = hot + few + runs
    same(spark, rows, merkle.audit(frame(spark, rows, parts)))


def test_nulls_ties_and_repeats(spark):
    rows = [(None, None, None, None, None), (None, None, None, None, ""), (1, "", "en", 0, ""), (1, "", "en", 0, None), (10, "é", "fr", 2, "É A")]
    rows += [(5, "same", "en", 4, "AAAA")] * 40 + [(None, "same", "en", 4, "AAAA")] * 20
    rows += [(7, "long", "en", 1, "Wort " * 200_000)]
    same(spark, rows, merkle.audit(frame(spark, rows)))


def test_one_row_and_none(spark):
    rows = [(10, "a", "en", 1, "Q")]
    same(spark, rows, merkle.audit(frame(spark, rows)))
    assert merkle.audit(spark.createDataFrame([], SCHEMA)).collect() == []


def test_other_columns_and_clashing_names(spark):
    rows = [(i, "a", "en", 1, "Q") for i in range(3)]
    plain = merkle.audit(frame(spark, rows)).collect()
    more = frame(spark, rows).select("*", F.lit(1).alias("leaf"), F.lit(2).alias("tree"), F.lit("x").alias("row"), F.lit("y").alias("by0"))
    assert sorted(merkle.audit(more).collect()) == sorted(plain)
    renamed = frame(spark, rows).withColumnRenamed("doc_id", "root")
    got = merkle.audit(renamed, columns=("root", "source", "lang", "n_chars", "text"), id_col="root")
    assert got.columns[:4] == ["root", "leaf", "subroot", "_root"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain))


def test_proof_tells_what_was_changed(spark):
    rows = [(i, "abc"[i % 3], "en", 1, f"Doc {i}") for i in range(100)]
    made = merkle.manifest(frame(spark, rows), ("doc_id", "text"))
    forged = merkle.folded(F.col("steps"), F.lit("0" * 64))
    got = made.select((merkle.folded(F.col("steps"), F.col("leaf")) == F.col("root")).alias("good"), (forged == F.col("root")).alias("bad")).distinct().collect()
    assert [tuple(r) for r in got] == [(True, False)]
