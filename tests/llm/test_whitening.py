import math

import numpy as np
import pytest

from reviewloom.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>"


def brute(vectors, most=8):
    """(exact deviations, whitened up to the sign, explained) of plain vectors, all at once."""
    x = np.array([[math.floor(1024 * float(c)) + 100_000 for c in v] for v in vectors], dtype=object)
    n, s = len(x), x.sum(axis=0)
    deviation = [sum((n * v - t) ** 2 for v, t in zip(row, s)) for row in x]
    centred = np.array([[float(v * n - t) / n for v, t in zip(row, s)] for row in x])
    values, vecs = np.linalg.eigh(centred.T @ centred / n)
    values, vecs = values[::-1][:most], vecs[:, ::-1][:, :most]
    return deviation, centred @ vecs / np.sqrt(values), values / np.trace(centred.T @ centred / n)


def held(rows, kept, most=8):
    deviation, whitened, explained = brute([v for _, v in kept], most)
    by = {}
    for r in rows:
        by.setdefault(r["vec_id"], {})[r["component"]] = r
    signs = {}
    for (i, _), d, w in zip(kept, deviation, whitened, strict=True):
        mine = by[i]
        assert sorted(mine) == list(range(1, len(w) + 1))
        for c, r in mine.items():
            assert r["n"] == len(kept) and r["deviation"] == d
            assert abs(abs(r["whitened"]) - abs(w[c - 1])) < 1e-6 * max(1, abs(w[c - 1]))
            if abs(w[c - 1]) > 1e-3:
                signs.setdefault(c, set()).add(np.sign(r["whitened"]) == np.sign(w[c - 1]))
            assert abs(r["explained"] - explained[c - 1]) < 1e-9
            assert 0 <= r["identity_error"] < 1e-8
    assert all(len(s) == 1 for s in signs.values())


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    kept = [(r["vec_id"], r["embedding"]) for r in table if r["embedding"] is not None and all(c is not None and math.isfinite(c) for c in r["embedding"])]
    held(queries.op13_embedding_whitening(spark, sf).collect(), kept)


@pytest.mark.parametrize("parts", [1, 9])
def test_bad_vectors_are_dropped(spark, parts):
    rng = np.random.default_rng(5)
    good = [(i, [float(np.float32(c)) for c in rng.normal(3, 0.2, 12) * np.arange(1, 13)]) for i in range(200)]
    # A third of all rows are one vector.
    good += [(1000 + i, good[0][1]) for i in range(100)]
    bad = [(500, None), (501, [1.0] * 11 + [None]), (502, [float("nan")] * 12), (503, [1.0] * 11 + [float("inf")]), (504, [1e30] * 12), (505, []), (506, [1.0] * 5)]
    got = whitening.whiten(spark.createDataFrame(good + bad, SCHEMA).repartition(parts)).collect()
    held(got, good)


def test_flat_components_and_small_tables(spark):
    line = [(i, [float(i), 2.0 * i, 7.0]) for i in range(6)]
    got = whitening.whiten(spark.createDataFrame(line, SCHEMA)).collect()
    assert {r["component"] for r in got} == {1} and len(got) == 6
    assert got[0]["explained"] == pytest.approx(1) and got[0]["identity_error"] < 1e-9
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 5, [(1, None)]):
        assert whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect() == []


def test_null_ids_repeats_and_names(spark):
    rows = [(None, [0.1, 0.5]), (None, [0.1, 0.5]), (2, [0.7, 0.2]), (3, [0.9, 0.9])]
    df = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("vec_id", "component")
    got = whitening.whiten(df.selectExpr("*", "1 AS n", "2 AS whitened", "'x' AS id", "'y' AS vector"), id_col="component")
    assert got.columns == ["component", "_component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert got.count() == 8 and got.where("component IS NULL").count() == 4


def test_merging_is_exact_in_counts_and_sums_and_close_in_moments():
    rng = np.random.default_rng(1)
    x = (rng.normal(0, 200, (1000, 6)).astype(np.int64)) + 100_000
    whole = whitening.Moments.of(x)
    parts = [whitening.Moments.of(p) for p in np.array_split(x, [1, 2, 400, 777])]
    for order in (parts, parts[::-1]):
        m = order[0]
        for p in order[1:]:
            m = m.merged(p)
        assert m.n == 1000 and m.sums == [int(s) for s in x.sum(axis=0)]
        assert np.abs(m.scatter - whole.scatter).max() < 1e-13 * np.trace(whole.scatter) and np.allclose(m.mean, whole.mean, rtol=1e-11)


def test_large_deviations_stay_exact():
    fitted = whitening.Whitener(3, [2**60, 5], np.eye(2), np.ones(2), np.ones(2))
    assert fitted.deviations(np.array([[2**50, 1]])) == [None]
    assert whitening.Whitener(3, [6, 5], np.eye(2), np.ones(2), np.ones(2)).deviations(np.array([[1, 2]])) == [10]
