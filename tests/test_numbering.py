import random

import pytest
from pyspark.sql import functions as F

from reviewloom.operators.numbering import numbered


@pytest.mark.parametrize("parts,ranges", [(1, None), (3, 5), (8, 40)])
def test_positions_are_gapless_in_order(spark, parts, ranges):
    rng = random.Random(7)
    rows = [(rng.choice(["a", "b", None, "hot"]), rng.choice([None, *range(50)]), i) for i in range(400)]
    rows += [("hot", 3, 5)] * 200
    df = spark.createDataFrame(rows, "g string, v long, row long").repartition(parts)
    for by in ([], ["g"]):
        got = numbered(df, [F.col("v")], by, ranges).select("row.*", "position").collect()
        groups = {}
        for r in got:
            groups.setdefault(r["g"] if by else 0, []).append((r["position"], r["v"]))
        assert sorted(tuple(r)[:3] for r in got) == sorted(rows) if all(None not in r for r in rows) else len(got) == len(rows)
        for cells in groups.values():
            cells.sort()
            assert [p for p, _ in cells] == list(range(len(cells)))
            values = [(v is not None, v or 0) for _, v in cells]
            assert values == sorted(values)


def test_empty_and_clashing_names(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "by0 long, `order.0` long, tie long, at long")
    assert [tuple(r) for r in numbered(df, [F.col("tie")], ["order.0"]).select("row.*", "position").collect()] == [(1, 2, 3, 4, 0)]
    assert numbered(df.where("by0 > 1"), [F.col("tie")]).collect() == []
    assert numbered(df.where("by0 > 1"), [F.col("tie")], ["at"]).collect() == []
