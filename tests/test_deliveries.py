"""A delivery against kept checksums: filter, exact check, plan."""

import random

from reviewloom.operators import deliveries as d


def rows(spark, values):
    return spark.createDataFrame([(v, i, "b") for i, v in enumerate(values)], "checksum string, bucket int, `bits.x` string")


def test_deliveries_against_sets(spark, tmp_path):
    rng = random.Random(4)
    name = "kept_in_test"
    kept_set: set[str] = set()
    kept_filter = d.checksum_filter(rows(spark, []), buckets=3)
    kept = d.keep(rows(spark, []), name, f"file://{tmp_path}/kept", 4)
    try:
        for _ in range(3):
            values = [rng.choice([None, "", "x" * 100_000, *[f"{n:x}" for n in range(3000)]]) for _ in range(1500)]
            delivery = rows(spark, values)
            judged = d.probably_kept(delivery, kept_filter, buckets=3).collect()
            # Nothing kept is ever called new.
            assert all(r.probable for r in judged if r.checksum in kept_set) and len(judged) == sum(v is not None for v in values)
            fresh = d.new_records(delivery, kept, kept_filter, buckets=3)
            got = fresh.collect()
            assert fresh.columns == delivery.columns and all(values[r.bucket] == r.checksum for r in got)
            assert sorted(r.checksum for r in got) == sorted({v for v in values if v is not None} - kept_set)
            kept_set |= {r.checksum for r in got}
            known = spark.createDataFrame([(r.checksum,) for r in got], "checksum string")
            kept_filter = spark.createDataFrame(d.merged_filters(kept_filter, d.checksum_filter(known, buckets=3)).collect(), "bucket int, bits binary")
            kept = d.keep(known, name, f"file://{tmp_path}/kept", 4, "append")
        assert d.new_records(rows(spark, []), kept, kept_filter, buckets=3).collect() == []
        # Few of those that are not kept are doubtful, and the kept side is not moved.
        others = d.probably_kept(rows(spark, [f"new {n}" for n in range(5000)]), kept_filter, buckets=3)
        assert others.where("probable").count() < 100
        plan = d.new_records(rows(spark, ["a"]), kept, kept_filter, buckets=3)._jdf.queryExecution().executedPlan().toString()
        join = plan[plan.index("SortMergeJoin") :]
        kept_side = join[join.rindex("kept_in_test") - 400 : join.rindex("kept_in_test")]
        assert "Bucketed: true" in join and "Exchange" not in kept_side.splitlines()[-1]
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
