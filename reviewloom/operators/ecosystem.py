"""Technologies of package manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.functions.vocabulary import TECHNOLOGIES, literal_rows


def merged_dependencies(prod: Column, dev: Column) -> Column:
    """All dependencies; dev versions override, a name keeps its first place."""
    none = F.create_map().cast("map<string,string>")
    prod, dev = F.coalesce(prod, none), F.coalesce(dev, none)
    own = F.transform_values(prod, lambda k, v: F.when(F.map_contains_key(dev, k), F.try_element_at(dev, k)).otherwise(v))
    return F.map_concat(own, F.map_filter(dev, lambda k, _: ~F.map_contains_key(prod, k)))


def is_typescript(dependencies: Column) -> Column:
    return F.map_contains_key(dependencies, F.lit("typescript"))


def detect(manifests: DataFrame, key: str) -> DataFrame:
    """(key, technology, confidence, evidence): evidence in the order of the dependencies.

    The lookup is a fixed table of a few rows, which Spark broadcasts.
    """
    spark = manifests.sparkSession
    known = literal_rows(spark, ("package", "technology"), TECHNOLOGIES)
    names = manifests.select(key, F.posexplode(F.map_keys("dependencies")).alias("pos", "package"))
    hits = names.join(F.broadcast(known), "package")
    return hits.groupBy(key, "technology").agg(
        F.lit("definite").alias("confidence"),
        F.min("pos").alias("first_pos"),
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "package"))), lambda x: x["package"]).alias("evidence"),
    )


def engine_context(found: DataFrame, key: str, runtime: Column | None = None) -> DataFrame:
    """(key, context): what the analyzers get of technologies from :func:`detect`, as JSON without a null runtime.

    A technology has its id, confidence and evidence, in the order of its first
    dependency; its evidence is a manifest's dependency.
    """
    proof = F.transform("evidence", lambda p: F.struct(F.lit("manifest").alias("kind"), F.lit("package.json").alias("source"), F.concat(F.lit("dependency: "), p).alias("detail")))
    cell = F.struct(F.col("first_pos").alias("p"), F.struct(F.col("technology").alias("id"), "confidence", proof.alias("evidence")).alias("t"))
    one = found.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(cell)), lambda x: x["t"]).alias("technologies"))
    none = F.lit(None).cast("string") if runtime is None else runtime
    return one.select(key, F.to_json(F.struct(none.alias("runtime"), "technologies"), {"ignoreNullFields": "true"}).alias("context"))
