"""Static analysis of source files: (path, content) to findings.

Each file is parsed once for all rules of its language, in Arrow batches; what a
rule says about itself is a small dimension joined afterwards. Files of other
languages are filtered out before they reach Python.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.analyzers.python_rules import analyze_python
from reviewloom.analyzers.script_rules import analyze_script
from reviewloom.functions.vocabulary import rule_dimension
from reviewloom.operators.ingest import language_of

Analyzer = Callable[[str], tuple[list[tuple[str, int, int, int, int]], str]]

#: Analyzers by language; each gives (rule, start line and column, end line and column) rows and a confidence.
ANALYZERS: dict[str, tuple[Analyzer, ...]] = {"python": (analyze_python,), "javascript": (analyze_script,), "typescript": (analyze_script,)}

_FIELDS = "path string, rule_id string, start_line int, start_column int, end_line int, end_column int, confidence string"


def register_rule(language: str, analyzer: Analyzer) -> None:
    """Adds an analyzer of one's own for a language; its rules may be missing from the dimension."""
    ANALYZERS[language] = (*ANALYZERS.get(language, ()), analyzer)


def find(files: DataFrame, analyzers: dict[str, tuple[Analyzer, ...]] | None = None) -> DataFrame:
    """(path, rule_id, start_line, start_column, end_line, end_column, confidence), a row for each finding.

    ``files`` is (path, content[, language]); a null content has no finding.
    """
    chosen = dict(analyzers or ANALYZERS)
    if "language" not in files.columns:
        files = files.withColumn("language", language_of(F.col("path")))
    rows = files.where(F.col("language").isin(*chosen) & F.col("content").isNotNull()).select("path", "language", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for path, language, content in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                for analyzer in chosen[language]:
                    found, confidence = analyzer(content)
                    out += [(path, *f, confidence) for f in found]
            cols = list(zip(*out, strict=True)) or [[]] * 7
            kinds = [pa.string(), pa.string(), *[pa.int32()] * 4, pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["path", "rule_id", "start_line", "start_column", "end_line", "end_column", "confidence"])

    return rows.mapInArrow(run, _FIELDS)


def finding_id(rule: Column, path: Column, line: Column, column: Column) -> Column:
    """Not unique: nested expressions may start at the same place."""
    return F.concat_ws(":", rule, path, line.cast("string"), column.cast("string"))


def findings(files: DataFrame) -> DataFrame:
    """Findings with their rule's metadata (a fixed table of a few rows, broadcast) and id."""
    rules = rule_dimension(files.sparkSession)
    return find(files).join(F.broadcast(rules), "rule_id", "left").withColumn("id", finding_id(F.col("rule_id"), F.col("path"), F.col("start_line"), F.col("start_column")))


def by_file(found: DataFrame) -> DataFrame:
    """(path, findings): the findings of each file with a location, in order of place."""
    cell = F.struct("start_line", "start_column", "rule_id", "end_line", "end_column", "confidence")
    return found.where("start_line IS NOT NULL").groupBy("path").agg(F.sort_array(F.collect_list(cell)).alias("findings"))


def records_by_file(found: DataFrame, in_order: bool = False) -> DataFrame:
    """(path, records): the findings of each file, from :func:`findings`, as indented JSON, in order of place.

    A record has id, ruleId, category, severity, confidence, location, relatedLocations,
    evidence and tags; what the dimension does not know is left out, and rules say
    nothing in prose. ``in_order`` sorts the files by path, for a report that is read from the top.
    """
    names = ("path", "start_line", "start_column", "end_line", "end_column")
    place = F.struct(*[F.col(c).alias(n) for c, n in zip(names, ("path", "startLine", "startColumn", "endLine", "endColumn"), strict=True)])
    proof = F.when(F.col("kind").isNotNull(), F.array(F.struct(F.col("kind").alias("kind"), F.array(place).alias("locations"))))
    record = F.struct("id", F.col("rule_id").alias("ruleId"), "category", "severity", "confidence", place.alias("location"), F.array().cast("array<string>").alias("relatedLocations"), proof.alias("evidence"), "tags")
    order = F.struct("start_line", "start_column", "rule_id", "end_line", "end_column", F.to_json(record).alias("record"))
    one = found.where("start_line IS NOT NULL").groupBy("path").agg(F.transform(F.sort_array(F.collect_list(order)), lambda x: x["record"]).alias("records"))
    out = indented(one.select("path", F.concat(F.lit("["), F.array_join("records", ","), F.lit("]")).alias("records")), "records")
    return out.orderBy("path") if in_order else out


def indented(df: DataFrame, column: str) -> DataFrame:
    """A column of JSON texts with two blanks a level and one after each colon."""

    @F.pandas_udf("string")
    def pretty(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else json.dumps(json.loads(t), indent=2, ensure_ascii=False))

    return df.withColumn(column, pretty(F.col(column)))


def register_table_function(spark: SparkSession, name: str = "analyze_source") -> None:
    """A SQL table function ``analyze_source(language, content)``.

    Filters on the files belong in the subquery that feeds the lateral join;
    outside of it they would run after the parse.
    """

    class Analyze:
        def eval(self, language: str, content: str):
            for analyzer in ANALYZERS.get(language, ()) if content is not None else ():
                found, confidence = analyzer(content)
                for f in found:
                    yield (*f, confidence)

    spark.udtf.register(name, F.udtf(Analyze, returnType=_FIELDS.replace("path string, ", "")))
