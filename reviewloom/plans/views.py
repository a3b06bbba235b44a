"""Deterministic views of the driver's tables that the queries run on.

The driver's tables hold neither pull requests nor source code; each view exists
as a DataFrame and as DuckDB SQL (``SQL``, a chain of CTEs by name).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewloom.functions.vocabulary import KEYWORD_FAMILIES
from reviewloom.sources.tables import table

#: Families over syllables of the synthetic prose, so that keyword queries have many hits.
SYLLABLE_FAMILIES = (("motion", "high", ("tion ", "the a", "une ")), ("being", "low", ("erich", "est", "los ")))
SPDX = ("MIT", "Apache-2.0", "BSD-2-Clause", "GPL-3.0", "NOASSERTION", None, "")
PACKAGES = ("express", "@nestjs/core", "left-pad", "prisma", "@prisma/client", "typescript", "lodash", "knex")
EXTENSIONS = (("en", ".ts"), ("fr", ".js"), ("de", ".py"), ("es", ".md"))


def pulls(spark, sf):
    """Conversations as pull requests: the first turn is the title, later turns are comments."""
    turn = F.struct("turn", F.col("role").alias("path"), F.col("text").alias("body"))
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    spdx = F.get(F.array(*[F.lit(s).cast("string") for s in SPDX]), (F.col("conv_id") % len(SPDX)).cast("int"))
    return rows.select(
        F.concat(F.lit("org/r"), (F.col("conv_id") % 10).cast("string")).alias("repository"),
        F.col("conv_id").alias("pull_number"),
        F.concat(F.lit("https://host.example/"), F.col("conv_id").cast("string")).alias("source_url"),
        F.element_at("turns", 1)["body"].alias("title"),
        F.transform(F.slice("turns", F.lit(2), F.size("turns")), lambda t: F.struct(F.when(t["path"] != "user", t["path"]).alias("path"), t["body"].alias("body"))).alias("comments"),
        spdx.alias("spdx"),
    )


def files(spark, sf):
    """Documents as changed files; the old side is missing for every seventh."""
    ext = F.lit(".txt")
    for lang, e in EXTENSIONS:
        ext = F.when(F.col("lang") == lang, e).otherwise(ext)
    return table(spark, sf, "documents").select(
        "doc_id",
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), ext).alias("path"),
        F.when(F.col("doc_id") % 7 != 0, F.col("lang")).alias("before"),
        F.col("text").alias("after"),
        F.get(F.array(*map(F.lit, ("added", "removed", "changed", "renamed", "modified"))), (F.col("doc_id") % 5).cast("int")).alias("status"),
    )


#: Licence lines of the corpus.
LICENSE_LINES = (("Apache License, Version 2.0", "Apache-2.0"), ("MIT License", "MIT"), ("GNU General Public License, version 3", "GPL-3.0"), ("CC BY-NC 4.0", "CC-BY-NC-4.0"))


def licensed(spark, sf):
    spdx = F.lit(None).cast("string")
    for needle, name in reversed(LICENSE_LINES):
        spdx = F.when(F.contains("text", F.lit(needle)), name).otherwise(spdx)
    return table(spark, sf, "documents").select("doc_id", "source", spdx.alias("spdx"))


def predictions(spark, sf):
    """Labelled documents as expected and generated findings; no text is generated for short ones."""
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    both = table(spark, sf, "labels").where("quality IS NOT NULL AND toxic IS NOT NULL").join(docs, "doc_id")
    expected = F.when(F.col("toxic") == 1, "security").when(F.col("quality") == 0, "bug").otherwise("testing")
    guess = F.get(F.array(*map(F.lit, ("security", "bug", "testing", "style", ""))), (F.col("n_chars") % 5).cast("int"))
    text = F.concat(F.lit("noise\nCategory : first\n category: "), guess, F.lit(" \nseverity:high\nSummary: a: b\nsummary:"), F.col("n_chars").cast("string"))
    return both.select("doc_id", expected.alias("expected"), F.when(F.col("n_chars") >= 600, text).alias("generated"))


def _case(column, pairs, default):
    return "CASE " + " ".join(f"WHEN {column} = '{k}' THEN '{v}'" for k, v in pairs) + f" ELSE {default} END"


def keyword_sql(text: str, families=KEYWORD_FAMILIES) -> str:
    """A FROM item: rows (fam, category, severity, keyword) of the families that match."""
    rows = []
    for i, (category, severity, words) in enumerate(families):
        hit = "CASE " + " ".join(f"WHEN contains(lower({text}), '{w}') THEN '{w}'" for w in words) + " END"
        rows.append(f"SELECT {i} AS fam, '{category}' AS category, '{severity}' AS severity, {hit} AS keyword")
    return "(SELECT * FROM (" + " UNION ALL ".join(rows) + ") WHERE keyword IS NOT NULL)"


_SPDX_SQL = "CASE conv_id % 7 " + " ".join(f"WHEN {i} THEN {'NULL' if s is None else repr(s)}" for i, s in enumerate(SPDX)) + " END"

SQL = {
    "pulls": f"""turns AS (SELECT conv_id, turn, CASE WHEN role <> 'user' THEN role END AS path, text AS body, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos FROM conversations),
pulls AS (SELECT 'org/r' || (conv_id % 10) AS repository, conv_id AS pull_number, 'https://host.example/' || conv_id AS source_url, body AS title, {_SPDX_SQL} AS spdx FROM turns WHERE pos = 1)""",
    "files": f"""files AS (SELECT doc_id, source || '/' || doc_id || {_case("lang", EXTENSIONS, "'.txt'")} AS path, CASE WHEN doc_id % 7 <> 0 THEN lang END AS before, text AS after,
CASE doc_id % 5 WHEN 0 THEN 'added' WHEN 1 THEN 'removed' WHEN 2 THEN 'changed' WHEN 3 THEN 'renamed' ELSE 'modified' END AS status FROM documents)""",
    "licensed": "licensed AS (SELECT doc_id, source, CASE " + " ".join(f"WHEN contains(text, '{n}') THEN '{s}'" for n, s in LICENSE_LINES) + " END AS spdx FROM documents)",
    "predictions": """predictions AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'security' WHEN quality = 0 THEN 'bug' ELSE 'testing' END AS expected,
CASE WHEN n_chars >= 600 THEN CASE n_chars % 5 WHEN 0 THEN 'security' WHEN 1 THEN 'bug' WHEN 2 THEN 'testing' WHEN 3 THEN 'style' ELSE '' END END AS predicted, n_chars
FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL AND toxic IS NOT NULL)""",
}
