"""Queries: analyzers, review prompts, source scans, streams."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from reviewloom.analyzers import engine
from reviewloom.functions.text import review_prompt as render_review
from reviewloom.functions.vocabulary import RULES, TAXONOMY_CATEGORIES, literal_rows
from reviewloom.plans.snippets import SNIPPETS
from reviewloom.sources import source_tree
from reviewloom.sources.scratch import new_path
from reviewloom.sources.tables import table
from reviewloom.streaming.landing import merged_per_window

_NAMES = sorted(SNIPPETS)
_EXT = {"python": ".py", "javascript": ".js"}


#: What opens a comment, by language.
_COMMENT = {"python": "# ", "javascript": "// "}


def code(spark, sf):
    """Documents as source files: the snippet by document id, and the document's whole text behind it as comment lines."""
    rows = literal_rows(spark, ("k", "ext", "comment", "snippet"), [(i, _EXT[SNIPPETS[n][0]], _COMMENT[SNIPPETS[n][0]], SNIPPETS[n][1]) for i, n in enumerate(_NAMES)])
    docs = table(spark, sf, "documents").select("doc_id", "text", (F.col("doc_id") % len(_NAMES)).cast("int").alias("k"))
    said = F.regexp_replace(F.coalesce("text", F.lit("")), F.lit(r"[\n\r\f]"), F.concat(F.lit("\n"), "comment"))
    return docs.join(F.broadcast(rows), "k").select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), "ext").alias("path"), F.concat("snippet", "comment", said).alias("content"))


_COLUMNS = ("path", "rule_id", "start_line", "start_column", "end_line", "end_column", "confidence")


def findings_python(spark, sf):
    return engine.find(code(spark, sf)).where("path LIKE '%.py'")


def findings_js(spark, sf):
    return engine.find(code(spark, sf)).where("path LIKE '%.js'")


def findings_union(spark, sf):
    return engine.findings(code(spark, sf)).select("id", "category", "severity", *_COLUMNS)


def findings_by_file(spark, sf):
    return engine.by_file(engine.find(code(spark, sf))).select("path", F.size("findings").cast("long").alias("n"), F.element_at("findings", 1)["rule_id"].alias("first_rule"))


def findings_by_severity(spark, sf):
    return engine.findings(code(spark, sf)).groupBy("severity", "category").agg(F.count(F.lit(1)).alias("n"))


def review_prompt(spark, sf):
    """The review request of each file with a finding, its findings as JSON records."""
    files = code(spark, sf)
    joined = engine.records_by_file(engine.findings(files)).join(files, "path", "left")
    return joined.select("path", render_review(F.col("path"), F.col("content"), F.col("records")).alias("prompt"))


def taxonomy_coverage(spark, sf):
    """Findings of each taxonomy category, none included."""
    found = engine.findings(code(spark, sf)).groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    top = literal_rows(spark, ("category", "in_taxonomy"), [(c, True) for c in TAXONOMY_CATEGORIES])
    return top.join(found, "category", "full").select("category", F.coalesce("in_taxonomy", F.lit(False)).alias("in_taxonomy"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def script_calls_in_pages(spark, sf):
    """Script bodies of pages, with one put before each page's own, through the script rules."""
    own = F.concat(F.lit("<script>eval(s); // é\nconsole.log("), F.col("page_id").cast("string"), F.lit(", a == b)</script>"), F.coalesce("html", F.lit("")))
    bodies = F.expr(r"regexp_extract_all(page, '(?s)<script[^>]*>(.*?)</script>', 1)")
    files = table(spark, sf, "pages").withColumn("page", own).select(F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".js")).alias("path"), F.array_join(bodies, "\n").alias("content"))
    return engine.find(files)


#: Lines of a source file that is written for the scan.
_LINES = 10_000


def source_tree_scan(spark, sf):
    """Checksums of documents, written by language as a tree of script files, a line a document, and read again through the source-tree reader."""
    source_tree.register(spark)
    line = F.concat(F.lit("const d"), F.col("doc_id").cast("string"), F.lit(" = '"), F.sha2("text", 256), F.lit("';"))
    tree = new_path(spark, "sources")
    rows = table(spark, sf, "documents").where("doc_id IS NOT NULL AND text IS NOT NULL").select("lang", line.alias("line"))
    rows.write.partitionBy("lang").option("extension", "mjs").option("maxRecordsPerFile", _LINES).csv(tree)
    files = spark.read.format("source_tree").load(tree).where("language = 'javascript' AND error IS NULL")
    lines = files.select(F.regexp_extract("path", "/lang=([^/]*)/", 1).alias("lang"), "language", F.explode(F.split("content", "\n")).alias("line")).where("line <> ''")
    part = lambda i: F.regexp_extract("line", "^const d(.*) = '(.*)';$", i)
    return lines.select(part(1).cast("long").alias("doc_id"), F.when(F.col("lang") != "__HIVE_DEFAULT_PARTITION__", F.col("lang")).alias("lang"), "language", part(2).alias("checksum"))


def events_per_window(spark, sf):
    return merged_per_window(table(spark, sf, "events"))


QUERIES = {
    f.__name__: f
    for f in (findings_python, findings_js, findings_union, findings_by_file, findings_by_severity, review_prompt, taxonomy_coverage, script_calls_in_pages, source_tree_scan, events_per_window)
}


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_FOUND = [(i, rule, *place, SNIPPETS[n][3]) for i, n in enumerate(_NAMES) for rule, *place in SNIPPETS[n][2]]


def _record(rule: tuple) -> str:
    """A finding record of a rule as indented JSON, with an @name for what is told by the finding."""
    name, _, category, severity, kind, tags = rule
    place = {"path": "@path", **{k: f"@{k}@" for k in ("startLine", "startColumn", "endLine", "endColumn")}}
    record = {"id": f"{name}:@path:@startLine:@startColumn", "ruleId": name, "category": category, "severity": severity, "confidence": "@confidence", "location": place, "relatedLocations": [], "evidence": [{"kind": kind, "locations": [place]}], "tags": tags}
    text = json.dumps([record], indent=2)[2:-2]
    for k in ("startLine", "startColumn", "endLine", "endColumn"):
        text = text.replace(f'"@{k}@"', f"@{k}")
    return text


def _filled(text: str) -> str:
    for name, value in (("path", "path"), ("startLine", "start_line::VARCHAR"), ("startColumn", "start_column::VARCHAR"), ("endLine", "end_line::VARCHAR"), ("endColumn", "end_column::VARCHAR"), ("confidence", "confidence")):
        text = f"replace({text}, '@{name}', {value})"
    return text


_CODE = f"""s(k, ext, comment, snippet) AS (VALUES {", ".join(f"({i}, '{_EXT[SNIPPETS[n][0]]}', '{_COMMENT[SNIPPETS[n][0]]}', {_text(SNIPPETS[n][1])})" for i, n in enumerate(_NAMES))}),
f(k, rule_id, start_line, start_column, end_line, end_column, confidence) AS (VALUES {", ".join(str(r) for r in _FOUND)}),
r(rule_id, category, severity, record) AS (VALUES {", ".join(f"('{r[0]}', '{r[2]}', '{r[3]}', {_text(_record(r))})" for r in RULES)}),
code AS (SELECT 'd' || doc_id || ext AS path, k, snippet || comment || regexp_replace(coalesce(text, ''), '[\\n\\r\\f]', chr(10) || comment, 'g') AS content FROM documents JOIN s ON k = doc_id % {len(_NAMES)}),
found AS (SELECT path, content, f.*, category, severity, record FROM code JOIN f USING (k) JOIN r USING (rule_id))"""
_PLAIN = ", ".join(_COLUMNS)

ORACLES = {
    "findings_python": f"WITH {_CODE} SELECT {_PLAIN} FROM found WHERE path LIKE '%.py'",
    "findings_js": f"WITH {_CODE} SELECT {_PLAIN} FROM found WHERE path LIKE '%.js'",
    "findings_union": f"WITH {_CODE} SELECT rule_id || ':' || path || ':' || start_line || ':' || start_column AS id, category, severity, {_PLAIN} FROM found",
    "findings_by_file": f"WITH {_CODE} SELECT path, count(*) AS n, first(rule_id ORDER BY start_line, start_column, rule_id) AS first_rule FROM found GROUP BY path",
    "findings_by_severity": f"WITH {_CODE} SELECT severity, category, count(*) AS n FROM found GROUP BY ALL",
    "review_prompt": f"""WITH {_CODE} SELECT path, 'File: ' || path || chr(10) || chr(10) || '```' || chr(10) || substr(any_value(content), 1, 20000) || chr(10) || '```' || chr(10) || chr(10) || 'Findings:' || chr(10)
|| '[' || chr(10) || string_agg({_filled("record")}, ',' || chr(10) ORDER BY start_line, start_column, rule_id, end_line, end_column) || chr(10) || ']' AS prompt FROM found GROUP BY path""",
    "taxonomy_coverage": f"WITH {_CODE}, t(category) AS (VALUES {', '.join(f'({c!r})' for c in TAXONOMY_CATEGORIES)}), g AS (SELECT category, count(*) AS n FROM found GROUP BY 1) SELECT coalesce(t.category, g.category) AS category, t.category IS NOT NULL AS in_taxonomy, coalesce(n, 0)::BIGINT AS n FROM t FULL JOIN g USING (category)",
    "script_calls_in_pages": """WITH p AS (SELECT 'p' || page_id || '.js' AS path, length(page_id::VARCHAR)::INT AS n FROM pages)
SELECT path, 'javascript.dangerous-eval' AS rule_id, 1 AS start_line, 1 AS start_column, 1 AS end_line, 8 AS end_column, 'likely' AS confidence FROM p
UNION ALL SELECT path, 'javascript.console-log', 2, 1, 2, 12, 'likely' FROM p UNION ALL SELECT path, 'javascript.loose-equality', 2, 15 + n, 2, 21 + n, 'likely' FROM p""",
    "source_tree_scan": "SELECT doc_id, lang, 'javascript' AS language, sha256(text) AS checksum FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL",
    "events_per_window": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
}
