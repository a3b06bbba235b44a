"""Queries: landed records, proposals, promotion, projection, technologies."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewloom.functions.text import first_of_many, js_trim
from reviewloom.functions.vocabulary import ALLOWED_LICENSES, KEYWORD_FAMILIES, TECHNOLOGIES
from reviewloom.operators import ecosystem, examples, ingest, label, project
from reviewloom.plans.views import PACKAGES, SQL, SYLLABLE_FAMILIES, files, keyword_sql, licensed, pulls
from reviewloom.sources.scratch import new_path
from reviewloom.sources.tables import table
from reviewloom.streaming import promotion


def _exploded(df, *keys):
    return df.select(*keys, F.posexplode("proposals").alias("pos", "p")).select(*keys, F.col("pos").cast("long").alias("pos"), "p.*")


def _proposed(spark, sf, families):
    rows = pulls(spark, sf)
    return rows.select("pull_number", label.proposals(F.col("title"), F.col("comments"), families).alias("proposals"))


def propose_title(spark, sf):
    rows = pulls(spark, sf).select("pull_number", label.proposals(F.col("title"), F.array().cast("array<struct<path:string,body:string>>"), SYLLABLE_FAMILIES).alias("proposals"))
    return _exploded(rows, "pull_number").drop("reviewer_comment")


def propose_dedup(spark, sf):
    return _exploded(_proposed(spark, sf, KEYWORD_FAMILIES), "pull_number")


def propose_comments(spark, sf):
    return _exploded(_proposed(spark, sf, SYLLABLE_FAMILIES), "pull_number").where("confidence = 'likely'").drop("pos")


def propose_rule_counts(spark, sf):
    rows = _exploded(_proposed(spark, sf, SYLLABLE_FAMILIES), "pull_number")
    return rows.groupBy("rule", "category").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("pull_number").alias("pulls"))


def review_file(spark, sf):
    out = label.review_file(pulls(spark, sf), SYLLABLE_FAMILIES)
    return out.select("repository", "pull_number", "source_url", "title", F.size("proposals").cast("long").alias("n"))


def _review(spark, sf):
    """Review entries with an earlier duplicate for every second one and emptied proposals for every fifth."""
    base = label.review_file(pulls(spark, sf), SYLLABLE_FAMILIES).where("pull_number % 3 <> 0").select("repository", F.col("pull_number").cast("string").alias("pull_number"), "proposals")
    n = F.col("pull_number").cast("long")
    last = base.withColumns({"ord": n * 2 + 1, "proposals": F.when(n % 5 == 0, F.slice("proposals", 1, 0)).otherwise(F.col("proposals"))})
    early = base.where(n % 2 == 0).withColumns({"ord": n * 2, "proposals": F.slice("proposals", 1, 1)})
    return last.unionByName(early)


def promote_join(spark, sf):
    out = label.promote(pulls(spark, sf), _review(spark, sf))
    return out.select("repository", "pull_number", F.size("signals").cast("long").alias("n"), F.posexplode("signals").alias("pos", "s")).select(
        "repository", "pull_number", "n", F.col("pos").cast("long").alias("pos"), "s.category", "s.confidence", "s.severity"
    )


def promote_last_wins(spark, sf):
    return label.promote(pulls(spark, sf), _review(spark, sf)).select("pull_number", F.size("signals").cast("long").alias("n"))


#: Keywords of four letters, made by a rule, in the order that counts.
MANY_KEYWORDS = tuple(a + b + c + d for a in "tnrsl" for b in "aeiou" for c in "tnrsl" for d in "aeiou")


def first_of_many_keywords(spark, sf):
    """The first of hundreds of keywords in each whole text, in one pass over it."""
    return table(spark, sf, "documents").select("doc_id", first_of_many(F.col("text"), MANY_KEYWORDS).alias("keyword"))


def promote_stream(spark, sf):
    """Documents as raw rows, and up to three review entries of each, as two streams that run through what is there."""
    path = f"{sf}/documents.parquet"
    # A stream's path is a folder or a pattern; the table may be one file.
    docs = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")
    raw = docs.select(F.col("source").alias("repository"), F.col("doc_id").alias("pull_number"), "n_chars")
    entries = docs.where("doc_id % 4 <> 0").select("source", "doc_id", "lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("doc_id") % 3)).alias("ord"))
    proposal = F.struct(F.lit("r").alias("rule"), F.concat(F.lit("c"), F.col("ord").cast("string")).alias("category"), F.col("lang").alias("evidence"))
    emptied = F.slice(F.array_repeat(proposal, 3), F.lit(1), F.when((F.col("ord") == 2) & (F.col("doc_id") % 5 == 0), 0).otherwise(F.col("ord") + 1).cast("int"))
    review = entries.select(F.col("source").alias("repository"), F.col("doc_id").alias("pull_number"), "ord", emptied.alias("proposals"))
    out = new_path(spark, "promotions")
    with promotion.stateful(spark):
        q = promotion.promotions(raw, review).writeStream.format("parquet").option("checkpointLocation", new_path(spark, "promotions-state")).trigger(availableNow=True).start(out)
        q.awaitTermination()
    updates = spark.read.schema(promotion.UPDATE).parquet(out)
    done = promotion.settled(updates, raw.schema, review.schema["proposals"].dataType)
    return done.select("repository", "pull_number", "n_chars", F.size("signals").cast("long").alias("n"), F.col("signals")[0]["category"].alias("category"))


def promote_dropped_anti(spark, sf):
    return label.not_promoted(pulls(spark, sf), _review(spark, sf)).select("repository", "pull_number", "title")


def example_id(spark, sf):
    out = label.promote(pulls(spark, sf), _review(spark, sf))
    changes = F.array(F.struct(F.lit("a.ts").alias("path"), F.col("title").alias("after")))
    return out.select("pull_number", label.example_id(F.col("repository"), F.col("source_url"), changes, F.col("signals")).alias("id"))


def _examples(spark, sf):
    """Promoted pull requests joined with changed files of the same number."""
    out = label.promote(pulls(spark, sf), _review(spark, sf))
    own = files(spark, sf).where("path NOT LIKE '%.md'").withColumn("pull_number", F.expr("doc_id div 4"))
    nested = own.groupBy("pull_number").agg(F.array_sort(F.collect_list(F.struct("doc_id", "path", "status", "before", "after"))).alias("files"))
    joined = out.join(nested, "pull_number")
    changes = ingest.complete_pairs(F.col("files"))
    status = ingest.license_status(ingest.license_spdx(F.col("spdx")))
    tech = F.array(F.get(F.array(*[F.lit(p) for p in PACKAGES]), (F.col("pull_number") % len(PACKAGES)).cast("int")))
    return joined.withColumns({"changes": changes, "language": ingest.language_of_files(F.col("files")), "license_status": status, "commit_sha": F.lit("sha"), "frameworks": tech, "libraries": F.array().cast("array<string>"), "databases": F.array().cast("array<string>")})


def project_signals(spark, sf):
    out = project.project_training(_examples(spark, sf))
    return out.select("repository", "source_url", "language", "framework", "library", "spdx", "category", "confidence", "severity", "summary", "context", F.sha2("code", 256).alias("code_sha"))


def project_code_render(spark, sf):
    return _examples(spark, sf).select("pull_number", F.sha2(project.render_changes(F.col("changes")), 256).alias("code_sha"), F.size("changes").cast("long").alias("n_changes"))


def license_classify(spark, sf):
    return licensed(spark, sf).select("doc_id", "spdx", ingest.license_status(F.col("spdx")).alias("status"))


def license_status_counts(spark, sf):
    status = ingest.license_status(ingest.license_spdx(F.col("spdx")))
    return pulls(spark, sf).select("repository", status.alias("status")).groupBy("repository", "status").agg(F.count(F.lit(1)).alias("n"))


def license_gate(spark, sf):
    return licensed(spark, sf).where(ingest.license_status(F.col("spdx")) == "allowed").select("doc_id", "source", "spdx")


def lang_detect_path(spark, sf):
    p = F.col("path")
    return files(spark, sf).select("path", ingest.language_of(p).alias("language"), ingest.dialect_of(p).alias("dialect"), ingest.extension_of(p).alias("extension"))


def ext_filter(spark, sf):
    return files(spark, sf).where(ingest.supported(F.col("path"), ["javascript", "typescript"])).select("doc_id", "path")


def pr_language_first_known(spark, sf):
    rows = files(spark, sf).withColumn("pr", F.expr("doc_id div 10")).groupBy("pr").agg(F.array_sort(F.collect_list(F.struct("doc_id", "path"))).alias("files"))
    return rows.select("pr", ingest.language_of_files(F.col("files")).alias("language"))


def complete_pairs(spark, sf):
    rows = files(spark, sf).withColumns({"pr": F.expr("doc_id div 10"), "after": F.col("after").isNotNull().cast("string")}).withColumn("after", F.nullif("after", F.lit("false"))).groupBy("pr").agg(F.collect_list(F.struct("before", "after")).alias("files"))
    return rows.select("pr", F.size("files").cast("long").alias("n_files"), F.size(ingest.complete_pairs(F.col("files"))).cast("long").alias("n_pairs"))


def change_status_norm(spark, sf):
    return files(spark, sf).select(ingest.file_status(F.col("status")).alias("status")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


#: Cutoff of the listing: inside of the newest ten pages of the smaller tables.
SINCE = "2024-01-30 01:28:35"


def since_cutoff_merged(spark, sf):
    rows = table(spark, sf, "events").select(
        F.col("event_id").alias("number"), F.col("ts").alias("updated_at"), F.when(F.col("event_type") == "purchase", F.col("ts")).alias("merged_at"), F.when(F.col("user_id") % 10 != 0, F.col("user_id").cast("string")).otherwise("").alias("merge_commit_sha")
    )
    return ingest.merged_since(rows, F.to_timestamp(F.lit(SINCE))).select("number", "merge_commit_sha")


def content_size_cap(spark, sf):
    text = F.col("text")
    kind = F.when(F.col("doc_id") % 9 == 0, "none").otherwise("base64")
    rows = table(spark, sf, "documents").select("doc_id", F.base64(text.cast("binary")).alias("content"), kind.alias("encoding"), (F.octet_length(text) * 40).alias("size"))
    return rows.select("doc_id", F.length(ingest.decoded_content(F.col("content"), F.col("encoding"), F.col("size"))).cast("long").alias("chars"))


def base64_roundtrip(spark, sf):
    text = F.col("text")
    got = ingest.decoded_content(F.base64(text.cast("binary")), F.lit("base64"), F.lit(1))
    return table(spark, sf, "documents").select("doc_id", F.sha2(got, 256).alias("sha"))


def assemble_pulls(spark, sf):
    rows = pulls(spark, sf)
    heads = rows.select("repository", F.col("pull_number").alias("number"), "title")
    comments = rows.select("repository", F.col("pull_number").alias("number"), F.posexplode("comments").alias("ord", "c")).select("repository", "number", "ord", "c.path", "c.body")
    own = files(spark, sf).select(F.concat(F.lit("org/r"), (F.col("doc_id") % 10).cast("string")).alias("repository"), F.col("doc_id").alias("number"), F.col("doc_id").alias("ord"), "path")
    licenses = rows.groupBy("repository").agg(F.max("spdx").alias("spdx"))
    out = ingest.assemble(heads, own, comments, licenses)
    return out.select("repository", "number", "license_status", F.coalesce(F.size("comments"), F.lit(0)).cast("long").alias("n_comments"), F.element_at("files", 1)["path"].alias("path"))


def normalize_tags(spark, sf):
    tags = F.concat(F.split("text", " "), F.array(F.lit("  the\t"), F.lit(" "), F.lit("the")))
    return table(spark, sf, "documents").select("doc_id", F.array_join(project.unique_strings(tags), "|").alias("tags"))


def normalize_signals(spark, sf):
    s = F.transform(F.split("text", "\n"), lambda x: F.struct(F.substring(x, 1, 1).alias("category"), F.lit("likely").alias("confidence"), F.lit("low").alias("severity"), F.concat(F.lit(" "), x).alias("summary"), F.lit(" ").alias("reviewer_comment")))
    out = table(spark, sf, "documents").select("doc_id", project.normalize_signals(s).alias("s"))
    return out.select("doc_id", F.sha2(F.array_join(F.transform("s", lambda x: F.concat(x["category"], F.lit("/"), x["summary"])), "|"), 256).alias("signals"), F.size("s").cast("long").alias("n"))


def js_trim_text(spark, sf):
    padded = F.concat(F.lit("﻿ \t"), F.col("text"), F.lit("  　"))
    return table(spark, sf, "documents").select("doc_id", (js_trim(padded) == js_trim(F.col("text"))).alias("same"), F.length(js_trim(F.col("text"))).cast("long").alias("chars"))


def _manifests(spark, sf):
    k, n = F.col("doc_id"), len(PACKAGES)
    names = F.array(*map(F.lit, PACKAGES))
    name = lambda step: F.get(names, ((k + step) % n).cast("int"))
    prod = F.map_from_entries(F.array(F.struct(name(0), F.lit("1")), F.struct(name(3), F.lit("2"))))
    dev = F.map_from_entries(F.array(F.struct(name(3), F.lit("9")), F.struct(name(1), F.lit("3"))))
    return table(spark, sf, "documents").select("doc_id", ecosystem.merged_dependencies(prod, F.when(k % 4 != 0, dev)).alias("dependencies"))


def technology_detect(spark, sf):
    return ecosystem.detect(_manifests(spark, sf), "doc_id").select("doc_id", "technology", "confidence")


def technology_evidence_group(spark, sf):
    return ecosystem.detect(_manifests(spark, sf), "doc_id").select("doc_id", "technology", F.array_join("evidence", ",").alias("evidence"))


def engine_context(spark, sf):
    found = ecosystem.detect(_manifests(spark, sf), "doc_id")
    return ecosystem.engine_context(found, "doc_id", F.when(F.col("doc_id") % 3 != 0, "nodejs"))


def raw_to_example(spark, sf):
    """Pull requests of four files each, unnormalised, to normalised examples."""
    of = F.expr("doc_id div 4")
    own = files(spark, sf).select(of.alias("n"), F.struct("doc_id", "path", "status", F.lit(1).alias("additions"), F.lit(0).alias("deletions"), "before", "after").alias("f"))
    one = own.groupBy("n").agg(F.array_sort(F.collect_list("f")).alias("files"))
    signal = lambda c, s: F.struct(F.lit(c).alias("category"), F.lit("likely").alias("confidence"), F.lit("low").alias("severity"), s.alias("summary"), F.lit(" ").alias("reviewer_comment"))
    n = F.col("n").cast("string")
    raw = one.select(
        F.lit("host.example").alias("host"), F.concat(F.lit("\t org/r"), n).alias("repository"), F.concat(F.lit("sha"), n).alias("merge_commit_sha"), F.concat(F.lit("https://h/"), n, F.lit(" ")).alias("source_url"),
        F.when(F.col("n") % 2 == 0, "MIT").otherwise("").alias("spdx"), ingest.license_status(F.when(F.col("n") % 2 == 0, "MIT")).alias("license_status"), F.lit("2026-01-01T00:00:00Z").alias("collected_at"), "files",
        F.array(signal("bug", F.concat(F.lit(" s "), n)), signal("bug", F.concat(F.lit("s "), n)), signal("testing", F.lit(" "))).alias("signals"),
    )
    out = examples.normalize_examples(examples.to_examples(raw))
    changed = F.array_join(F.transform("changes", lambda c: F.concat(c["path"], F.lit(":"), c["before"], F.lit(":"), F.sha2(c["after"], 256))), ",")
    said = F.array_join(F.transform("signals", lambda s: F.concat(s["category"], F.lit("/"), s["summary"], F.coalesce(s["reviewer_comment"], F.lit("")))), ",")
    return out.select("provenance.repository", "provenance.commit_sha", "provenance.source_url", "provenance.license_spdx", "provenance.license_status", "language", changed.alias("changes"), said.alias("signals"))


def dependency_merge(spark, sf):
    d = F.col("dependencies")
    return _manifests(spark, sf).select("doc_id", F.array_join(F.map_keys(d), ",").alias("names"), F.array_join(F.map_values(d), ",").alias("versions"), ecosystem.is_typescript(d).alias("typescript"))


QUERIES = {
    f.__name__: f
    for f in (
        propose_title, propose_comments, propose_dedup, propose_rule_counts, review_file, promote_join, promote_last_wins, promote_dropped_anti, promote_stream, first_of_many_keywords, example_id,
        project_signals, project_code_render, license_classify, license_status_counts, license_gate, lang_detect_path, ext_filter, pr_language_first_known,
        complete_pairs, change_status_norm, since_cutoff_merged, content_size_cap, base64_roundtrip, assemble_pulls, normalize_tags, normalize_signals, js_trim_text,
        technology_detect, technology_evidence_group, dependency_merge, engine_context, raw_to_example,
    )
}


def _props(families) -> str:
    """CTEs ending in props(pull_number, pos, category, confidence, severity, summary, reviewer_comment, rule, evidence)."""
    short = "CASE WHEN length(body) > 300 THEN body[1:300] || '...' ELSE body END"
    return f"""{SQL["pulls"]},
hits AS (SELECT pull_number, 0 AS c, fam, k.category, 'possible' AS confidence, k.severity, 'PR title suggests a ' || k.category || ' change: "' || title || '"' AS summary, NULL::VARCHAR AS reviewer_comment, 'title-keyword:' || keyword AS rule, title AS evidence
  FROM pulls, LATERAL {keyword_sql("title", families)} k
UNION ALL SELECT conv_id, pos, fam, k.category, 'likely', k.severity, 'Reviewer comment suggests a ' || k.category || ' finding' || CASE WHEN coalesce(path, '') <> '' THEN ' in ' || path ELSE '' END || '.', body, 'review-comment-keyword:' || keyword, {short}
  FROM turns, LATERAL {keyword_sql("body", families)} k WHERE pos > 1),
firsts AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY pull_number, category, rule, evidence ORDER BY c, fam) = 1),
props AS (SELECT pull_number, row_number() OVER (PARTITION BY pull_number ORDER BY c, fam) - 1 AS pos, category, confidence, severity, summary, reviewer_comment, rule, evidence FROM firsts)"""


def _status(spdx: str) -> str:
    allowed = ", ".join(f"'{x}'" for x in ALLOWED_LICENSES)
    return f"CASE WHEN {spdx} IS NULL OR {spdx} = '' THEN 'unknown' WHEN {spdx} IN ({allowed}) THEN 'allowed' ELSE 'review-required' END"


_SYL = _props(SYLLABLE_FAMILIES)
_PROMOTED = f"""WITH {_SYL}, counts AS (SELECT pull_number, count(*) AS n FROM props GROUP BY 1),
promoted AS (SELECT p.*, n FROM pulls p JOIN counts USING (pull_number) WHERE pull_number % 3 <> 0 AND pull_number % 5 <> 0)"""
_LANG = r"CASE WHEN regexp_matches(path, '\.(ts|tsx|mts|cts)$') THEN 'typescript' WHEN regexp_matches(path, '\.(js|jsx|mjs|cjs)$') THEN 'javascript' WHEN regexp_matches(path, '\.(py|pyi)$') THEN 'python' END"
_EXAMPLES = f"""{_PROMOTED}, {SQL["files"]}, own AS (SELECT *, doc_id // 4 AS pr FROM files WHERE path NOT LIKE '%.md'),
ex AS (SELECT pr, coalesce(first({_LANG} ORDER BY doc_id) FILTER ({_LANG} IS NOT NULL), 'javascript') AS language,
  coalesce(string_agg('// ' || path || chr(10) || after, chr(10) || chr(10) ORDER BY doc_id) FILTER (before IS NOT NULL AND after IS NOT NULL AND length(after) > 0), '') AS code,
  count(*) FILTER (before IS NOT NULL AND after IS NOT NULL) AS n_changes FROM own GROUP BY pr)"""
_PACK = ", ".join(f"'{p}'" for p in PACKAGES)
_DEPS = f"""n AS (SELECT doc_id, [{_PACK}] AS ns FROM documents),
raw AS (SELECT doc_id, 0 AS dev, 0 AS pos, ns[doc_id % 8 + 1] AS name, '1' AS v FROM n UNION ALL SELECT doc_id, 0, 1, ns[(doc_id + 3) % 8 + 1], '2' FROM n
  UNION ALL SELECT doc_id, 1, 2, ns[(doc_id + 3) % 8 + 1], '9' FROM n WHERE doc_id % 4 <> 0 UNION ALL SELECT doc_id, 1, 3, ns[(doc_id + 1) % 8 + 1], '3' FROM n WHERE doc_id % 4 <> 0),
deps AS (SELECT doc_id, name, min(pos) AS pos, max_by(v, dev) AS v FROM raw GROUP BY doc_id, name)"""
_TECH = "tech(package, technology) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in TECHNOLOGIES) + ")"
_TRIM = "regexp_replace({x}, '^[\\x{{09}}-\\x{{0D}} \\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}\\x{{FEFF}}]+|[\\x{{09}}-\\x{{0D}} \\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}\\x{{FEFF}}]+$', '', 'g')"

ORACLES = {
    "propose_title": f"WITH {_SYL} SELECT pull_number, (row_number() OVER (PARTITION BY pull_number ORDER BY pos) - 1)::BIGINT AS pos, category, confidence, severity, summary, rule, evidence FROM props WHERE confidence = 'possible'",
    "propose_comments": f"WITH {_SYL} SELECT * EXCLUDE (pos) FROM props WHERE confidence = 'likely'",
    "propose_dedup": f"WITH {_props(KEYWORD_FAMILIES)} SELECT * REPLACE (pos::BIGINT AS pos) FROM props",
    "propose_rule_counts": f"WITH {_SYL} SELECT rule, category, count(*) AS n, count(DISTINCT pull_number) AS pulls FROM props GROUP BY ALL",
    "review_file": f"WITH {_SYL} SELECT repository, pull_number, source_url, title, count(*) AS n FROM pulls JOIN props USING (pull_number) GROUP BY ALL",
    "promote_join": f"{_PROMOTED} SELECT repository, pull_number, n, pos::BIGINT AS pos, category, confidence, severity FROM promoted JOIN props USING (pull_number)",
    "promote_last_wins": f"{_PROMOTED} SELECT pull_number, n FROM promoted",
    "promote_dropped_anti": f"WITH {_SYL} SELECT repository, pull_number, title FROM pulls WHERE pull_number % 3 = 0 OR pull_number NOT IN (SELECT pull_number FROM props)",
    "promote_stream": "SELECT source AS repository, doc_id AS pull_number, n_chars, (doc_id % 3 + 1)::BIGINT AS n, 'c' || (doc_id % 3) AS category FROM documents WHERE source IS NOT NULL AND doc_id % 4 <> 0 AND NOT (doc_id % 3 = 2 AND doc_id % 5 = 0)",
    "first_of_many_keywords": f"SELECT doc_id, list_filter([{', '.join(repr(k) for k in MANY_KEYWORDS)}], lambda k: contains(lower(text), k))[1] AS keyword FROM documents",
    "project_signals": f"""{_EXAMPLES} SELECT repository, source_url, language, ([{_PACK}])[pull_number % 8 + 1] AS framework, NULL::VARCHAR AS library, spdx, category, confidence, severity, summary, reviewer_comment AS context, sha256(code) AS code_sha
FROM promoted JOIN ex ON pr = pull_number JOIN props USING (pull_number) WHERE code <> '' AND {_status("nullif(spdx, 'NOASSERTION')")} = 'allowed'""",
    "project_code_render": f"{_EXAMPLES} SELECT pull_number, sha256(code) AS code_sha, n_changes FROM promoted JOIN ex ON pr = pull_number",
    "license_classify": f"WITH {SQL['licensed']} SELECT doc_id, spdx, {_status('spdx')} AS status FROM licensed",
    "license_status_counts": f"WITH {SQL['pulls']}, s AS (SELECT repository, {_status('nullif(spdx, ' + repr('NOASSERTION') + ')')} AS status FROM pulls) SELECT repository, status, count(*) AS n FROM s GROUP BY ALL",
    "license_gate": f"WITH {SQL['licensed']} SELECT doc_id, source, spdx FROM licensed WHERE {_status('spdx')} = 'allowed'",
    "lang_detect_path": rf"WITH {SQL['files']} SELECT path, {_LANG} AS language, CASE WHEN regexp_matches(path, '\.(ts|js)x$') THEN 'tsx' WHEN regexp_matches(path, '\.[mc]?[jt]s$') THEN 'typescript' END AS dialect, regexp_extract(path, '\.[^.]*$', 0) AS extension FROM files",
    "ext_filter": f"WITH {SQL['files']} SELECT doc_id, path FROM files WHERE {_LANG} IN ('javascript', 'typescript')",
    "pr_language_first_known": f"WITH {SQL['files']} SELECT doc_id // 10 AS pr, coalesce(first({_LANG} ORDER BY doc_id) FILTER ({_LANG} IS NOT NULL), 'javascript') AS language FROM files GROUP BY 1",
    "complete_pairs": f"WITH {SQL['files']} SELECT doc_id // 10 AS pr, count(*) AS n_files, count(*) FILTER (before IS NOT NULL AND after IS NOT NULL) AS n_pairs FROM files GROUP BY 1",
    "change_status_norm": f"WITH {SQL['files']} SELECT CASE WHEN status IN ('added', 'removed', 'renamed') THEN status ELSE 'modified' END AS status, count(*) AS n FROM files GROUP BY 1",
    "since_cutoff_merged": """WITH newest AS (SELECT *, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS r FROM events)
SELECT event_id AS number, user_id::VARCHAR AS merge_commit_sha FROM newest WHERE r <= 500 AND ts >= '2024-01-30 01:28:35'::TIMESTAMP AND event_type = 'purchase' AND user_id % 10 <> 0""",
    "content_size_cap": "SELECT doc_id, CASE WHEN doc_id % 9 <> 0 AND strlen(text) * 40 <= 200000 THEN length(text) END AS chars FROM documents",
    "base64_roundtrip": "SELECT doc_id, sha256(text) AS sha FROM documents",
    "assemble_pulls": f"""WITH {SQL['pulls']}, {SQL['files']}, lic AS (SELECT repository, max(spdx) AS spdx FROM pulls GROUP BY 1), com AS (SELECT conv_id, count(*) AS n FROM turns WHERE pos > 1 GROUP BY 1)
SELECT p.repository, p.pull_number AS number, {_status("nullif(lic.spdx, 'NOASSERTION')")} AS license_status, coalesce(com.n, 0) AS n_comments, f.path
FROM pulls p JOIN lic USING (repository) LEFT JOIN com ON conv_id = pull_number LEFT JOIN files f ON f.doc_id = pull_number""",
    "normalize_tags": f"""WITH t AS (SELECT doc_id, unnest(list_concat(string_split(text, ' '), ['  the' || chr(9), chr(160), 'the'])) AS x, generate_subscripts(list_concat(string_split(text, ' '), ['', '', '']), 1) AS i FROM documents),
u AS (SELECT doc_id, {_TRIM.format(x="x")} AS tag, min(i) AS i FROM t GROUP BY 1, 2) SELECT doc_id, string_agg(tag, '|' ORDER BY i) AS tags FROM u WHERE tag <> '' GROUP BY 1""",
    "normalize_signals": f"""WITH t AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
u AS (SELECT doc_id, x[1:1] AS c, {_TRIM.format(x="' ' || x")} AS s, min(i) AS i FROM t GROUP BY 1, 2, 3)
SELECT doc_id, sha256(coalesce(string_agg(c || '/' || s, '|' ORDER BY i) FILTER (s <> ''), '')) AS signals, count(*) FILTER (s <> '') AS n FROM u GROUP BY 1""",
    "js_trim_text": f"SELECT doc_id, true AS same, length({_TRIM.format(x='text')}) AS chars FROM documents",
    "technology_detect": f"WITH {_DEPS}, {_TECH} SELECT DISTINCT doc_id, technology, 'definite' AS confidence FROM deps JOIN tech ON package = name",
    "technology_evidence_group": f"WITH {_DEPS}, {_TECH} SELECT doc_id, technology, string_agg(name, ',' ORDER BY pos) AS evidence FROM deps JOIN tech ON package = name GROUP BY 1, 2",
    "example_id": f"""{_PROMOTED}, j AS (SELECT pull_number, string_agg('{{"category":' || to_json(category) || ',"confidence":' || to_json(confidence) || ',"severity":' || to_json(severity) || ',"summary":' || to_json(summary)
  || coalesce(',"reviewer_comment":' || to_json(reviewer_comment), '') || '}}', ',' ORDER BY pos) AS signals FROM props GROUP BY 1)
SELECT pull_number, sha256('{{"repository":' || to_json(repository) || ',"commitSha":' || to_json(source_url) || ',"changes":[{{"path":"a.ts","after":' || to_json(title) || '}}],"signals":[' || signals || ']}}') AS id FROM promoted JOIN j USING (pull_number)""",
    "engine_context": f"""WITH {_DEPS}, {_TECH}, e AS (SELECT doc_id, technology, min(pos) AS pos, string_agg('{{"kind":"manifest","source":"package.json","detail":"dependency: ' || name || '"}}', ',' ORDER BY pos) AS ev FROM deps JOIN tech ON package = name GROUP BY 1, 2)
SELECT doc_id, '{{' || CASE WHEN doc_id % 3 <> 0 THEN '"runtime":"nodejs",' ELSE '' END || '"technologies":[' || string_agg('{{"id":"' || technology || '","confidence":"definite","evidence":[' || ev || ']}}', ',' ORDER BY pos, technology) || ']}}' AS context FROM e GROUP BY 1""",
    "raw_to_example": f"""WITH {SQL["files"]}, own AS (SELECT *, doc_id // 4 AS n FROM files)
SELECT 'org/r' || n AS repository, 'sha' || n AS commit_sha, 'https://h/' || n AS source_url, CASE WHEN n % 2 = 0 THEN 'MIT' END AS license_spdx, CASE WHEN n % 2 = 0 THEN 'allowed' ELSE 'unknown' END AS license_status,
coalesce(first({_LANG} ORDER BY doc_id) FILTER ({_LANG} IS NOT NULL), 'javascript') AS language, coalesce(string_agg(path || ':' || before || ':' || sha256(after), ',' ORDER BY doc_id) FILTER (before IS NOT NULL AND after IS NOT NULL), '') AS changes, 'bug/s ' || n AS signals
FROM own GROUP BY n""",
    "dependency_merge": f"WITH {_DEPS} SELECT doc_id, string_agg(name, ',' ORDER BY pos) AS names, string_agg(v, ',' ORDER BY pos) AS versions, bool_or(name = 'typescript') AS typescript FROM deps GROUP BY 1",
}
