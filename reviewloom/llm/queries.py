"""Registered queries of the training-data operators, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.llm import chat_format, decontamination, license_scan, line_dedup, merkle, packing, quality_classifier, quality_rules, sharding, simhash, suffix_tree, url_filters, whitening
from reviewloom.llm.shared import table

#: Rules of op10: host, path, verdict.
URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def op1_sharding(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf, "documents"), shards=8)


def graded_labels(spark: SparkSession, sf: str) -> DataFrame:
    grade = quality_classifier.quality_grade(F.col("quality"), F.col("toxic"))
    return table(spark, sf, "labels").select("doc_id", grade.alias("grade"))


def op2_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf, "documents"), graded_labels(spark, sf))


def op3_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf, "documents"), license_scan.known_digests(spark))


def op4_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    out = line_dedup.drop_recurring_lines(table(spark, sf, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", "n_lines", "n_dropped", "text")


def op5_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality_rules.apply_rules(table(spark, sf, "documents"))


def op6_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf, "documents"))


#: Conversation -1 of op7: what both turns say.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op7_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    both = F.array(*[F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(CONTROL_TEXT).alias("text")) for i, r in enumerate(("user", "assistant"))])
    return chat_format.digests(chat_format.format_conversations(turns.unionByName(spark.range(1).select(F.inline(both)))))


def op8_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    """Leaks of each document; item ids and scores in the order of the ids."""
    found = decontamination.find_leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select("doc_id", (F.size("leaks") > 0).alias("leaked"), F.transform("leaks", lambda x: x["item"]).alias("item_ids"), "leaks")


def op9_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf, "documents"), size=3, radius=2)


def op10_url_filters(spark: SparkSession, sf: str) -> DataFrame:
    return url_filters.judge_urls(table(spark, sf, "pages"), url_filters.rule_table(spark, URL_RULES))


def op11_merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return merkle.audit(table(spark, sf, "documents"))


def op12_suffix_tree(spark: SparkSession, sf: str) -> DataFrame:
    return suffix_tree.score(table(spark, sf, "documents"))


def op13_embedding_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.whiten(table(spark, sf, "embeddings"))


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_license_scan": op3_license_scan,
    "op4_line_dedup": op4_line_dedup,
    "op5_quality_rules": op5_quality_rules,
    "op6_packing": op6_packing,
    "op7_chat_format": op7_chat_format,
    "op8_decontamination": op8_decontamination,
    "op9_simhash": op9_simhash,
    "op10_url_filters": op10_url_filters,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_suffix_tree": op12_suffix_tree,
    "op13_embedding_whitening": op13_embedding_whitening,
}



def _canonical_sql(text: str) -> str:
    """The canonical form of :mod:`reviewloom.llm.license_scan` in DuckDB."""
    low = f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    low = f"regexp_replace({low}, '{license_scan.COPYRIGHT_LINE}', chr(10), 'g')"
    out = f"' ' || trim(regexp_replace({low}, '[^\\p{{L}}\\p{{N}}]+', '  ', 'g')) || ' '"
    for words, one in license_scan.SPELLINGS:
        out = f"replace({out}, ' {words.replace(' ', '  ')} ', ' {one.replace(' ', '  ')} ')"
    return f"trim(replace({out}, '  ', ' '))"


_KNOWN_SQL = ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in license_scan.KNOWN + license_scan.TEXTS)
_LONG_SQL = ", ".join(f"('{i}', '{d}')" for i, d, _ in license_scan.LONG_TEXTS)
_BETWEEN_SQL = license_scan.BETWEEN_PARAGRAPHS
_RULES_SQL = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)

ORACLES = {
    "op3_license_scan": f"""
WITH k AS (SELECT c, min(license) AS license FROM
  (SELECT license, sha256({_canonical_sql("body")}) AS c FROM (VALUES {_KNOWN_SQL}) v(license, body) UNION ALL FROM (VALUES {_LONG_SQL}) w(license, c)) GROUP BY c),
d AS (SELECT row_number() OVER () AS n, doc_id, text FROM documents),
t AS (SELECT n, k.license AS of_text FROM (SELECT n, sha256({_canonical_sql("text")}) AS c FROM d) x JOIN k USING (c)),
l AS (SELECT n, c, k.license FROM (SELECT n, sha256({_canonical_sql("line")}) AS c FROM (SELECT n, unnest(string_split(text, chr(10))) AS line FROM d WHERE contains(text, chr(10)))) x JOIN k USING (c)),
p AS (SELECT n, c, k.license FROM (SELECT n, sha256({_canonical_sql("part")}) AS c FROM
  (SELECT n, unnest(regexp_split_to_array(text, '{_BETWEEN_SQL}')) AS part FROM d WHERE regexp_matches(text, '{_BETWEEN_SQL}')) WHERE contains(part, chr(10))) x JOIN k USING (c)),
u AS (SELECT n, license FROM l UNION ALL SELECT n, license FROM p ANTI JOIN l USING (n, c)),
g AS (SELECT n, count(*) AS n_lines, string_agg(DISTINCT license, ';' ORDER BY license) AS of_lines FROM u GROUP BY n)
SELECT doc_id, coalesce(of_text, of_lines) AS license, CASE WHEN of_text IS NOT NULL THEN 'text' WHEN n_lines > 0 THEN 'line' END AS scope,
  CASE WHEN of_text IS NOT NULL THEN 1 ELSE coalesce(n_lines, 0) END::BIGINT AS n_notices
FROM d LEFT JOIN t USING (n) LEFT JOIN g USING (n)""",
    "op5_quality_rules": r"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT n, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, string_split(t, chr(10)) AS ls FROM d),
f AS (SELECT n, doc_id, t, ls, len(ws) AS n_words, list_sum(list_transform(ws, lambda x: length(x)))::BIGINT AS wc, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS full_lines FROM w),
g AS (SELECT n, unnest(range(1, len(ws) - 3)) AS i, ws FROM w WHERE len(ws) >= 5),
h AS (SELECT n, i, array_to_string(ws[i:i+4], ' ') AS win FROM g),
r AS (SELECT n, i FROM h QUALIFY count(*) OVER (PARTITION BY n, win) > 1),
c AS (SELECT n, count(DISTINCT i + k) AS n_repeat FROM r, range(0, 5) o(k) GROUP BY n),
m AS (SELECT doc_id, t, ls, full_lines AS fl, n_words::BIGINT AS n_words, coalesce(wc, 0) AS word_chars, n_symbols::BIGINT AS n_symbols,
  (len(full_lines) - len(list_distinct(full_lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat, 0)::BIGINT AS n_repeat_words FROM f LEFT JOIN c USING (n))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR n_symbols * 10 > n_words * 3 OR n_dup_lines * 10 > len(ls) * 3
    OR word_chars < n_words * 2 OR word_chars > n_words * 25 OR (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) * 100 > word_chars * 50
    OR (length(t) - length(regexp_replace(t, '[0-9]', '', 'g'))) * 100 > word_chars * 50
    OR len(list_filter(fl, lambda x: regexp_matches(x, '^[ \t]*[-*\x{2022}]'))) * 100 > len(fl) * 90
    OR len(list_filter(fl, lambda x: regexp_matches(x, '([.][.][.]|\x{2026})[ \t\r]*$'))) * 100 > len(fl) * 30
    OR regexp_matches(t, '[^\x20\x09-\x0D]{1000}')) AS kept FROM m""",
    "op10_url_filters": rf"""
WITH rules(rhost, rpath, rverdict) AS (VALUES {_RULES_SQL}),
u AS (SELECT row_number() OVER () AS n, page_id,
  translate(regexp_extract(coalesce(url, ''), '^[\s\S]*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '^[\s\S]*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
m AS (SELECT n, max(struct_pack(l := length(rhost) + length(rpath), h := length(rhost), r := rhost || rpath, v := rverdict)) AS b
  FROM u JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY n)
SELECT page_id, host, path, b.r AS rule, coalesce(b.v, 'allow') AS verdict FROM u LEFT JOIN m USING (n)""",
}
