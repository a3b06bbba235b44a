"""Queries: dedup, split, checksum manifests and contract checks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from reviewloom.functions.contract import violations
from reviewloom.functions.hashing import canonical_checksum, hash_bucket, set_checksum, set_checksum_tree, text_checksum
from reviewloom.functions.vocabulary import ADAPTER_TYPES, CONFIDENCES, LANGUAGES, MODEL_STATUSES, SEVERITIES, SOURCE_TYPES, literal_rows
from reviewloom.operators import curate, deliveries, validate
from reviewloom.sources.scratch import new_path, tables_made, written
from reviewloom.sources.tables import table

SEED = 42


def _documents(spark, sf):
    return table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", "lang", text_checksum(F.col("text")).alias("checksum"))


def _unique(spark, sf):
    return curate.dedup_exact(_documents(spark, sf).select("checksum"))


def curate_manifest(spark, sf):
    """The flagship: dedup, split and checksum of the corpus."""
    return curate.split_manifest(_unique(spark, sf).withColumn("split", curate.split_of(F.col("checksum"), SEED)))


def split_checksum_empty_bucket(spark, sf):
    """With no validation share, val is there with the digest of nothing."""
    return curate.split_manifest(_unique(spark, sf).withColumn("split", curate.split_of(F.col("checksum"), SEED, 0.0, 0.2)))


def dedup_exact(spark, sf):
    return _unique(spark, sf)


def dedup_second_delivery(spark, sf):
    """All documents as two deliveries; the second, documents of odd ids, against what is kept of the first."""
    rows = _documents(spark, sf).select("checksum", F.coalesce(F.pmod("doc_id", F.lit(2)), F.lit(0)).alias("odd"))
    first = curate.dedup_exact(rows.where("odd = 0").select("checksum"))
    kept = deliveries.keep(first, f"kept_{uuid.uuid4().hex}", new_path(spark, "kept"))
    known = written(deliveries.checksum_filter(kept), "kept-filter")
    new = deliveries.new_records(rows.where("odd = 1").select("checksum"), kept, known)
    return kept.select("checksum", F.lit(1).alias("delivery")).unionByName(new.select("checksum", F.lit(2).alias("delivery")))


def dedup_stats(spark, sf):
    groups = _documents(spark, sf).groupBy("checksum").agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.sum("n").cast("long").alias("n_rows"), F.count(F.lit(1)).alias("n_unique"), F.max("n").alias("largest"), F.count_if(F.col("n") > 1).alias("n_groups"))


def split_assign(spark, sf):
    return _unique(spark, sf).select("checksum", hash_bucket(F.col("checksum"), SEED).alias("bucket"), curate.split_of(F.col("checksum"), SEED).alias("split"))


def split_counts_by_lang(spark, sf):
    rows = _documents(spark, sf).select("lang", "checksum").distinct().withColumn("split", curate.split_of(F.col("checksum"), SEED))
    return rows.groupBy("lang", "split").agg(F.count(F.lit(1)).alias("n"))


def split_seed_drift(spark, sf):
    c = F.col("checksum")
    rows = _unique(spark, sf).select(curate.split_of(c, 1).alias("seed1"), curate.split_of(c, 2).alias("seed2"))
    return rows.groupBy("seed1", "seed2").agg(F.count(F.lit(1)).alias("n"))


def source_checksum(spark, sf):
    rows = _unique(spark, sf).select(F.lit("all").alias("scope"), "checksum")
    return set_checksum(rows, ["scope"], "checksum", "set_checksum")


def source_checksum_tree(spark, sf):
    """The two-level digest for sets of any size."""
    rows = _unique(spark, sf).select(F.lit("all").alias("scope"), "checksum")
    return set_checksum_tree(rows, ["scope"], "checksum", "set_checksum", (3,))


def _records(spark, sf):
    """Documents as training rows with planted faults."""
    k = F.col("doc_id")
    pick = lambda values, step: F.get(F.array(*map(F.lit, values)), (k % (len(values) + step)).cast("int"))
    return table(spark, sf, "documents").select(
        "doc_id",
        F.when(k % 11 == 0, "rust").otherwise(pick(LANGUAGES, 1)).alias("language"),
        F.when(k % 17 == 0, "").otherwise(F.col("text")).alias("code"),
        F.when(k % 13 != 0, "bug").alias("category"),
        F.when(k % 19 == 0, "sure").otherwise(pick(CONFIDENCES, 0)).alias("confidence"),
        ((k % 30) / 25.0).alias("confidence_score"),
        F.when(k % 23 != 0, pick(SEVERITIES, 0)).alias("severity"),
        F.lit("s").alias("summary"),
        F.when(k % 29 == 0, "blog").otherwise(pick(SOURCE_TYPES, 0)).alias("source_type"),
        F.lit("u").alias("source_url"),
    )


def reject_report(spark, sf):
    return validate.rejects(_records(spark, sf), "doc_id")


def _kind(spark, sf, kind):
    return reject_report(spark, sf).where(F.col("message").endswith(kind)).groupBy("message").agg(F.count(F.lit(1)).alias("n"))


def validate_required(spark, sf):
    return _kind(spark, sf, "required")


def validate_enums(spark, sf):
    return _kind(spark, sf, "allowed values")


def validate_ranges(spark, sf):
    return reject_report(spark, sf).where("message LIKE 'code%empty' OR message LIKE '%0 to 1'").groupBy("message").agg(F.count(F.lit(1)).alias("n"))


def manifest_validate(spark, sf):
    rows = table(spark, sf, "documents").select(
        "doc_id",
        F.when(F.col("doc_id") % 5 != 0, "set").otherwise("").alias("dataset_id"),
        F.when(F.col("doc_id") % 4 == 0, "1.2").otherwise("1.2.3").alias("version"),
        F.when(F.col("doc_id") % 3 != 0, F.col("doc_id")).alias("split_seed"),
        (F.col("doc_id") % 7 - 1).alias("n_train"),
        F.lit(0).alias("n_val"),
        F.lit(0).alias("n_test"),
    )
    return rows.select("doc_id", F.array_join(validate.manifest_errors(), ";").alias("errors"))


def _pick(values, by):
    return F.get(F.array(*map(F.lit, values)), (by % len(values)).cast("int"))


def _registry(spark, sf):
    """Documents as entries of a model registry, with planted faults."""
    k = F.col("doc_id")
    return table(spark, sf, "documents").select(
        F.concat(F.coalesce("source", F.lit("")), F.lit("/"), k.cast("string")).alias("path"),
        (k % 9 != 0).alias("found"),
        F.when(k % 7 == 0, "done").when(k % 8 != 0, _pick(MODEL_STATUSES, k)).alias("status"),
        F.when(k % 6 == 0, "1.0").otherwise("1.2.3").alias("version"),
        F.when(k % 5 == 0, "prefix").when(k % 4 != 0, _pick(ADAPTER_TYPES, k)).alias("adapter_type"),
        F.when(k % 3 != 0, F.col("n_chars") % 20).cast("int").alias("rank"),
        F.when(k % 2 == 0, F.array(F.concat(F.lit("proj_"), F.coalesce("lang", F.lit(""))))).alias("targets"),
    )


def registry_validate(spark, sf):
    return _registry(spark, sf).select("path", F.array_join(validate.model_errors(), ";").alias("errors"))


def training_config(spark, sf):
    config = validate.training_config(F.col("rank"), F.col("targets"))
    return _registry(spark, sf).select("path", config.alias("c")).select("path", "c.rank", F.array_join("c.targets", ",").alias("targets"))


def canonical_json_checksums(spark, sf):
    """Canonical checksums of raw JSON lines; key order and spacing do not count."""
    raw = F.explode(F.array(F.concat(F.lit('{"b": 1.50, "a": "'), F.col("lang"), F.lit('"}')), F.concat(F.lit('{"a":"'), F.col("lang"), F.lit('","b":1.5}'))))
    rows = table(spark, sf, "documents").select("lang", raw.alias("raw"))
    return rows.select("lang", canonical_checksum(F.col("raw")).alias("checksum")).groupBy("lang", "checksum").agg(F.count(F.lit(1)).alias("n"))


#: The canonical JSON of a training example of the check, around its code.
_EXAMPLE = ('{"code":"', '","finding":{"category":"bug","confidence":"likely","severity":"low","summary":"s"},"language":"python","provenance":{"source_type":"commit","source_url":"u"}}')


def curate_end_to_end(spark, sf):
    """Documents written as a JSONL file of training examples, spaced and with keys in another order for every second, then curated."""
    code = F.sha2("text", 256)
    plain = F.concat(F.lit(_EXAMPLE[0]), code, F.lit(_EXAMPLE[1]))
    other = F.concat(F.lit(' {"language": "python", "provenance": {"source_url": "u", "source_type": "commit"}, "finding": {"summary": "s", "severity": "low", "confidence": "likely", "category": "bug"}, "code": "'), code, F.lit('"} \r'))
    rows = table(spark, sf, "documents").where("text IS NOT NULL").select(F.when(F.col("doc_id") % 2 == 0, plain).otherwise(other).alias("value"))
    with tables_made(spark) as drop_but:
        path = new_path(spark, "examples")
        rows.write.text(path)
        _, made = curate.curate(spark, path, "set", "1.0.0", SEED)
        drop_but(())
    lines = [(s, made["counts"][s], made["checksums"][s], made["sourceExamplesChecksum"], made["splitSeed"]) for s in curate.SPLITS]
    return literal_rows(spark, ("split", "n", "checksum", "source", "seed"), lines).select("split", F.col("n").cast("long").alias("n"), "checksum", "source", F.col("seed").cast("long").alias("seed"))


#: A contract for documents as JSON records.
DOCUMENT = {
    "type": "object",
    "additionalProperties": False,
    "required": ["doc_id", "text", "source"],
    "properties": {
        "doc_id": {"type": "integer", "minimum": 20},
        "text": {"type": "string", "minLength": 400},
        "lang": {"enum": ["en", "de", None]},
        "source": {"type": "string", "pattern": "[a-m]$"},
        "n_chars": {"type": ["integer", "null"], "maximum": 2000},
        "labels": {"type": "array", "minItems": 2, "items": {"type": "object", "properties": {"name": {"const": "size"}, "value": {"type": "integer"}}}},
    },
}


def contract_errors(spark, sf):
    """All messages of every document as a JSON record, with more or fewer keys and wrong kinds in some; no Python in the plan."""
    n = F.col("doc_id")
    label = F.struct(F.lit("size").alias("name"), F.when(n % 5 == 0, F.concat(F.lit("n"), n.cast("string"))).alias("value"))
    other = F.struct(F.when(n % 4 == 0, "age").otherwise("size").alias("name"), F.lit(None).cast("string").alias("value"))
    cells = F.struct(n.alias("doc_id"), "text", "lang", F.when(n % 7 != 0, F.col("source")).alias("source"), "n_chars", F.when(n % 9 == 0, True).alias("extra"), F.when(n % 3 == 0, F.array(label)).otherwise(F.array(label, other)).alias("labels"))
    raw = F.concat(F.to_json(cells), F.when(n % 31 == 0, "}").otherwise(" "))
    checked = table(spark, sf, "documents").select("doc_id", violations(raw, DOCUMENT).alias("errors"))
    return checked.select("doc_id", F.size("errors").cast("long").alias("n_errors"), F.array_join("errors", "; ").alias("errors"))


QUERIES = {
    f.__name__: f
    for f in (
        curate_manifest, split_checksum_empty_bucket, dedup_exact, dedup_second_delivery, dedup_stats, split_assign, split_counts_by_lang, split_seed_drift, source_checksum, source_checksum_tree,
        reject_report, validate_required, validate_enums, validate_ranges, manifest_validate, registry_validate, training_config, canonical_json_checksums, curate_end_to_end,
        contract_errors,
    )
}

_U = "u AS (SELECT DISTINCT sha256(text) AS checksum FROM documents WHERE text IS NOT NULL)"
_BUCKET = "('0x' || substr(sha256('{seed}:' || checksum), 1, 8))::BIGINT"


def split_sql(seed: int = SEED, val: float = 0.1, test: float = 0.1) -> str:
    lo, hi = curate.split_bounds(val, test)
    b = _BUCKET.format(seed=seed)
    return f"CASE WHEN {b} < {lo} THEN 'val' WHEN {b} < {hi} THEN 'test' ELSE 'train' END"


def _tree_sql(members: str, by: str, name: str) -> str:
    """The set digests of ``members`` (by, checksum) as a table (by, n, checksum) called ``name``."""
    return f"""{name}_6 AS (SELECT {by}, substr(checksum, 1, 6) AS k6, count(*) AS n, sha256(string_agg(checksum, '' ORDER BY checksum)) AS d FROM {members} GROUP BY {by}, substr(checksum, 1, 6)),
{name}_3 AS (SELECT {by}, substr(k6, 1, 3) AS k3, sum(n) AS n, sha256(string_agg(d, '' ORDER BY k6)) AS d FROM {name}_6 GROUP BY {by}, substr(k6, 1, 3)),
{name} AS (SELECT {by}, sum(n)::BIGINT AS n, sha256(string_agg(d, '' ORDER BY k3)) AS checksum FROM {name}_3 GROUP BY {by})"""


def _manifest_sql(split: str) -> str:
    return f"""
WITH {_U}, s AS (SELECT checksum, {split} AS split FROM u),
{_tree_sql("s", "split", "g")}
SELECT x.split, coalesce(g.n, 0)::BIGINT AS n, coalesce(g.checksum, sha256('')) AS checksum
FROM (VALUES ('train'), ('val'), ('test')) x(split) LEFT JOIN g ON g.split = x.split"""


def _pick_sql(values, step):
    return f"([{', '.join(repr(v) for v in values)}])[(doc_id % {len(values) + step} + 1)::INT]"


def _in(values):
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_RECORDS = f"""r AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'rust' ELSE {_pick_sql(LANGUAGES, 1)} END AS language, CASE WHEN doc_id % 17 = 0 THEN '' ELSE text END AS code,
CASE WHEN doc_id % 13 <> 0 THEN 'bug' END AS category, CASE WHEN doc_id % 19 = 0 THEN 'sure' ELSE {_pick_sql(CONFIDENCES, 0)} END AS confidence, (doc_id % 30) / 25.0 AS score,
CASE WHEN doc_id % 23 <> 0 THEN {_pick_sql(SEVERITIES, 0)} END AS severity, CASE WHEN doc_id % 29 = 0 THEN 'blog' ELSE {_pick_sql(SOURCE_TYPES, 0)} END AS source_type FROM documents),
m AS (SELECT doc_id, unnest(list_filter([CASE WHEN language IS NULL THEN 'language: required' END, CASE WHEN code IS NULL THEN 'code: required' END, CASE WHEN category IS NULL THEN 'category: required' END,
CASE WHEN severity IS NULL THEN 'severity: required' END, CASE WHEN language NOT IN {_in(LANGUAGES)} THEN 'language: not one of the allowed values' END, CASE WHEN confidence NOT IN {_in(CONFIDENCES)} THEN 'confidence: not one of the allowed values' END,
CASE WHEN severity NOT IN {_in(SEVERITIES)} THEN 'severity: not one of the allowed values' END, CASE WHEN source_type NOT IN {_in(SOURCE_TYPES)} THEN 'source_type: not one of the allowed values' END,
CASE WHEN code = '' THEN 'code: empty' END, CASE WHEN score < 0 OR score > 1 THEN 'confidence_score: outside of 0 to 1' END], lambda x: x IS NOT NULL)) AS message FROM r)"""

_REGISTRY = f"""g AS (SELECT coalesce(source, '') || '/' || doc_id AS path, doc_id % 9 <> 0 AS found, CASE WHEN doc_id % 7 = 0 THEN 'done' WHEN doc_id % 8 <> 0 THEN {_pick_sql(MODEL_STATUSES, 0)} END AS status,
CASE WHEN doc_id % 6 = 0 THEN '1.0' ELSE '1.2.3' END AS version, CASE WHEN doc_id % 5 = 0 THEN 'prefix' WHEN doc_id % 4 <> 0 THEN {_pick_sql(ADAPTER_TYPES, 0)} END AS adapter_type,
CASE WHEN doc_id % 3 <> 0 THEN n_chars % 20 END AS rank, CASE WHEN doc_id % 2 = 0 THEN 'proj_' || coalesce(lang, '') END AS targets FROM documents)"""

ORACLES = {
    "curate_manifest": _manifest_sql(split_sql()),
    "split_checksum_empty_bucket": _manifest_sql(split_sql(SEED, 0.0, 0.2)),
    "dedup_exact": f"WITH {_U} SELECT checksum FROM u",
    "dedup_second_delivery": "SELECT sha256(text) AS checksum, min(CASE WHEN doc_id % 2 = 1 THEN 2 ELSE 1 END)::INT AS delivery FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "dedup_stats": "WITH g AS (SELECT text, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY text) SELECT sum(n)::BIGINT AS n_rows, count(*) AS n_unique, max(n) AS largest, count(*) FILTER (n > 1) AS n_groups FROM g",
    "split_assign": f"WITH {_U} SELECT checksum, {_BUCKET.format(seed=SEED)} AS bucket, {split_sql()} AS split FROM u",
    "split_counts_by_lang": f"WITH l AS (SELECT DISTINCT lang, sha256(text) AS checksum FROM documents WHERE text IS NOT NULL) SELECT lang, {split_sql()} AS split, count(*) AS n FROM l GROUP BY ALL",
    "split_seed_drift": f"WITH {_U} SELECT {split_sql(1)} AS seed1, {split_sql(2)} AS seed2, count(*) AS n FROM u GROUP BY ALL",
    "source_checksum": f"WITH {_U} SELECT 'all' AS scope, count(*) AS n, sha256(string_agg(checksum, '' ORDER BY checksum)) AS set_checksum FROM u",
    "source_checksum_tree": f"WITH {_U}, l AS (SELECT substr(checksum, 1, 3) AS leaf, count(*) AS n, sha256(string_agg(checksum, '' ORDER BY checksum)) AS d FROM u GROUP BY 1) SELECT 'all' AS scope, sum(n)::BIGINT AS n, sha256(string_agg(d, '' ORDER BY leaf)) AS set_checksum FROM l",
    "reject_report": f"WITH {_RECORDS} SELECT doc_id, message FROM m",
    "validate_required": f"WITH {_RECORDS} SELECT message, count(*) AS n FROM m WHERE message LIKE '%required' GROUP BY 1",
    "validate_enums": f"WITH {_RECORDS} SELECT message, count(*) AS n FROM m WHERE message LIKE '%allowed values' GROUP BY 1",
    "validate_ranges": f"WITH {_RECORDS} SELECT message, count(*) AS n FROM m WHERE message LIKE 'code%empty' OR message LIKE '%0 to 1' GROUP BY 1",
    "manifest_validate": """SELECT doc_id, array_to_string(list_filter([CASE WHEN doc_id % 5 = 0 THEN 'dataset_id: required' END, CASE WHEN doc_id % 4 = 0 THEN 'version: not a version' END,
CASE WHEN doc_id % 3 = 0 THEN 'split_seed: required' END, CASE WHEN doc_id % 7 = 0 THEN 'n_train: negative or missing' END], lambda x: x IS NOT NULL), ';') AS errors FROM documents""",
    "registry_validate": rf"""WITH {_REGISTRY} SELECT path, CASE WHEN NOT found THEN 'file is missing' ELSE array_to_string(list_filter([CASE WHEN coalesce(status, '') NOT IN {_in(MODEL_STATUSES)} THEN 'status: not one of the allowed values' END,
CASE WHEN NOT regexp_matches(coalesce(version, ''), '^\d+\.\d+\.\d+$') THEN 'version: not a version' END, CASE WHEN adapter_type NOT IN {_in(ADAPTER_TYPES)} THEN 'adapter type: not one of the allowed values' END, CASE WHEN rank < 1 THEN 'rank: below 1' END], lambda x: x IS NOT NULL), ';') END AS errors FROM g""",
    "canonical_json_checksums": "SELECT lang, sha256('{\"a\":\"' || lang || '\",\"b\":1.5}') AS checksum, 2 * count(*) AS n FROM documents GROUP BY 1",
    "curate_end_to_end": f"""WITH e AS (SELECT DISTINCT sha256('{_EXAMPLE[0]}' || sha256(text) || '{_EXAMPLE[1]}') AS checksum FROM documents WHERE text IS NOT NULL), s AS (SELECT checksum, {split_sql()} AS split FROM e),
{_tree_sql("s", "split", "g")}, a AS (SELECT 'all' AS scope, checksum FROM e),
{_tree_sql("a", "scope", "w")}
SELECT x.split, coalesce(g.n, 0)::BIGINT AS n, coalesce(g.checksum, sha256('')) AS checksum, coalesce(w.checksum, sha256('')) AS source, {SEED}::BIGINT AS seed FROM (VALUES ('train'), ('val'), ('test')) x(split) LEFT JOIN g ON g.split = x.split LEFT JOIN w ON true""",
    "contract_errors": """WITH e AS (SELECT doc_id, CASE WHEN doc_id IS NOT NULL AND doc_id % 31 = 0 THEN ['record: invalid JSON'] ELSE list_filter([
CASE WHEN doc_id IS NULL THEN 'doc_id: required' END, CASE WHEN text IS NULL THEN 'text: required' END, CASE WHEN source IS NULL OR doc_id % 7 = 0 OR doc_id IS NULL THEN 'source: required' END,
CASE WHEN doc_id < 20 THEN 'doc_id: below 20' END, CASE WHEN text = '' THEN 'text: empty' WHEN length(text) < 400 THEN 'text: too short' END, CASE WHEN lang NOT IN ('en', 'de') THEN 'lang: not one of the allowed values' END,
CASE WHEN doc_id % 7 <> 0 AND NOT regexp_matches(source, '[a-m]$') THEN 'source: does not match the pattern' END, CASE WHEN n_chars > 2000 THEN 'n_chars: above 2000' END,
CASE WHEN doc_id % 3 = 0 THEN 'labels: too few items' END, CASE WHEN doc_id % 5 = 0 THEN 'labels[0].value: not of type integer' END,
CASE WHEN doc_id % 3 <> 0 AND doc_id % 4 = 0 THEN 'labels[1].name: not the fixed value' END, CASE WHEN doc_id % 9 = 0 THEN 'extra: unknown key' END], lambda x: x IS NOT NULL) END AS errors FROM documents)
SELECT doc_id, len(errors)::BIGINT AS n_errors, array_to_string(errors, '; ') AS errors FROM e""",
    "training_config": f"WITH {_REGISTRY} SELECT path, coalesce(rank, 16)::INT AS rank, coalesce(targets, 'q_proj,v_proj') AS targets FROM g",
}
