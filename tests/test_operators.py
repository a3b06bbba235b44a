"""Operator behaviour on small literals, and properties of dedup and split."""

import hashlib
import json
import random
import re
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import Observation
from pyspark.sql import functions as F

from reviewloom.functions import contract, hashing, text
from reviewloom.operators import curate, ecosystem, evaluate, examples, ingest, label, project, training, validate


def one(spark, column, **values):
    return spark.range(1).select(*[v.alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


def lit(v):
    return F.lit(v)


def test_canonical_checksum_is_pythons(spark):
    lines = ['{"b": 1e-7, "a": "é\\u2028", "c": [1, {"z": null, "y": 1.0}]}', "[]", "oops", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, raw string")
    got = [r.c for r in df.select("i", hashing.canonical_checksum(F.col("raw")).alias("c")).orderBy("i").collect()]
    want = [hashlib.sha256(json.dumps(json.loads(x), sort_keys=True, separators=(",", ":")).encode()).hexdigest() for x in lines[:2]]
    assert got == [*want, None, None]


def test_split_is_a_partition_that_rows_and_layout_do_not_change(spark):
    df = spark.range(200).select(F.sha2(F.col("id").cast("string"), 256).alias("checksum"))
    split = lambda d, seed=42: {r[0]: r[1] for r in d.select("checksum", curate.split_of(F.col("checksum"), seed)).collect()}
    first = split(df)
    assert first == split(df.repartition(7).orderBy(F.desc("checksum"))) and set(first.values()) == {"train", "val", "test"}
    assert split(df, 1) != split(df, 2)
    bucket = lambda c: int.from_bytes(hashlib.sha256(f"42:{c}".encode()).digest()[:4], "big")
    assert all(first[c] == ("val" if bucket(c) < 429496729 else "test" if bucket(c) < 858993459 else "train") for c in first)
    with pytest.raises(ValueError):
        curate.split_bounds(0.5, 0.5)


def test_dedup_is_idempotent_and_manifest_counts(spark):
    df = spark.createDataFrame([("a",), ("b",), ("a",)], "checksum string")
    once = curate.dedup_exact(df)
    assert once.count() == curate.dedup_exact(once).count() == 2
    rows = {r.split: r for r in curate.split_manifest(once.withColumn("split", F.lit("val")), in_order=True).collect()}
    assert rows["val"].n == 2 and rows["val"].checksum == hashlib.sha256(b"ab").hexdigest()
    assert rows["train"].n == 0 and rows["train"].checksum == hashlib.sha256(b"").hexdigest()
    rows = {r.split: r for r in curate.split_manifest(once.withColumn("split", F.lit("val"))).collect()}
    assert rows["val"].n == 2 and rows["val"].checksum == tree_digest("ab")
    assert rows["train"].n == 0 and rows["train"].checksum == hashlib.sha256(b"").hexdigest()


def tree_digest(members, widths=(6, 3)):
    nodes = [(m, m) for m in members]
    for w in (*widths, 0):
        groups = {}
        for key, d in sorted(nodes):
            groups.setdefault(key[:w], []).append(d)
        nodes = [(k, hashlib.sha256("".join(ds).encode()).hexdigest()) for k, ds in groups.items()]
    return nodes[0][1] if nodes else hashlib.sha256(b"").hexdigest()


def test_set_checksum_tree(spark):
    rng = random.Random(3)
    # Members that share three, six and all digits but the last, and some twice.
    sums = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(2000)]
    sums += ["abc" + c[3:] for c in sums[:300]] + ["abcdef" + c[6:] for c in sums[:200]] + ["f" * 63 + c[0] for c in sums[:9]]
    rows = [(rng.choice(["a", "b", None]), c) for c in sums]
    df = spark.createDataFrame(rows, "part string, c string")
    for parts in (1, 7):
        got = {r.part: (r.n, r.d) for r in hashing.set_checksum_tree(df.repartition(parts), ["part"], "c", "d").collect()}
        assert got == {p: (len(mine), tree_digest(mine)) for p in ("a", "b", None) for mine in [[c for q, c in rows if q == p]]}
    whole = hashing.set_checksum_tree(df, [], "c", "d").first()
    assert (whole.n, whole.d) == (len(sums), tree_digest(sums))
    assert hashing.set_checksum_tree(df, [], "c", "d", (3,)).first().d == tree_digest(sums, (3,))
    none = hashing.set_checksum_tree(df.limit(0), [], "c", "d").first()
    assert (none.n, none.d) == (0, tree_digest([])) and hashing.set_checksum_tree(df.limit(0), ["part"], "c", "d").collect() == []


def test_trims(spark):
    s = "﻿  a \x1c　"
    assert one(spark, text.js_trim(lit(s))) == "a \x1c" and one(spark, text.py_strip(lit(s))) == s.strip()
    assert one(spark, text.truncate(lit("x" * 300))) == "x" * 300 and one(spark, text.truncate(lit("x" * 301))) == "x" * 300 + "..."


def test_generated_text(spark):
    got = one(spark, text.parse_finding(lit(" Category : a\nseverity: x: y \nnope\nCATEGORY:\nother: 1\x85summary: z")))
    assert (got.category, got.severity, got.confidence, got.summary) == ("", "x: y", None, "z")


def test_proposals(spark):
    comments = F.array(*[F.struct(lit(p).alias("path"), lit(b).alias("body")) for p, b in (("a.ts", "Latest FIX"), ("b.ts", "Latest FIX"), ("", "x" * 301 + "perf"))])
    got = one(spark, label.proposals(lit("fix a bug"), comments))
    assert [(p.category, p.confidence, p.rule) for p in got] == [
        ("bug", "possible", "title-keyword:fix"),
        ("bug", "likely", "review-comment-keyword:fix"),
        ("testing", "likely", "review-comment-keyword:test"),
        ("performance", "likely", "review-comment-keyword:perf"),
    ]
    assert got[1].summary.endswith(" in a.ts.") and got[3].summary.endswith("finding.") and got[3].evidence == "x" * 300 + "..."
    assert one(spark, label.proposals(lit("a word"), F.array().cast("array<struct<path:string,body:string>>"))) == []


def test_promotion_keeps_raw_copies_and_takes_the_last_review(spark):
    raw = spark.createDataFrame([("o/r", 7, "t"), ("o/r", 7, "u"), ("o/r", 8, "v"), ("o/r", 9, "w")], "repository string, pull_number long, title string")
    p = "array<struct<category:string,rule:string,evidence:string>>"
    review = spark.createDataFrame([("o/r", "7", [("a", "r", "e")], 1), ("o/r", "7", [("b", "r", "e"), ("c", "r", "e")], 2), ("o/r", "8", [], 3)], f"repository string, pull_number string, proposals {p}, ord long")
    out = label.promote(raw, review).orderBy("title").collect()
    assert [(r.title, [s.asDict() for s in r.signals]) for r in out] == [(t, [{"category": "b"}, {"category": "c"}]) for t in "tu"]
    assert [r.title for r in label.not_promoted(raw, review).collect()] == ["w"]


def test_licences_and_languages(spark):
    status = lambda s: one(spark, ingest.license_status(F.lit(s).cast("string")))
    assert [status(s) for s in ("MIT", "ISC", "GPL-3.0", "", None)] == ["allowed", "allowed", "review-required", "unknown", "unknown"]
    lang = lambda p: one(spark, ingest.language_of(lit(p)))
    assert [lang(p) for p in ("a.mts", "a.jsx", "b.pyi", "x.TS", "a.ts.md")] == ["typescript", "javascript", "python", None, None]


def test_normalisation_and_projection(spark):
    assert one(spark, project.unique_strings(F.array(*map(lit, (" a", "b", "a ", " "))))) == ["a", "b"]
    change = lambda p, a: F.struct(lit(p).alias("path"), F.lit(a).cast("string").alias("after"))
    assert one(spark, project.render_changes(F.array(change("a.py", "x"), change("b", ""), change("c", "y")))) == "// a.py\nx\n\n// c\ny"


def test_dependencies(spark):
    pairs = lambda **kv: F.create_map(*[lit(x) for k, v in kv.items() for x in (k, v)])
    got = one(spark, ecosystem.merged_dependencies(pairs(a="1", b="2"), pairs(b="3", c="4")))
    assert list(got.items()) == [("a", "1"), ("b", "3"), ("c", "4")]


@pytest.mark.parametrize(
    ("pairs", "want"),
    [
        ([("security", "security"), ("bug", "bug")], {"security": (1, 0, 0), "bug": (1, 0, 0)}),
        ([("security", "bug")], {"security": (0, 0, 1), "bug": (0, 1, 0)}),
        ([("security", None)], {"security": (0, 0, 1)}),
        ([("security", "")], {"security": (0, 0, 1), "": (0, 1, 0)}),
        ([], {}),
    ],
)
def test_confusion(spark, pairs, want):
    counts = evaluate.confusion_counts(spark.createDataFrame(pairs, "expected string, predicted string"))
    assert {r.category: (r.tp, r.fp, r.fn) for r in counts.collect()} == want
    macro = evaluate.macro_f1(evaluate.category_scores(counts)).first()[0]
    assert macro == (1.0 if pairs and all(a == b for a, b in pairs) else 0.0)


def test_gate_and_lengths(spark):
    gate = lambda now, before, floor=0.0: one(spark, evaluate.regression_gate(lit(now), F.lit(before).cast("double"), floor))
    assert [gate(0.5, 0.8), gate(0.8, 0.5), gate(0.4, None), gate(0.1, None, 0.3)] == [False, True, True, False]
    a, b = spark.createDataFrame([(1, "x")], "row_id long, predicted string"), spark.createDataFrame([(1, "x"), (2, "y")], "row_id long, expected string")
    assert evaluate.paired(a, b.where("row_id = 1")).count() == 1
    with pytest.raises(Exception, match="differ in length"):
        evaluate.paired(a, b).collect()


def test_validation_fails_at_the_first_row(spark):
    cols = "row_id long, language string, code string, category string, confidence string, confidence_score double, severity string, summary string, source_type string, source_url string"
    good = (1, "python", "x", "bug", "likely", 0.5, "low", "s", "commit", "u")
    assert validate.valid_or_fail(spark.createDataFrame([good], cols), "row_id").count() == 1
    with pytest.raises(ValueError, match="at 2: severity: required"):
        validate.valid_or_fail(spark.createDataFrame([good, (3, *good[1:6], "odd", *good[7:]), (2, *good[1:6], None, *good[7:])], cols), "row_id")


def test_pushdown_and_pruning(spark):
    from reviewloom.plans.curation import QUERIES

    plan = QUERIES["split_assign"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<text:string>" in plan and "IsNotNull(text)" in plan


def test_first_of_each_keeps_order(spark):
    items = F.array(*[F.struct(F.lit(a).cast("string").alias("a"), F.lit(b).alias("b")) for a, b in (("x", 1), (None, 2), ("y", 3), ("x", 4), (None, 5), ("w", 6))])
    got = one(spark, label._first_of_each(items, lambda i: i["a"]))
    assert [(r.a, r.b) for r in got] == [("x", 1), (None, 2), ("y", 3), ("w", 6)]
    plan = spark.range(1).select(label._first_of_each(items, lambda i: i["a"]))
    assert plan.count() == 1 and one(spark, label._first_of_each(F.array().cast("array<string>"), lambda i: i)) == []


def test_truncation_counts_utf16_units(spark):
    cut = lambda s, n: one(spark, text.truncate(lit(s), n))
    assert [cut("\U0001f600ab", 4), cut("\U0001f600abc", 4), cut("ab\U0001f600", 3), cut("é" * 4, 4), cut("é" * 5, 4), cut("", 1)] == ["\U0001f600ab", "\U0001f600ab...", "ab\ufffd...", "é" * 4, "é" * 4 + "...", ""]


def test_examples(spark):
    file = lambda p, b, a: (p, "modified", 1, 2, b, a)
    kind = (
        "host string, repository string, merge_commit_sha string, source_url string, spdx string, license_status string, collected_at string, "
        "files array<struct<path:string,status:string,additions:long,deletions:long,before:string,after:string>>, "
        "signals array<struct<category:string,confidence:string,severity:string,summary:string,reviewer_comment:string>>"
    )
    signals = [("bug", "likely", "low", " s ", " "), ("bug", "likely", "high", "s", "c"), ("bug", "likely", "low", " ", None)]
    rows = [("h", " o/r\t", "sha", " u ", "", "unknown", "t", [file("a.md", "x", "y"), file("b.py", None, "z"), file("c.ts", "", "w")], signals)]
    made = examples.to_examples(spark.createDataFrame(rows, kind))
    r = made.first()
    assert r.language == "python" and [(c.path, c.before, c.after) for c in r.changes] == [("a.md", "x", "y"), ("c.ts", "", "w")]
    assert r.provenance.license_spdx is None and r.frameworks == [] and len(r.id) == 64
    n = examples.normalize_examples(made).first()
    assert n.id == r.id and (n.provenance.repository, n.provenance.source_url, n.provenance.commit_sha) == ("o/r", "u", "sha")
    assert [tuple(s) for s in n.signals] == [("bug", "likely", "low", "s", None)]


def test_counts_on_the_way(spark):
    seen = Observation("proposals")
    df = label.counted(spark.range(10), seen, even=F.col("id") % 2 == 0, none=F.lit(None).cast("boolean"))
    assert df.count() == 10 and seen.get == {"total": 10, "even": 5, "none": 0}


def said(value, rule, at=""):
    """What a contract says of a plain value: the rules read one after the other."""
    kinds = {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null", int: "number", float: "number"}
    kind, place = kinds[type(value)], at or "record"
    allowed = rule.get("type", kind)
    allowed = [allowed] if isinstance(allowed, str) else allowed
    if kind not in allowed and not ("integer" in allowed and kind == "number" and value == int(value)):
        return [f"{place}: not of type {' or '.join(allowed)}"]
    same = lambda a, b: a == b and isinstance(a, bool) == isinstance(b, bool)
    out = []
    if "enum" in rule and not any(same(value, v) for v in rule["enum"]):
        out.append(f"{place}: not one of the allowed values")
    if "const" in rule and not same(value, rule["const"]):
        out.append(f"{place}: not the fixed value")
    if kind == "string" and len(value) < rule.get("minLength", 0):
        out.append(f"{place}: too short" if value else f"{place}: empty")
    if kind == "string" and "pattern" in rule and not re.search(rule["pattern"], value):
        out.append(f"{place}: does not match the pattern")
    if kind == "number" and "minimum" in rule and value < rule["minimum"]:
        out.append(f"{place}: below {rule['minimum']}")
    if kind == "number" and "maximum" in rule and value > rule["maximum"]:
        out.append(f"{place}: above {rule['maximum']}")
    if kind == "array":
        out += [f"{place}: too few items"] * (len(value) < rule.get("minItems", 0))
        out += [m for i, x in enumerate(value) for m in said(x, rule.get("items", {}), f"{at}[{i}]")]
    if kind == "object":
        inner = lambda k: f"{at}.{k}" if at else k
        known, rest = rule.get("properties", {}), rule.get("additionalProperties", True)
        out += [f"{inner(k)}: required" for k in rule.get("required", ()) if k not in value]
        out += [m for k, r in known.items() if k in value for m in said(value[k], r, inner(k))]
        for k in sorted(value.keys() - known.keys()):
            out += [f"{inner(k)}: unknown key"] if rest is False else said(value[k], rest, inner(k)) if isinstance(rest, dict) else []
    return out


def messages_of(spark, lines, rule):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, raw string").select("i", contract.violations(F.col("raw"), rule).alias("m"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    return [r.m for r in df.orderBy("i").collect()]


def test_contract(spark):
    good = {"language": "python", "code": "x", "finding": {"category": "bug", "confidence": "likely", "severity": "low", "summary": "s"}, "provenance": {"source_type": "commit", "source_url": "u"}, "extra": 1}
    bad = json.loads(json.dumps(good))
    bad["code"], bad["finding"]["confidence_score"], bad["framework"] = "", 1.5, 3
    del bad["finding"]["severity"]
    assert messages_of(spark, [json.dumps(good), json.dumps(bad)], contract.TRAINING_EXAMPLE) == [[], ["framework: not of type string or null", "code: empty", "finding.severity: required", "finding.confidence_score: above 1"]]
    made = curate.manifest_record("d", "1.0.0", 7, {"train": (2, "aa")})
    assert curate.checked_manifest(spark, made) is made and made["counts"] == {"train": 2, "val": 0, "test": 0}
    for change in ({"version": "1.0"}, {"odd": 1}, {"splitSeed": "7"}, {"datasetId": ""}):
        with pytest.raises(ValueError, match="invalid manifest"):
            curate.checked_manifest(spark, made | change)


def test_contract_against_plain_rules(spark):
    leaf = [None, True, False, 0, 1, 1.0, 2.5, -3, 7, "", "ab", "é", "abc", "size", [], {}, [1, 2], {"b": 1}]
    rule = {
        "type": "object",
        "required": ["a", "it's"],
        "properties": {
            "a": {"enum": ["ab", 1, None, True, [1, 2], {"b": 1}]},
            "b": {"type": ["integer", "array"], "minimum": 1, "maximum": 5, "minItems": 1, "items": {"type": "string", "minLength": 2, "pattern": "^[a-z]"}},
            "it's": {"const": 1},
            "o": {"type": "object", "additionalProperties": {"type": "number"}, "properties": {"x": {}}},
            "s": {"type": "object", "additionalProperties": False, "required": ["k"], "properties": {"k": {"type": "array", "items": {"type": "object", "additionalProperties": False}}}},
        },
    }
    rng = random.Random(3)
    pick = lambda: rng.choice(leaf)
    cases = [*leaf, [[]]]
    for _ in range(150):
        case = {k: pick() for k in ("a", "b", "it's", "z") if rng.random() < 0.8}
        if rng.random() < 0.6:
            case["b"] = [pick() for _ in range(rng.randrange(3))]
        if rng.random() < 0.6:
            case["o"] = {k: pick() for k in ("x", "y", "w") if rng.random() < 0.7}
        if rng.random() < 0.6:
            case["s"] = {"k": [pick() for _ in range(rng.randrange(3))], **({"q": 1} if rng.random() < 0.3 else {})}
        cases.append(case)
    got = messages_of(spark, [json.dumps(c, ensure_ascii=rng.random() < 0.5) for c in cases], rule)
    assert got == [said(c, rule) for c in cases]
    assert messages_of(spark, ["1", "1.0", "1e0", "1.5", '"1"'], {"type": "integer"}) == [[], [], [], ["record: not of type integer"], ["record: not of type integer"]]


def test_what_is_no_json(spark):
    lines = ["", None, "oops", "{", '{"a": 1} x', '{"a": 1}{"a": 2}', "1], [2", "1, 2", '{"a": NaN}', '{"a": 1, "a": 2}', "'a'"]
    assert messages_of(spark, lines, {}) == [[contract.NOT_JSON]] * len(lines)
    assert messages_of(spark, [" [1, 2] ", "null", '"x"', '{"a": {"a": 1}}'], {}) == [[]] * 4


def test_evaluation_with_a_predictor(spark):
    df = spark.createDataFrame([("aa", "bug"), ("b", "security"), ("cc", "bug"), ("d", "testing")], "prompt string, category string")
    evaluate.register_predictor("by_size", lambda: lambda ps: [f"category: {'bug' if len(p) == 2 else 'security'}" for p in ps])
    report = evaluation_report = evaluate.evaluation(df, "by_size")
    assert report["exampleCount"] == 4 and abs(report["macroF1"] - (1 + 2 / 3 + 0) / 3) < 1e-12
    assert evaluation_report["categories"]["security"] == {"precision": 0.5, "recall": 1.0, "f1": 2 / 3, "truePositives": 1, "falsePositives": 1, "falseNegatives": 0}
    assert evaluate.evaluation(df.limit(0), "by_size") == {"exampleCount": 0, "macroF1": 0.0, "categories": {}}


def test_set_checksums_in_order(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), hashlib.sha256(str(i).encode()).hexdigest()) for i in range(3000)]
    got = hashing.set_checksums_in_order(spark.createDataFrame(rows, "part string, c string").repartition(7), "part", "c")
    for p in "ab":
        mine = sorted(c for q, c in rows if q == p)
        assert got[p] == (len(mine), hashlib.sha256("".join(mine).encode()).hexdigest())
    assert hashing.set_checksums_in_order(spark.createDataFrame([], "part string, c string"), "part", "c") == {}


def test_trimming_is_linear_in_inner_blanks(spark):
    blanks = " \t " * 70_000
    df = spark.createDataFrame([(f"﻿ a{blanks}b　\n",), ("\u001ca\u0085",), ("​ x ᠎",), ("",), (None,)], "t string")
    js = [r[0] for r in df.select(text.js_trim(F.col("t"))).collect()]
    py = [r[0] for r in df.select(text.py_strip(F.col("t"))).collect()]
    assert js == [f"a{blanks}b", "\u001ca\u0085", "​ x ᠎", "", None]
    assert py == [f"﻿ a{blanks}b", "a", "​ x ᠎", "", None]


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_batches_against_plain_lists(spark, parts):
    rng = random.Random(parts)
    rows = [(i, [f"t{j}" for j in range(rng.randrange(7))], list(range(rng.randrange(3)))) for i in range(53)] + [(None, None, None), (7, ["same"], [1])]
    df = spark.createDataFrame(rows, "id long, tokens array<string>, ids array<int>").repartition(parts)
    got = training.batches(df, 8, [training.shuffle_key(F.col("id"), 3), F.col("id")], {"tokens": "<pad>", "ids": "-1"}).collect()
    key = lambda r: (r[0] is not None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "")
    ordered, want = sorted(rows, key=key), {}
    for at in range(0, len(ordered), 8):
        batch = [(i, t or [], n or []) for i, t, n in ordered[at : at + 8]]
        longest = max(len(x) for _, t, n in batch for x in (t, n))
        for i, t, n in batch:
            want.setdefault((at // 8, longest), []).append((i, t + ["<pad>"] * (longest - len(t)), n + [-1] * (longest - len(n))))
    have = {}
    for r in got:
        have.setdefault((r["batch"], r["longest"]), []).append(tuple(r["row"]))
    assert {k: sorted(map(repr, v)) for k, v in have.items()} == {k: sorted(map(repr, v)) for k, v in want.items()}
    assert sorted((r["batch"], r["place"]) for r in got) == [(i // 8, i % 8) for i in range(55)]


def test_no_batches_and_no_size(spark):
    df = spark.createDataFrame([], "id long, tokens array<string>")
    assert training.batches(df, 4, [F.col("id")], {"tokens": ""}).collect() == []
    with pytest.raises(ValueError, match="at least one row"):
        training.batches(df, 0, [F.col("id")], {"tokens": ""})


def test_pairs_by_place(spark):
    left = spark.createDataFrame([(i * 3, f"p{i}") for i in range(40)], "k long, position string").repartition(5)
    right = spark.createDataFrame([(i, f"e{i}") for i in range(40)], "n long, text string").repartition(2)
    got = evaluate.paired_in_order(left, right, [F.col("k")], [F.col("n")]).collect()
    assert sorted((r.position, r.predicted.position, r.expected.text) for r in got) == [(i, f"p{i}", f"e{i}") for i in range(40)]
    for a, b in ((left, right.where("n < 39")), (left.where("k > 0"), right), (left.where("k < 0"), right)):
        with pytest.raises(PySparkException, match="differ in length"):
            evaluate.paired_in_order(a, b, [F.col("k")], [F.col("n")]).collect()
    assert evaluate.paired_in_order(left.where("k < 0"), right.where("n < 0"), [F.col("k")], [F.col("n")]).collect() == []


def test_first_of_many_keywords(spark):
    rng = random.Random(2)
    keywords = [*{"".join(rng.choice("abcé ") for _ in range(rng.randrange(2, 5))) for _ in range(300)}, "abc", "abc"]
    rows = [(i, "".join(rng.choice("AaBbCcÉé dx") for _ in range(rng.randrange(60)))) for i in range(300)] + [(-1, None), (-2, "")]
    df = spark.createDataFrame(rows, "i int, t string").select("t", text.first_keyword(F.col("t"), keywords).alias("want"), text.first_of_many(F.col("t"), keywords).alias("got"), text.first_of_many(F.col("t"), ["zz", "", "a"]).alias("empty"), text.first_of_many(F.col("t"), []).alias("none"))
    for r in df.collect():
        assert r.got == r.want and r.none is None and r["empty"] == (None if r.t is None else "")


def test_first_of_many_keeps_no_batch_of_strings():
    batch = pa.array(["x" * 20_000 + "bé"] * 400)
    tracemalloc.start()
    (got,) = text.firsts_of(iter([batch]), ["zz", "bé"])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.to_pylist() == ["bé"] * 400 and most < 2_000_000


def test_answers_or_warnings(spark):
    def client():
        def ask(prompts):
            if any("bad" in p for p in prompts):
                raise RuntimeError("refused")
            return ["" if p == "mute" else p.upper() for p in prompts]

        return ask

    df = spark.createDataFrame([(i, p) for i, p in enumerate(["a", "bad", "b", None, "mute", "c"] * 5)], "i int, prompt string").repartition(2)
    got = {r.i: (r.answer, r.warning) for r in evaluate.answered(df, client, batch=4).collect()}
    assert got == {i: [("A", None), (None, "RuntimeError: refused"), ("B", None), (None, None), (None, "empty answer"), ("C", None)][i % 6] for i in range(30)}

    def nobody():
        raise OSError("no endpoint")

    assert {(r.answer, r.warning) for r in evaluate.answered(df.where("prompt IS NOT NULL"), nobody).collect()} == {(None, "OSError: no endpoint")}
    assert {r.warning for r in evaluate.answered(df.where("prompt = 'a'"), lambda: lambda p: [], batch=3).collect()} == {"ValueError: 0 answers to 1 prompts"}
