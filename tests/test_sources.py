"""Source trees, record files, manifests and streams."""

import hashlib
import json
import os

import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from reviewloom.analyzers import engine
from reviewloom.functions import hashing
from reviewloom.functions.text import review_prompt
from reviewloom.operators import curate, validate
from reviewloom.sources import record_set, records, source_tree
from reviewloom.streaming import landing


def test_source_tree(spark, tmp_path):
    for p, text in {"a/__init__.py": "eval(1)", "a/_priv/.hidden/x.ts": "", "a/node_modules/m.js": "x", "dist/y.js": "x", "b.md": "x", "c.tsx": "é", ".py": "1"}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(text)
    (tmp_path / "bad.py").write_bytes(b"\xff\xfe")
    source_tree.register(spark)
    got = {r.path.removeprefix(f"{tmp_path}/"): (r.language, r.content, r.error) for r in spark.read.format("source_tree").load(str(tmp_path)).collect()}
    assert got == {
        "a/__init__.py": ("python", "eval(1)", None),
        "a/_priv/.hidden/x.ts": ("typescript", "", None),
        "c.tsx": ("typescript", "é", None),
        ".py": ("python", "1", None),
        "bad.py": ("python", None, "UnicodeDecodeError"),
    }
    one = spark.read.format("source_tree").load(str(tmp_path / "a/__init__.py"))
    assert [r.rule_id for r in engine.findings(one).collect()] == ["python.dangerous-eval"]


def test_records(spark, tmp_path):
    good = {"repository": "o/r", "pullNumber": 7, "title": "fix   it", "reviewComments": [{"path": None, "body": "slow"}], "collectedAt": "2026-01-01T00:00:00Z"}
    (tmp_path / "raw.jsonl").write_text(json.dumps(good, ensure_ascii=False) + "\n\n   \n")
    rows = records.checked(records.read_jsonl(spark, str(tmp_path / "raw.jsonl"), records.RAW)).collect()
    assert [(r.repository, r.pullNumber, r.title) for r in rows] == [("o/r", 7, "fix   it")]
    (tmp_path / "bad.jsonl").write_text(json.dumps(good) + "\n{oops\n")
    with pytest.raises(PySparkException):
        records.checked(records.read_jsonl(spark, str(tmp_path / "bad.jsonl"), records.RAW)).collect()
    records.write_jsonl(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "out"))
    assert [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()] == [{"a": 1}]
    assert records.write_manifest(spark.createDataFrame([(1, "x")], "n int, s string"), str(tmp_path / "m/n.json")) == {"n": 1, "s": "x"}
    assert (tmp_path / "m/n.json").read_text() == '{\n  "n": 1,\n  "s": "x"\n}\n'


def test_stream_of_landed_records(spark, tmp_path):
    landing_dir = tmp_path / "in"
    landing_dir.mkdir()
    rec = lambda n, title: json.dumps({"repository": "o/r", "pullNumber": n, "title": title, "sourceUrl": "u", "reviewComments": [{"body": "no"}], "collectedAt": "2026-01-01T00:00:00Z"})
    (landing_dir / "1.json").write_text(rec(1, "fix it") + "\n" + rec(1, "fix it") + "\n" + rec(2, "a word"))
    got = []
    sink = lambda df, epoch: got.extend((r.pull_number, len(r.proposals)) for r in df.collect())
    landing.propose_stream(spark, str(landing_dir), str(tmp_path / "cp"), sink).awaitTermination(120)
    (landing_dir / "2.json").write_text(rec(1, "fix again") + "\n" + rec(3, "security test"))
    landing.propose_stream(spark, str(landing_dir), str(tmp_path / "cp"), sink).awaitTermination(120)
    assert sorted(got) == [(1, 1), (3, 2)]


def test_files_are_filtered_before_python(spark):
    files = spark.createDataFrame([("a.md", "eval(1)"), ("a.py", "eval(1)")], "path string, content string")
    plan = engine.find(files)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Filter")
    engine.register_table_function(spark)
    files.createOrReplaceTempView("some_files")
    out = spark.sql("SELECT path, f.rule_id FROM (SELECT * FROM some_files WHERE path LIKE '%.py') s, LATERAL analyze_source('python', s.content) f").collect()
    assert [tuple(r) for r in out] == [("a.py", "python.dangerous-eval")]


def example(code, **more):
    return {"language": "python", "code": code, "finding": {"category": "bug", "confidence": "likely", "severity": "low", "summary": "s"}, "provenance": {"source_type": "commit", "source_url": "u"}, **more}


def test_line_numbers(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    text = "a\n\n  \nb\r\nc\x85d\n\u2028e\n" + "\n".join(f"line {i}" if i % 3 else "" for i in range(4000))
    path.write_bytes(text.encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        for flavour, lines in (("py", text.splitlines()), ("js", [x for x in text.split("\n") if x.strip()])):
            full = [(k, x.strip()) for k, x in enumerate(lines, 1) if x.strip()]
            got = sorted((r["_line"], r["_raw"], r["_at"]) for r in records.numbered_lines(spark, str(path), flavour).collect())
            assert got == [(k, x, at) for at, (k, x) in enumerate(full)], flavour
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (tmp_path / "bad.jsonl").write_text("{}\n\n{oops\n")
    with pytest.raises(PySparkException, match="invalid JSON on line 2"):
        records.checked(records.read_jsonl(spark, str(tmp_path / "bad.jsonl"), records.RAW, "js")).collect()


def test_curate(spark, tmp_path):
    path, out = tmp_path / "x.jsonl", tmp_path / "m" / "manifest.json"
    lines = [json.dumps(example(f"code é {i % 80}"), ensure_ascii=bool(i % 2)) for i in range(100)]
    path.write_text("\n".join(lines) + "\n")
    rows, made = curate.curate(spark, str(path), "set", "1.2.3", 7, str(out), in_order=True)
    sums = {hashlib.sha256(json.dumps(json.loads(x), sort_keys=True, separators=(",", ":")).encode()).hexdigest() for x in lines}
    assert rows.count() == sum(made["counts"].values()) == len(sums) == 80 and {r.checksum for r in rows.collect()} == sums
    assert made["sourceExamplesChecksum"] == hashlib.sha256("".join(sorted(sums)).encode()).hexdigest()
    assert json.loads(out.read_text()) == made and made["splitSeed"] == 7
    assert curate.curate(spark, str(path), "set", "1.2.3", 7, in_order=True)[1] == made != curate.curate(spark, str(path), "set", "1.2.3", 8, in_order=True)[1]
    _, tree = curate.curate(spark, str(path), "set", "1.2.3", 7)
    assert tree["counts"] == made["counts"] and all(tree["checksums"][s] != made["checksums"][s] for s in curate.SPLITS if made["counts"][s])
    assert tree == curate.curate(spark, str(path), "set", "1.2.3", 7)[1] and tree["sourceExamplesChecksum"] == hashing.set_checksum_tree(rows, [], "checksum", "d").first().d
    path.write_text("\n".join([lines[0], "", json.dumps(example("")), lines[1]]))
    with pytest.raises(ValueError, match="example 1: code: empty"):
        curate.curate(spark, str(path), "set", "1.2.3", 7)
    path.write_text("\n".join([lines[0], "", "{oops"]))
    with pytest.raises(ValueError, match="example 3: invalid JSON"):
        curate.curate(spark, str(path), "set", "1.2.3", 7)


def test_registry(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "m.json").write_text(json.dumps({"status": "planned", "version": "0.1.0", "adapter": {"type": "lora", "rank": 8}}))
    (tmp_path / "registry.json").write_text(json.dumps({"manifests": ["a/m.json", "b/none.json"]}))
    rows = records.read_registry(spark, str(tmp_path)).withColumn("errors", validate.model_errors()).orderBy("ord").collect()
    assert [(r.path, r.errors) for r in rows] == [("a/m.json", []), ("b/none.json", ["file is missing"])]


def test_package_manifests(spark, tmp_path):
    (tmp_path / "package.json").write_text(json.dumps({"dependencies": {"express": "4"}, "devDependencies": {"typescript": "5"}}, indent=2))
    r = records.read_package_manifests(spark, str(tmp_path / "package.json")).first()
    assert dict(r.dependencies) == {"express": "4"} and dict(r.devDependencies) == {"typescript": "5"} and r.path.endswith("package.json")


def test_finding_records_and_review_prompt(spark):
    files = spark.createDataFrame([("b.py", "eval(1)\nexec(2)"), ("a.py", "eval(é)"), ("c.py", "x = 1")], "path string, content string")
    rows = engine.records_by_file(engine.findings(files), in_order=True).collect()
    assert [r.path for r in rows] == ["a.py", "b.py"]
    first = json.loads(rows[1].records)[0]
    assert list(first)[:5] == ["id", "ruleId", "category", "severity", "confidence"] and first["location"] == {"path": "b.py", "startLine": 1, "startColumn": 1, "endLine": 1, "endColumn": 8}
    assert rows[0].records.startswith('[\n  {\n    "id": "python.dangerous-eval:a.py:1:1",')
    asked = spark.createDataFrame([("x" * 30_000, "[]")], "s string, f string").select(review_prompt(F.lit("p"), F.col("s"), F.col("f")).alias("q")).first().q
    assert asked == "File: p\n\n```\n" + "x" * 20_000 + "\n```\n\nFindings:\n[]"


def test_a_rule_of_ones_own(spark):
    before = dict(engine.ANALYZERS)
    try:
        engine.register_rule("python", lambda content: ([("own.todo", 1, 1, 1, 5)] if "TODO" in content else [], "possible"))
        files = spark.createDataFrame([("a.py", "TODO = eval(1)")], "path string, content string")
        assert sorted(r.rule_id for r in engine.find(files).collect()) == ["own.todo", "python.dangerous-eval"]
    finally:
        engine.ANALYZERS.clear()
        engine.ANALYZERS.update(before)


def test_filters_reach_the_source_tree(spark, tmp_path):
    for p in ("a/x.py", "a/y.js", "b/x.py", "b/z.ts"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text("x")
    # Opening a pipe without a writer never returns, so a query that ends has not opened it.
    os.mkfifo(tmp_path / "a/pipe.js")
    source_tree.register(spark)
    tree = spark.read.format("source_tree").load(str(tmp_path))
    names = lambda df: sorted(r.path.removeprefix(f"{tmp_path}/") for r in df.collect())
    assert names(tree.where("language = 'python'")) == ["a/x.py", "b/x.py"]
    assert names(tree.where("language IN ('python', 'typescript') AND path LIKE '%/b/%' AND content = 'x'")) == ["b/x.py", "b/z.ts"]
    assert names(tree.where("NOT language = 'javascript' AND path LIKE '%.ts'")) == ["b/z.ts"]
    assert names(tree.where(F.col("path").startswith(f"{tmp_path}/b"))) == ["b/x.py", "b/z.ts"]
    assert names(tree.where("language IS NULL OR path IS NULL")) == [] and names(tree.where("language = 'rust'")) == []


def test_source_tree_partitions_by_bytes(tmp_path, monkeypatch):
    for i, n in enumerate((10, 10, 50, 1, 1)):
        (tmp_path / f"{i}.py").write_text("x" * n)
    monkeypatch.setattr(source_tree, "BYTES", 20)
    reader = source_tree.SourceTreeReader(str(tmp_path))
    assert [[os.path.basename(p) for p in x.paths] for x in reader.partitions()] == [["0.py", "1.py"], ["2.py"], ["3.py", "4.py"]]


def test_record_set_is_published_as_a_whole(spark, tmp_path):
    folder = str(tmp_path / "set")
    record_set.register(spark)
    write = lambda df, mode: df.write.format("record_set").mode(mode).save(folder)
    read = lambda: sorted(json.loads(r.record)["i"] for r in spark.read.format("record_set").load(folder).collect())
    rows = spark.range(40).selectExpr("id AS i", "IF(id = 3, NULL, 'é') AS t", "array(named_struct('a', id, 'b', CAST(NULL AS STRING))) AS l").repartition(4)
    write(rows, "append")
    assert read() == list(range(40))
    assert sum(p.records for p in record_set.published(folder)) == 40 and len(record_set.published(folder)) == 4
    kept = json.loads((tmp_path / "set/manifest.json").read_text())
    # One task of four fails, after others have written their parts.
    broken = rows.selectExpr("IF(i = 39, raise_error('lost'), i) AS i")
    with pytest.raises(PySparkException):
        write(broken, "append")
    assert json.loads((tmp_path / "set/manifest.json").read_text()) == kept and read() == list(range(40))
    write(rows.where("i < 5"), "append")
    assert read() == sorted([*range(40), *range(5)])
    write(rows.where("i < 2").selectExpr("i"), "overwrite")
    assert read() == [0, 1] and len({p.name.partition("/")[0] for p in record_set.published(folder)}) == 1
    write(rows.where("i < 0"), "overwrite")
    assert read() == [] and record_set.published(folder) == []


def test_record_set_cleans_up(tmp_path):
    batch = lambda *i: iter([pa.RecordBatch.from_pydict({"i": list(i)})])
    files = lambda: sorted(str(p.relative_to(tmp_path / "parts")) for p in (tmp_path / "parts").rglob("*"))
    first, failed, second = (record_set.RecordSetWriter(str(tmp_path), o) for o in (False, False, True))
    first.commit([first.write(batch(1, 2)), first.write(batch()), None])
    kept = files()
    assert len(kept) == 2 and kept == [first.job, record_set.published(str(tmp_path))[0].name]
    # One task reports, one has ended unreported, one breaks while it writes.
    reported = failed.write(batch(3))
    failed.write(batch(4))
    with pytest.raises(ZeroDivisionError):
        failed.write(1 / 0 for _ in range(1))
    failed.abort([reported, None])
    assert files() == kept
    # A task that ran twice has two parts, of which one is reported.
    second.write(batch(5))
    second.commit([second.write(batch(5))])
    assert [p.records for p in record_set.published(str(tmp_path))] == [1] and len(files()) == 2


def test_changed_part_is_noticed(spark, tmp_path):
    record_set.register(spark)
    spark.range(3).write.format("record_set").mode("append").save(str(tmp_path))
    part = next((tmp_path / "parts").rglob("*.jsonl"))
    part.write_text(part.read_text().replace("{", "{ "))
    with pytest.raises(PySparkException, match="not what its manifest says"):
        spark.read.format("record_set").load(str(tmp_path)).collect()


def test_shuffle_files_go_when_a_table_is_written(spark):
    import os
    import time

    from reviewloom.sources.scratch import CLEANUP, written

    before = spark.conf.get(CLEANUP, None)
    dirs = [d.getPath() for d in spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirs()]
    files = lambda: {f for top in dirs for _, _, names in os.walk(top) for f in names if f.startswith("shuffle_")}
    there = files()
    out = written(spark.range(1000).repartition(7, "id"), "shuffled")
    until = time.time() + 5
    while files() - there and time.time() < until:
        time.sleep(0.1)
    assert not files() - there
    assert out.count() == 1000 and spark.conf.get(CLEANUP, None) == before
