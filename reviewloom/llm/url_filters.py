"""URL filters by a sort-merge range join over reversed-host keys.

A host with its labels reversed (``net.example.blog.``) turns "this host and
all its subdomains" into one interval of keys, and a path prefix is an interval
as well. Rules and urls are put into one sorted sequence and swept; the sweep
keeps, as window columns, a stack of the rules that are active at each point
(rule intervals nest, they never cross). The sweep runs twice: over hosts, where
every active rule host counts, then over paths within each such host, where the
innermost prefix is the longest. The most specific rule wins.

The sequence is dealt out by ranges of the key and a row number, so that a host
with a third of all urls is spread over many tasks; what a task must know from
those before it, the stack at its start, is a row for each task.

Nulls and odd input: a null url, or one without ``://``, has an empty host and
an empty path and gets the default verdict. Repeated rows each get their row;
null ids are allowed. An empty table gives an empty result. Columns of the input
other than id and url are not read and may have any name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewloom.llm.shared import ascii_lower, spread_join, written

#: Rows of a part of the sweep, about.
PART_ROWS = 1_000_000


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_host(host: Column) -> Column:
    """``blog.example.net`` as ``net.example.blog.``; the closing dot keeps ``net`` from covering ``network``."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """A table of (host, path, verdict) from literals; a rule's name is host and path together."""
    if not rules:
        return spark.range(0).select(*[F.lit("").alias(c) for c in ("host", "path", "verdict", "rule")])
    cells = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("host", "path", "verdict"), r, strict=True)]) for r in rules])
    return spark.range(1).select(F.inline(cells)).withColumn("rule", F.concat("host", "path"))


def stack_join(points: DataFrame, prefixes: DataFrame, parts: int) -> DataFrame:
    """Adds ``stack``: the prefixes of each point's ``key``, from the outermost to the innermost.

    ``points`` has ``key`` and ``pid``, a unique number; ``prefixes`` has ``key``, each once.
    """
    others = [c for c in points.columns if c not in ("key", "pid")]
    blank = {"pid": F.lit(None).cast("long")} | {c: F.lit(None).cast(points.schema[c].dataType) for c in others}
    # A prefix opens before the points equal to it and closes after all its continuations: the order is that of
    # UTF-8 bytes, and no string has the byte FF.
    opens = prefixes.select(F.col("key").cast("binary").alias("at"), F.lit(0).alias("kind"), F.lit(1).alias("step"), "key").withColumns(blank)
    closes = prefixes.select(F.concat(F.col("key").cast("binary"), F.unhex(F.lit("FF"))).alias("at"), F.lit(2).alias("kind"), F.lit(-1).alias("step"), "key").withColumns(blank)
    reads = points.select(F.col("key").cast("binary").alias("at"), F.lit(1).alias("kind"), F.lit(0).alias("step"), "key", "pid", *others)
    order = ["at", "kind", "pid"]
    events = opens.unionByName(closes).unionByName(reads).repartitionByRange(parts, *order)
    # Written once: the sweep and what is carried over must see the same division into parts.
    dealt = written(events.withColumn("part", F.spark_partition_id()), "sweep")

    # A row for each part: the level at its start.
    starts = dealt.groupBy("part").agg(F.sum("step").alias("net"))
    base = starts.select("part", (F.sum("net").over(Window.orderBy("part")) - F.col("net")).alias("base"))
    here = Window.partitionBy("part").orderBy(*order)
    level = F.col("base") + F.sum("step").over(here)
    levelled = dealt.join(F.broadcast(base), "part").withColumn("level", level)
    opened = dealt.where("kind <> 1").join(F.broadcast(base), "part").withColumn("level", level).where("kind = 0")
    depth = opened.agg(F.max("level")).first()[0] or 0
    levels = range(1, depth + 1)
    if not levels:
        return reads.select("pid", *others, F.array().cast("array<string>").alias("stack"))

    # The stack: what was opened last at each level, in this part or else in the parts before it.
    slots = levelled.withColumns({f"s{d}": F.last(F.when((F.col("kind") == 0) & (F.col("level") == d), F.col("key")), True).over(here) for d in levels})
    last = opened.groupBy("part").agg(*[F.max_by("key", F.when(F.col("level") == d, F.col("at"))).alias(f"l{d}") for d in levels])
    past = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = starts.join(last, "part", "left").select("part", *[F.last(f"l{d}", True).over(past).alias(f"c{d}") for d in levels])
    swept = slots.where("kind = 1").join(F.broadcast(carried), "part")
    whole = F.array(*[F.coalesce(f"s{d}", f"c{d}") for d in levels])
    return swept.select("pid", *others, F.slice(whole, F.lit(1), F.col("level").cast("int")).alias("stack"))


def judge_urls(
    df: DataFrame,
    rules: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
    parts: int | None = None,
) -> DataFrame:
    """One row for each row of ``df``: (id, host, path, rule, verdict).

    ``rules`` is a table of host, path, verdict and rule, as :func:`rule_table`
    makes it. A rule fits its host and all subdomains if the url's path starts
    with the rule's path; the longest rule wins, the longer host at a tie; of
    equal rules ``block`` wins over ``allow``. Where none fits, the verdict is ``default``.
    """
    parts = parts or max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // PART_ROWS))
    rules = rules.groupBy(reversed_host(ascii_lower(F.col("host"))).alias("host_key"), F.col("path").alias("rule_path")).agg(
        F.max_by(F.struct("rule", "verdict"), "verdict").alias("named")
    )
    urls = df.select(
        F.monotonically_increasing_id().alias("pid"),
        F.col(id_col).alias("id"),
        url_host(F.col(url_col)).alias("host"),
        url_path(F.col(url_col)).alias("path"),
    ).withColumn("key", reversed_host(F.col("host")))
    by_host = stack_join(urls, rules.select(F.col("host_key").alias("key")).distinct(), parts)
    inner = F.concat(F.col("host_key"), F.lit("\0"), F.col("path"))
    points = by_host.withColumn("host_key", F.explode_outer("stack")).drop("stack").withColumn("key", F.coalesce(inner, F.lit("")))
    # Here pid must be unique again; the row itself is kept beside it.
    points = points.withColumn("row", F.col("pid")).withColumn("pid", F.monotonically_increasing_id())
    by_path = stack_join(points, rules.select(F.concat("host_key", F.lit("\0"), "rule_path").alias("key")), parts)
    fits = by_path.withColumn("key", F.try_element_at("stack", F.lit(-1)))
    named = rules.select(F.concat("host_key", F.lit("\0"), "rule_path").alias("key"), F.length("host_key").alias("host_len"), (F.length("host_key") + F.length("rule_path")).alias("len"), "named")
    best = F.max(F.when(F.col("named").isNotNull(), F.struct("len", "host_len", "named")))["named"]
    return (
        _with_rules(fits, named)
        .groupBy("row")
        .agg(F.first("id").alias(id_col), F.first("host").alias("host"), F.first("path").alias("path"), best.alias("best"))
        .select(id_col, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
    )


def _with_rules(fits: DataFrame, named: DataFrame) -> DataFrame:
    """Left join on the rule's key. A rule may fit a third of all urls."""
    cells = [F.octet_length(c) for c in ("key", "key", "named.rule", "named.verdict")]
    size = named.agg(F.sum(sum((F.coalesce(c, F.lit(0)) for c in cells), F.lit(160)))).first()[0] or 0
    matched = spread_join(fits.where("key IS NOT NULL"), named, ["key"], size, ["pid"], "left", 64)
    rest = fits.where("key IS NULL").withColumns({c: F.lit(None).cast(named.schema[c].dataType) for c in ("host_len", "len", "named")})
    return matched.unionByName(rest)
