"""Merkle manifest of a dataset with parent-preimage paths.

Every row is a leaf: the SHA-256 of its columns, framed by their lengths. The
leaves of a source are numbered in order by a distributed sort, and every
``FANOUT`` consecutive ones are hashed into a parent, up to the source's
subroot; the subroots are hashed likewise into the root of the dataset. For each
parent its preimage, the concatenated digests of its children, is stored. A
leaf's proof comes from joining its ancestors' preimages: excising its own 64
characters of each leaves its siblings, and splicing other digests in there folds
a changed leaf up to the root that it would give.

Preimages go down the tree a level at a time, joined by the parent's number, so
what is joined last are the runs of ``FANOUT`` leaves with their whole paths; no
source, however large, is in one task.

Nulls and odd input: a null value is framed as ``-``, so it differs from an empty
text. Null sources are a source, the first. Leaves ascend by id, null first, then by digest;
repeated rows are leaves of their own. A source with one row has it as its subroot, a
dataset with one source that one's subroot as its root. Columns that are not
framed are not read. An empty table has no leaves and gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.shared import ascii_lower, beside, spread_join, written
from reviewloom.operators.numbering import numbered

#: Children of a parent, a power of two, and its bits.
FANOUT, BITS = 16, 4
#: Characters of a digest.
WIDTH = 64
#: Fixed value: one row in so many, by the checksum of its id, is tampered with in the audit.
TAMPERED = 5


def framed(columns: Sequence[Column]) -> Column:
    """The columns one after the other, each as its length in UTF-8 bytes, a colon and its text; null is ``-``."""
    text = [c.cast("string") for c in columns]
    return F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in text])


def _digest(preimage: Column) -> Column:
    return F.sha2(preimage, 256)


def _parents(nodes: DataFrame, label: str) -> DataFrame:
    """(tree, i, n, preimage): a level above ``nodes`` (tree, i, n, digest); ``n`` is the number of nodes of the tree on its level."""
    runs = nodes.groupBy("tree", F.shiftright("i", BITS).alias("i")).agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("i", "digest"))).alias("run"))
    level = runs.select("tree", "i", F.shiftright(F.col("n") + FANOUT - 1, BITS).alias("n"), F.array_join(F.transform("run", lambda x: x["digest"]), "").alias("preimage"))
    return written(level, label)


def _levels(nodes: DataFrame, most: int, label: str) -> list[DataFrame]:
    """The levels above ``nodes``, lowest first; a tree ends where it has one node. ``most``: nodes of the largest tree."""
    levels = []
    while most > 1:
        levels.append(_parents(nodes.where("n > 1"), f"{label}-{len(levels) + 1}"))
        nodes, most = levels[-1].withColumn("digest", _digest(F.col("preimage"))), -(-most // FANOUT)
    return levels


def _paths(levels: list[DataFrame]) -> DataFrame | None:
    """(tree, i, path) of the lowest level: its preimage and those of all its ancestors; None where there is no level."""
    above = None
    for level in reversed(levels):
        own = level.select("tree", "i", F.array("preimage").alias("path"), F.shiftright("i", BITS).alias("up"))
        if above is not None:
            own = own.join(above.select("tree", F.col("i").alias("up"), F.col("path").alias("upper")), ["tree", "up"], "left")
            own = own.withColumn("path", F.concat("path", F.coalesce("upper", F.array().cast("array<string>"))))
        above = own.select("tree", "i", "path")
    return above


def _slots(path: Column, i: Column) -> Column:
    """The steps of a path: a preimage and where in it the digest of the child that holds node ``i`` begins."""
    slot = lambda k: F.call_function("shiftright", i, (k * BITS).cast("int")).bitwiseAND(FANOUT - 1)
    return F.transform(path, lambda p, k: F.struct(p.alias("preimage"), (slot(k) * WIDTH + 1).cast("int").alias("at")))


def manifest(df: DataFrame, columns: Sequence[str], id_col: str = "doc_id", tree_col: str = "source", changed: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """(id, leaf, subroot, root, steps, given): each row's leaf and its path to the root.

    ``steps`` has the ancestors' preimages and the place of the row's branch in
    each, from its parent up to the root. ``given`` is the leaf of the row as it is claimed to
    be: with the columns ``changed`` wherever ``where`` is true, else as it is.
    """
    named = {c: F.col(f"`{c}`") for c in columns}
    leaf = _digest(framed([*named.values()]))
    claim = F.when(F.coalesce(where, F.lit(False)), _digest(framed([*(named | (changed or {})).values()]))) if where is not None else F.lit(None).cast("string")
    # A string for each source that sorts like it, null first.
    key = F.coalesce(F.concat(F.lit("="), F.col(f"`{tree_col}`").cast("string")), F.lit(""))
    leaves = written(df.select(F.col(f"`{id_col}`").alias("id"), key.alias("key"), leaf.alias("leaf"), claim.alias("claim")), "leaves")
    placed = numbered(leaves, [F.col("id"), F.col("leaf")], ["key"]).select("row.*", "position")
    sizes = written(leaves.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "sources")
    trees = written(numbered(sizes, [F.col("key")]).select("row.key", "row.n", F.col("position").alias("tree")), "trees")
    facts = trees.agg(F.count(F.lit(1)).alias("trees"), F.max("n").alias("most"), F.sum(F.octet_length("key") + 64).alias("size")).first()

    rows = spread_join(placed, trees, ["key"], facts["size"] or 0, ["leaf", "position"])
    leaf_nodes = written(rows.select("tree", F.col("position").alias("i"), "n", F.col("leaf").alias("digest"), "id", "claim"), "placed")
    levels = _levels(leaf_nodes, facts["most"] or 0, "level")
    # A tree's last level, or its only leaf, is its subroot.
    ends = [leaf_nodes.where("n = 1").select("tree", "digest")] + [x.where("n = 1").select("tree", _digest(F.col("preimage")).alias("digest")) for x in levels]
    subroots = ends[0]
    for x in ends[1:]:
        subroots = subroots.unionByName(x)
    subroots = subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("i"), F.lit(facts["trees"]).cast("long").alias("n"), "digest")
    top = _paths(_levels(written(subroots, "subroots"), facts["trees"], "top"))
    none = F.array().cast("array<string>")
    tops = trees.select("tree", F.shiftright("tree", BITS).alias("run"))
    tops = tops.withColumn("top", none) if top is None else tops.join(top.select(F.col("i").alias("run"), F.col("path").alias("top")), "run")

    runs = leaf_nodes.groupBy("tree", F.shiftright("i", BITS).alias("run")).agg(F.collect_list(F.struct("i", "id", F.col("digest").alias("leaf"), "claim")).alias("leaves"))
    under = _paths(levels)
    runs = runs.withColumn("path", none) if under is None else runs.join(under.select("tree", F.col("i").alias("run"), "path"), ["tree", "run"], "left").withColumn("path", F.coalesce("path", none))
    # The run of a tree of several levels shares its top with its tree only, which may be a third of all: the size of the tops decides.
    width = 64 + (FANOUT * WIDTH + 64) * max(1, (max(facts["trees"] - 1, 0).bit_length() + BITS - 1) // BITS)
    whole = spread_join(runs, tops.select("tree", "top"), ["tree"], facts["trees"] * width, ["run"])

    each = whole.select("tree", "path", "top", F.inline("leaves"))
    steps = F.concat(_slots(F.col("path"), F.col("i")), _slots(F.col("top"), F.col("tree")))
    end = lambda path, start: F.when(F.size(path) > 0, _digest(F.element_at(path, -1))).otherwise(start)
    subroot = each.withColumn("subroot", end(F.when(F.size("path") > 0, F.col("path")), F.col("leaf")))
    return subroot.select(
        F.col("id").alias(id_col),
        F.col("leaf").alias(beside(id_col, "leaf")),
        F.col("subroot").alias(beside(id_col, "subroot")),
        end(F.when(F.size("top") > 0, F.col("top")), F.col("subroot")).alias(beside(id_col, "root")),
        steps.alias(beside(id_col, "steps")),
        F.coalesce("claim", "leaf").alias(beside(id_col, "given")),
    )


def siblings(steps: Column) -> Column:
    """The digests beside the branch, level by level and left to right: each preimage without its own slot."""
    return F.aggregate(steps, F.lit(""), lambda done, s: F.concat(done, F.overlay(s["preimage"], F.lit(""), s["at"], F.lit(WIDTH))))


def folded(steps: Column, leaf: Column) -> Column:
    """The root that ``leaf`` gives: at each step its digest is spliced into the preimage, which is hashed."""
    return F.aggregate(steps, leaf, lambda digest, s: _digest(F.overlay(s["preimage"], digest, s["at"], F.lit(WIDTH))))


def tampering(id_col: str = "doc_id", text_col: str = "text") -> tuple[dict[str, Column], Column]:
    """What the audit changes: the text in lower case (A-Z) where ``TAMPERED`` divides the checksum of the id; a null id or text stays."""
    return {text_col: ascii_lower(F.col(f"`{text_col}`"))}, F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % TAMPERED == 0


def audit(df: DataFrame, columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id", tree_col: str = "source", text_col: str = "text") -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row, some of them tampered with.

    ``proof_sha256`` digests the row's siblings up to the root; ``verified`` says whether the
    leaf as given folds to the root with them.
    """
    changed, where = tampering(id_col, text_col)
    made = manifest(df, columns, id_col, tree_col, changed, where)
    name = lambda c: beside(id_col, c)
    fold = folded(F.col(name("steps")), F.col(name("given")))
    out = made.select(id_col, *[name(c) for c in ("leaf", "subroot", "root")], _digest(siblings(F.col(name("steps")))).alias(name("proof_sha256")), fold.alias(name("folded_root")))
    return out.withColumn(name("verified"), F.col(name("folded_root")) == F.col(name("root")))
