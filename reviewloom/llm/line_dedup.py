"""Line dedup by a log-template tree.

Lines are parsed down a tree of fixed depth: by token count, then by the leading
tokens, tokens with a digit standing for any value. What is left of a line in its
leaf, with such values masked, is its form. A leaf with several forms is
generalised: at each further position the token that most of its forms share is
constant and the others are variable, and forms that agree with enough of the
leaf become one template. The other forms of the leaf are divided by their token
at the position that has the fewest different ones, and each part is generalised
like a leaf, until no part has enough forms; so a leaf may hold many templates.
Templates that recur across documents are dropped, in every document.

A template recurs if it is in ``MIN_DOCUMENTS`` or more different texts in
different surroundings. Copies and near copies of one document repeat its lines
too, which is for document dedup to handle. So each text carries ``BANDS``
sketches of how its lines open, blank ones left out: each sketch joins two values,
each drawn from all openings by a hash. Two texts agree in a sketch about as often
as the square of the share of openings they have in common, so a block of many
lines in otherwise different documents makes few agree, and near copies nearly
all. A template is left alone if, on average over the sketches, more than
``ONE_ORIGIN`` of its texts share the most frequent value; where it has few texts,
so that chance weighs more, a smaller part is enough (``_recurring``). Lines of
``LONG_TOKENS`` or more tokens recur from two texts on. Lines of fewer than
``MIN_TOKENS`` tokens are too short for a template: they recur as they are, digits
included, and only if they have a letter.

Nulls and odd input: a null or empty text has no line to drop and stays as it is.
Null ids are rows like any other. Repeated rows get equal results; equal texts
count once. Ties: of tokens that equally many forms share the greatest counts, of
positions that divide equally well the first. An empty table gives an empty
result. All columns are passed on, whatever their names. Lines and texts of any
length are read whole, and the work is linear in their lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.shared import hot_join, let, tables_made, written

#: Different texts that a template has to be in.
MIN_DOCUMENTS = 3
#: Share of a template's texts from one origin up to which it recurs, where it has many texts.
ONE_ORIGIN = 0.7
#: Sketches of a text's openings.
BANDS = 32
#: Tokens of a line from which it is parsed; shorter ones are compared as they are.
MIN_TOKENS = 5
#: Tokens of a line from which two different texts are enough.
LONG_TOKENS = 10
#: Leading tokens on the way to a leaf, and in an opening.
DEPTH, OPENING = 3, 2
#: Share of a leaf's forms that makes a token constant, and share of a form's tokens that must agree with the leaf.
CONSTANT, AGREE = 0.5, 0.7
#: Fixed value: stands for a variable field.
FIELD = "<*>"
#: Buckets of the first, bounded filter for leaves; a power of two.
LEAF_BUCKETS = 1 << 18
#: White space within a line, as a plain string and as a pattern.
_BLANKS, _BLANK_RUN = " \t\r\x0b\x0c", r"[ \t\r\x0b\x0c]+"


def _lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, digest, i, line, norm, n) of every line of the texts; ``norm`` has single blanks and masked values, ``n`` is its tokens.

    Filters on what is computed here would be pushed below and evaluate it twice, so
    the outer form of the generator is used, and callers filter what they have written.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    lines = rows.select(_key(F.col("id"), F.col("text")).alias("key"), F.xxhash64("text").alias("digest"), F.posexplode_outer(F.split("text", "\n")).alias("i", "line"))
    line = F.col("line")
    # Most lines are in this form already.
    odd = line.rlike(r"[0-9\t\r\x0b\x0c]") | F.contains(line, F.lit("  "))
    # A word is looked at from its start only, else an unbroken megabyte is tried at each character.
    masked = F.regexp_replace(F.regexp_replace(line, r"(?<!\S)[^\s0-9]*+[0-9]\S*+", FIELD), _BLANK_RUN, " ")
    normed = lines.withColumn("norm", F.trim(F.when(odd, masked).otherwise(line)))
    return normed.withColumn("n", F.octet_length("norm") - F.octet_length(F.replace("norm", F.lit(" "), F.lit(""))) + 1)


def _leaf() -> Column:
    """The leaf of a line; that of one with fewer than ``MIN_TOKENS`` tokens is not used."""
    return F.xxhash64("n", F.substring_index("norm", " ", DEPTH))


def _form() -> Column:
    """A line's form; null for a short one without a letter."""
    short = F.when(F.col("line").rlike(r"\p{L}"), F.xxhash64(F.trim("line", F.lit(_BLANKS))))
    return F.when(F.col("n") >= MIN_TOKENS, F.xxhash64("norm")).otherwise(short)


def _key(row_id: Column, text: Column) -> Column:
    return F.xxhash64(row_id, row_id.isNull(), F.xxhash64(text))


def _sketched(seen: DataFrame) -> DataFrame:
    """(digest, bands): ``BANDS`` sketches of a text's openings; each joins two of ``BANDS`` picks, the hashes nearest to fixed ones."""
    picks = [F.min(F.col("opening").bitwiseXOR(F.xxhash64(F.lit(f"origin {j}")))).alias(f"p{j}") for j in range(BANDS)]
    drawn = seen.groupBy("digest").agg(*picks)
    return drawn.select("digest", F.array(*[F.xxhash64(f"p{j}", f"p{(j + 1) % BANDS}") for j in range(BANDS)]).alias("bands"))


def _recurring(pairs: DataFrame, bands: DataFrame, by: list[str], least: Column) -> DataFrame:
    """(by): the values of ``by`` in ``least`` or more texts that are not of one origin; ``pairs`` has each (by, digest) once.

    Of n texts, the first that shares a sketch's most frequent value says nothing: the
    share is that of the others, and the bar is ``ONE_ORIGIN`` less 1 / n.
    """
    sketched = pairs.join(bands, "digest").select(*by, F.posexplode("bands").alias("band", "sketch"))
    sizes = sketched.groupBy(*by, "band", "sketch").agg(F.count(F.lit(1)).alias("n"))
    tops = sizes.groupBy(*by, "band").agg(F.sum("n").alias("docs"), F.max("n").alias("top"))
    shares = tops.groupBy(*by).agg(F.max("docs").alias("docs"), F.sum(F.col("top") - 1).alias("shared"))
    return shares.where((F.col("docs") >= least) & (F.col("shared") <= BANDS * (F.col("docs") - 1) * (ONE_ORIGIN - 1 / F.col("docs")))).select(by[0])


def _leaf_forms(df: DataFrame, id_col: str, text_col: str, forms: DataFrame) -> DataFrame:
    """(leaf, form, tokens) of the forms in leaves of enough forms, a row each."""
    leaves = forms.where(F.col("n") >= MIN_TOKENS).groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_DOCUMENTS).select("leaf")
    leaves = written(leaves, "leaves")
    # At most LEAF_BUCKETS numbers are broadcast; they spare most lines the exact join.
    near = F.broadcast(leaves.select(F.col("leaf").bitwiseAND(LEAF_BUCKETS - 1).alias("bucket")).distinct())
    lines = _lines(df, id_col, text_col).select("norm", _leaf().alias("leaf"))
    some = lines.withColumn("bucket", F.col("leaf").bitwiseAND(LEAF_BUCKETS - 1)).join(near, "bucket", "left_semi")
    # Each form once, before the exact join: a hot line is one row from here on.
    distinct = some.groupBy("leaf", F.xxhash64("norm").alias("form")).agg(F.first("norm").alias("norm"))
    mine = hot_join(written(distinct, "near-forms"), leaves, "leaf")
    return written(mine.select("leaf", "form", F.split("norm", " ").alias("tokens")), "leaf-forms")


def _templates(forms: DataFrame) -> DataFrame:
    """(form, template) of the forms (leaf, form, tokens) that belong to a template.

    Each round takes the forms that agree with their node out and divides the
    others; a node of two or more forms has a position that divides them, so the
    rounds end.
    """
    nodes, found = forms.select(F.col("leaf").alias("node"), "form", "tokens"), None
    while True:
        votes = nodes.select("node", F.posexplode("tokens")).groupBy("node", "pos", "col").agg(F.count(F.lit(1)).alias("n"))
        best = votes.groupBy("node", "pos").agg(F.max(F.struct("n", "col")).alias("best"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("values"))
        constant = F.when(F.col("best.n") >= F.col("all") * CONSTANT, F.col("best.col"))
        divider = F.min(F.when(F.col("values") > 1, F.struct("values", "pos")))["pos"]
        shapes = best.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("pos", constant.alias("token")))).alias("shape"), divider.alias("divider"))
        agreeing = F.size(F.filter(F.zip_with("tokens", "shape", lambda t, s: t == s["token"]), lambda x: F.coalesce(x, F.lit(False))))
        judged = written(hot_join(nodes, shapes, "node").withColumn("agrees", agreeing >= F.size("tokens") * AGREE).drop("shape"), "judged-forms")
        agreed = judged.where("agrees").select("form", F.col("node").alias("template"))
        found = agreed if found is None else found.unionByName(agreed)
        rest = judged.where("NOT agrees").select(F.xxhash64("node", "divider", F.get("tokens", F.col("divider"))).alias("node"), "form", "tokens")
        enough = rest.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_DOCUMENTS).select("node")
        nodes = written(hot_join(rest, enough, "node"), "divided-forms")
        if nodes.isEmpty():
            return written(found, "template-forms")


def drop_recurring_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, text, n_lines, n_dropped): the original row as a struct, and its text without recurring lines."""
    opening = F.xxhash64(F.substring_index("norm", " ", OPENING))
    seen = written(_lines(df, id_col, text_col).select("key", "digest", "i", "n", _leaf().alias("leaf"), _form().alias("form"), opening.alias("opening")), "lines").where("form IS NOT NULL")
    with tables_made(df.sparkSession) as drop_but:
        bands = written(_sketched(seen), "sketches")
        # A form is in several texts if the least and the greatest digest differ; equal texts count once.
        least = F.when(F.col("n") >= LONG_TOKENS, 2).otherwise(MIN_DOCUMENTS).alias("least")
        forms = seen.groupBy("form").agg(F.first("leaf").alias("leaf"), F.first("n").alias("n"), (F.min("digest") < F.max("digest")).alias("several"), F.count(F.lit(1)).alias("n_rows"))
        forms = written(forms, "forms")
        counted = (forms, "n_rows")
        often = hot_join(seen.select("digest", "form"), forms.where("several").select("form", least), "form", counts=counted)
        direct = _recurring(often.distinct(), bands, ["form", "least"], F.col("least"))

        matched = _templates(_leaf_forms(df, id_col, text_col, forms))
        # The texts of a template's forms are put together.
        texts = hot_join(seen.select("digest", "form"), matched, "form", counts=counted).select("template", "digest").distinct()
        templates = written(_recurring(texts, bands, ["template"], F.lit(MIN_DOCUMENTS)), "templates")
        dropped = written(direct.unionByName(hot_join(matched, templates, "template").select("form")).distinct(), "dropped-forms")

        hits = hot_join(seen.select("key", "digest", "i", "form"), dropped, "form", counts=counted)
        drop_but(("lines", "dropped-forms"))
    lists = hits.groupBy("key", "digest").agg(F.collect_set("i").alias("gone"))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), _key(F.col(id_col), F.col(text_col)).alias("key"), F.xxhash64(text_col).alias("digest"), F.col(text_col).alias("text"))
    joined = rows.join(lists.hint("shuffle_hash"), ["key", "digest"], "left")
    stay = lambda lines: F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "gone"), lambda j: F.get(lines, j))
    return joined.select(
        "row",
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(let(F.split("text", "\n"), stay), "\n")).alias("text"),
        F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )
