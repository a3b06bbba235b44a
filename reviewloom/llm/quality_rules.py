"""Quality rules as a short-circuit cascade.

Measures are built-in expressions over a text's words and lines. Each rule is a
predicate over them; a document is kept if no rule rejects it. On a bounded
sample the cascade estimates what each rule costs and how much it rejects, then
orders the rules by rejection per cost, the best first, counting at each step
only what the rules before it leave. A rule's cost is the mean number of steps
that its predicate takes on a sampled text (characters passed over, lines looked
at), which it states as an expression: counted, not timed, so equal samples give
equal orders. The rules become one nested CASE, so a rule is evaluated only where
all before it passed. The order changes cost, never the verdict.

Nulls and odd input: a null text has no words and fails the base rule, as does an
empty one. Every row of the input gives one row, repeated rows and null ids
included. An empty table gives an empty result. Other columns are not read and
may have any name; an output that has the id's name gets an underscore before it.
Rules of equal rejection per cost keep the order in which they are given. Texts of
any length are measured whole.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.shared import beside, let, written

#: Fixed value: white space between words.
SPACE = r"[\x20\x09-\x0D]+"
#: Fixed value: characters that count as symbols.
SYMBOLS = r"#*$%&|<>"
#: Words in a window of the repetition measure.
WINDOW = 5
#: Rows that cost and selectivity are estimated on, at most.
SAMPLE_ROWS = 2000
#: Parts that the sample is written in.
SAMPLE_PARTS = 8

#: The white space of SPACE as a plain string, and A to Z.
_BLANKS = " \t\n\x0b\x0c\r"
_CAPITALS, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def words_of(text: Column) -> Column:
    """The words of a text in order; no word for null."""
    inner = F.trim(F.coalesce(text, F.lit("")), F.lit(_BLANKS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACE))


def _without(text: Column, characters: str) -> Column:
    """``text`` without these characters; replacing one at a time stays on bytes, which is faster than ``translate``."""
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def word_chars(text: Column) -> Column:
    """Code points outside of white space."""
    return F.length(_without(F.coalesce(text, F.lit("")), _BLANKS)).cast("long")


def symbol_count(text: Column) -> Column:
    some = F.coalesce(text, F.lit(""))
    return (F.length(some) - F.length(_without(some, SYMBOLS))).cast("long")


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x, F.lit(_BLANKS)) != "")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that are equal to an earlier line."""
    return let(lines_with_words(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def repeated_words(words: Column) -> Column:
    """Words inside windows of WINDOW words that occur twice or more in the text, the first occurrence included.

    A window's key is a 64-bit hash of its words' 64-bit hashes; keys are compared
    within one text only. Texts whose keys all differ, nearly all, need no sort.
    """

    def keys(h: Column) -> Column:
        return F.transform(F.slice(h, 1, F.greatest(F.size(h) - (WINDOW - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, WINDOW)]))

    def covered(starts: Column) -> Column:
        # Each start covers WINDOW words, or as many as there are up to the next start.
        return F.aggregate(F.transform(starts, lambda s, i: F.least(F.coalesce(F.get(starts, i + 1) - s, F.lit(WINDOW)), F.lit(WINDOW))), F.lit(0), lambda a, x: a + x)

    def repeats(k: Column) -> Column:
        order = F.sort_array(F.transform(k, lambda x, i: F.struct(x.alias("k"), i.alias("i"))))
        twice = let(order, lambda s: F.filter(s, lambda x, j: F.coalesce(F.get(s, j + 1)["k"] == x["k"], F.lit(False)) | F.coalesce(F.get(s, j - 1)["k"] == x["k"], F.lit(False))))
        return let(F.sort_array(F.transform(twice, lambda x: x["i"])), covered)

    count = let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: let(keys(h), lambda k: F.when(F.size(F.array_distinct(k)) < F.size(k), repeats(k)).otherwise(0)))
    return count.cast("long")


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def _share_above(part: Column, whole: Column, percent: int) -> Column:
    return part * 100 > whole * percent


@dataclass(frozen=True)
class Rule:
    """A named predicate, true where a text is rejected, and the steps that it takes on a text.

    Both may use the text column ``text`` and measure columns; ``steps`` is 1 for
    arithmetic on measures.
    """

    name: str
    rejects: Callable[[], Column]
    steps: Callable[[], Column] = lambda: F.lit(1)


_CHARS: Callable[[], Column] = lambda: F.octet_length(_text())

#: The cascade's rules; they leave ordinary prose in any language alone.
RULES = (
    Rule("symbols", lambda: F.col("n_symbols") * 10 > F.col("n_words") * 3),
    Rule("repeated_lines", lambda: F.col("n_dup_lines") * 10 > F.size(F.split(_text(), "\n")) * 3, _CHARS),
    Rule("word_length", lambda: (F.col("word_chars") < F.col("n_words") * 2) | (F.col("word_chars") > F.col("n_words") * 25)),
    Rule("shouting", lambda: _share_above(F.length(_text()) - F.length(_without(_text(), _CAPITALS)), F.col("word_chars"), 50), lambda: _CHARS() * len(_CAPITALS)),
    Rule("numbers", lambda: _share_above(F.length(_text()) - F.length(_without(_text(), _DIGITS)), F.col("word_chars"), 50), lambda: _CHARS() * len(_DIGITS)),
    Rule("unbroken", lambda: (F.col("word_chars") >= 1000) & _text().rlike(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]{1000}"), lambda: F.when(F.col("word_chars") >= 1000, _CHARS() * 4).otherwise(1)),
    Rule("bullets", lambda: let(lines_with_words(F.col("text")), lambda x: _share_above(F.size(F.filter(x, lambda y: y.rlike("^[ \t]*[-*\u2022]"))), F.size(x), 90)), lambda: _CHARS() * 2),
    Rule("ellipses", lambda: let(lines_with_words(F.col("text")), lambda x: _share_above(F.size(F.filter(x, lambda y: y.rlike("(\\.\\.\\.|\u2026)[ \t\r]*$"))), F.size(x), 30)), lambda: _CHARS() * 3),
)


def measured(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    text = F.col("text")
    rows = df.select(F.col(id_col), F.col(text_col).alias("text")).withColumn("words", words_of(text))
    out = rows.select(
        id_col,
        "text",
        F.size("words").cast("long").alias("n_words"),
        word_chars(text).alias("word_chars"),
        symbol_count(text).alias("n_symbols"),
        duplicate_lines(text).alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
    )
    return out.withColumn("base_failed", (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20))


def order_rules(sample: DataFrame, rules: Sequence[Rule]) -> list[tuple[Rule, float, float]]:
    """(rule, mean steps on the sample, share it rejects of what reaches it), best rejection per cost first.

    ``sample`` is measured and bounded; what the driver gets is one row for each
    combination of verdicts, a number that the rules bound.
    """
    passed = sample.where("NOT base_failed")
    steps = passed.agg(*[F.coalesce(F.avg(r.steps()), F.lit(1.0)).alias(f"s{i}") for i, r in enumerate(rules)]).first()
    cost = {r.name: max(1.0, float(steps[i])) for i, r in enumerate(rules)}
    names = [r.name for r in rules]
    combos = passed.groupBy(*[F.coalesce(r.rejects(), F.lit(False)).alias(r.name) for r in rules]).count().collect()
    left, order = list(rules), []
    while left:
        total = sum(c["count"] for c in combos)
        rate = {r.name: sum(c["count"] for c in combos if c[r.name]) / max(total, 1) for r in left}
        best = max(left, key=lambda r: (rate[r.name] / cost[r.name], -cost[r.name], -names.index(r.name)))
        order.append((best, cost[best.name], rate[best.name]))
        combos = [c for c in combos if not c[best.name]]
        left.remove(best)
    return order


def sampled(df: DataFrame, rows: int) -> DataFrame:
    """About four fifths of ``rows`` rows from all over ``df``, or all of a small table.

    Each row is drawn by itself, so no partition gives more than its share and no
    task gets them all; more than ``rows`` come about once in 1e20 times.
    """
    n = df.count()
    return df.sample(False, min(1.0, 0.8 * rows / max(n, 1)), seed=7) if n > rows else df


def cascade(order: Sequence[Rule]) -> Column:
    """Name of the first rule in this order that rejects, else null; later rules are not evaluated."""
    out = F.lit(None).cast("string")
    for r in reversed(order):
        out = F.when(r.rejects(), F.lit(r.name)).otherwise(out)
    return out


def apply_rules(df: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Measures, ``base_failed`` and ``kept`` for each row of ``df``; the base rule stands first."""
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sample = measured(sampled(texts, sample_rows).repartition(SAMPLE_PARTS), "id")
    order = [r for r, _, _ in order_rules(written(sample, "rules-sample"), rules)]
    rows = measured(texts, "id")
    kept = ~F.col("base_failed") & F.when(F.col("base_failed"), F.lit(False)).otherwise(cascade(order).isNull())
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    return rows.select(F.col("id").alias(id_col), *[F.col(c).alias(beside(id_col, c)) for c in names], kept.alias(beside(id_col, "kept")))
