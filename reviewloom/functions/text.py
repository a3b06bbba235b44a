"""String semantics of the data contracts as Spark columns.

The producers of the data trim and cut text by different rules, so bare ``trim``
is never right: use ``js_trim`` for mined records and ``py_strip`` for generated ones.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

def _characters(*ranges: str) -> str:
    """All characters of ranges, each given by its first and last one."""
    return "".join(chr(c) for r in ranges for c in range(ord(r[0]), ord(r[-1]) + 1))


#: Ranges of characters that each kind of trimming removes.
_JS_SPACE = _characters("\u0009\u000d", "\u0020", "\u00a0", "\u1680", "\u2000\u200a", "\u2028", "\u2029", "\u202f", "\u205f", "\u3000", "\ufeff")
_PY_SPACE = _characters("\u0009\u000d", "\u001c\u0020", "\u0085", "\u00a0", "\u1680", "\u2000\u200a", "\u2028", "\u2029", "\u202f", "\u205f", "\u3000")
PY_LINE_END = r"\r\n|[\n\r\u000B\u000C\u001C-\u001E\u0085\u2028\u2029]"
#: Longest evidence and longest source in a review prompt.
EVIDENCE_CHARS, REVIEW_CHARS = 300, 20_000


def js_trim(c: Column) -> Column:
    return F.trim(c, F.lit(_JS_SPACE))


def py_strip(c: Column) -> Column:
    return F.trim(c, F.lit(_PY_SPACE))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def truncate(c: Column, n: int = EVIDENCE_CHARS) -> Column:
    """The first n UTF-16 units and ``...`` if there are more; half of a character at the cut is shown as U+FFFD."""
    wide = F.encode(c, "UTF-16BE")
    whole = F.hex(F.substring(wide, 2 * n - 1, 1)).between("D8", "DB")
    cut = F.when(whole, F.concat(F.decode(F.substring(wide, 1, 2 * n - 2), "UTF-16BE"), F.lit("\ufffd"))).otherwise(F.decode(F.substring(wide, 1, 2 * n), "UTF-16BE"))
    # No text of at most n bytes has more than n units.
    return F.when((F.octet_length(c) > n) & (F.octet_length(wide) > 2 * n), F.concat(cut, F.lit("..."))).otherwise(c)


def first_keyword(c: Column, keywords: Sequence[str] | Column) -> Column:
    """The first keyword, in the order of the list, that the lower-cased text contains anywhere."""
    words = keywords if isinstance(keywords, Column) else F.array(*map(F.lit, keywords))
    low = F.lower(c)
    return F.try_element_at(F.filter(words, lambda k: F.contains(low, k)), F.lit(1))


def ecosystem_hint(framework: Column, library: Column, database: Column) -> Column:
    """`` (using a, b)`` from the parts that are neither null nor empty, else empty."""
    parts = F.filter(F.array(framework, library, database), lambda x: x.isNotNull() & (x != ""))
    return F.when(F.size(parts) > 0, F.concat(F.lit(" (using "), F.array_join(parts, ", "), F.lit(")"))).otherwise("")


def prompt(language: Column, hint: Column, code: Column) -> Column:
    """Text around a record's language, hint and code."""
    return F.concat(
        F.lit("### Task\nReview the following "), language, F.lit(" code"), hint,
        F.lit(". Identify the single most\nimportant finding: its category, severity, confidence, and a one-sentence\nsummary.\n\n### Code\n```\n"),
        code, F.lit("\n```\n\n### Finding\n"),
    )


def target(category: Column, severity: Column, confidence: Column, summary: Column) -> Column:
    """The keys of a target's lines."""
    return F.concat(F.lit("category: "), category, F.lit("\nseverity: "), severity, F.lit("\nconfidence: "), confidence, F.lit("\nsummary: "), summary, F.lit("\n"))


def parse_finding(c: Column) -> Column:
    """category, severity, confidence and summary of generated ``key: value`` lines; the last line of a key wins."""
    pairs = F.transform(
        F.filter(F.split(c, PY_LINE_END), lambda x: F.contains(x, F.lit(":"))),
        lambda x: F.struct(F.lower(py_strip(F.substring_index(x, ":", 1))).alias("k"), py_strip(F.substr(x, F.instr(x, ":") + 1)).alias("v")),
    )
    last = lambda key: F.try_element_at(F.filter(pairs, lambda p: p["k"] == key), F.lit(-1))["v"].alias(key)
    return F.struct(*[last(k) for k in ("category", "severity", "confidence", "summary")])


#: What a chat model is told before a review request, unless the caller says something else.
REVIEW_SYSTEM_PROMPT = (
    "You help with code review. You get a file and what a static analyzer has reported for it, as JSON. "
    "Say in a few plain sentences what should be mended first and why, and what one has to know about the code for that. "
    "Keep to the reports given, and don't copy their JSON."
)


def firsts_of(batches: Iterator[pa.Array], keywords: Sequence[str]) -> Iterator[pa.Array]:
    """The first keyword of each lower-cased text, by an automaton of all of them; one text at a time is a string."""
    listed = list(dict.fromkeys(keywords))
    automaton = ahocorasick.Automaton()
    for i, k in enumerate(listed):
        if k:
            automaton.add_word(k, i)
    if len(automaton):
        automaton.make_automaton()
    always = listed.index("") if "" in listed else len(listed)

    def first(text: str | None) -> str | None:
        if text is None:
            return None
        best = min((i for _, i in automaton.iter(text)), default=len(listed)) if len(automaton) else len(listed)
        best = min(best, always)
        return listed[best] if best < len(listed) else None

    for texts in batches:
        yield pa.array((first(t.as_py()) for t in texts), pa.string())


def first_of_many(c: Column, keywords: Sequence[str]) -> Column:
    """As :func:`first_keyword`, for hundreds of keywords: one pass over the text whatever their number.

    An automaton of all keywords is made once in each task (Arrow batches); of those that
    the lower-cased text contains, the first in the list is given. A null text has none; an
    empty keyword is in every text. A task holds one batch as it comes from Spark (64 MB or one row at most), not its texts as strings.
    """
    keywords = list(keywords)

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return firsts_of(batches, keywords)

    return run(F.lower(c))


def review_prompt(path: Column, source: Column, findings_json: Column) -> Column:
    """A file's review request; an unreadable source is empty, a long one is cut."""
    code = F.substring(F.coalesce(source, F.lit("")), 1, REVIEW_CHARS)
    return F.concat(F.lit("File: "), path, F.lit("\n\n```\n"), code, F.lit("\n```\n\nFindings:\n"), findings_json)
