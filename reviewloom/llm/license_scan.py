"""License scans by canonical digest lookup.

A text's canonical form drops what does not change a licence: case, punctuation,
white space, copyright lines and spelling variants. Its SHA-256 is then looked
up, by a hash join on the digest, among the digests of known licence texts. A
unit of lookup is an entire text: a document as a whole, and each of its
paragraphs (between lines without a letter or digit) and lines as a whole, so that
a notice at the end of a document, on one line or wrapped over several, is found
and a mere mention within a sentence is not.

Nulls and odd input: a null text has no unit and no licence; an empty text, or
one whose canonical form is empty, matches nothing. Every row of the input gives
one row, repeated rows and null ids included; an empty table gives an empty
result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.llm.shared import ascii_lower, let, spread_join

#: Known notices by SPDX id.
KNOWN = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "This work is licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
)
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"""
_MIT_REST = """The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_2 = """1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_REST = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
#: Full texts, with and without a title, and the paragraphs that open them or stand in file headers.
TEXTS = (
    *(("MIT", f"{title}\n\n{_MIT}\n\n{_MIT_REST}") for title in ("", "MIT License", "The MIT License", "The MIT License (MIT)")),
    *(("BSD-2-Clause", f"{title}\n\n{_BSD}\n\n{_BSD_2}\n\n{_BSD_REST}") for title in ("", "BSD 2-Clause License")),
    *(("BSD-3-Clause", f"{title}\n\n{_BSD}\n\n{_BSD_2}\n\n{_BSD_3}\n\n{_BSD_REST}") for title in ("", "BSD 3-Clause License")),
    ("MIT", _MIT),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
)
#: Digests of the long texts as published: (SPDX id, digest of the canonical form, its words). Each has the word "license".
LONG_TEXTS = (
    ("Apache-2.0", "95f35d79ea3bab75c250549d6a03cef242e0547d78c99e26fcede49936fb0184", 1608),
    ("GPL-2.0", "cf74dfa78ca9ac981c7ae9e50c4ecfb828df2e5ef2f1646368388676215766b5", 2975),
    ("GPL-3.0", "68ca42869e9a3e25843be66c6f296ce2b1f3629ac71d77465db0636dc8781c06", 5684),
    ("LGPL-2.1", "ac0856eb11aebb30c08445444c942c1ddcde9d0a0447c9ed2b8a19ab7d51eba5", 4401),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be", 1231),
    ("MPL-2.0", "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a", 2426),
)
#: Lines without a letter or digit between paragraphs; no group is repeated, as that recurses for each line.
BETWEEN_PARAGRAPHS = r"\n[^\p{L}\p{N}]*\n"
#: Equivalent spellings, as (words, their one form), applied to the spaced canonical text.
SPELLINGS = (
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("sublicence", "sublicense"),
    ("sub license", "sublicense"),
    ("non commercial", "noncommercial"),
    ("copyright holder", "copyright owner"),
    ("acknowledgement", "acknowledgment"),
    ("favour", "favor"),
    ("per cent", "percent"),
    ("v2 0", "version 2 0"),
    ("v3", "version 3"),
)
#: A line that says whose copyright it is, with a sign or a year (in lower-cased text); a wrapped line that only begins with the word is none.
COPYRIGHT_LINE = r"(^|\n)[ \t]*[^a-z0-9\n]{0,6}(copyright[ \t]*(\(c\)|©|[^\n]{0,60}[0-9]{4})|\(c\)[ \t]*(copyright|[^\n]{0,60}[0-9]{4})|©|all rights reserved)[^\n]*"


def canonical(text: Column) -> Column:
    """Lower case, no copyright lines, single-spaced words of letters and digits, one spelling."""
    trigger = r"copyright|\(c\)|©|all rights reserved"

    def rest(low: Column) -> Column:
        # Copyright lines are looked for only where one of their words is.
        bare = F.when(low.rlike(trigger), F.regexp_replace(low, COPYRIGHT_LINE, "\n")).otherwise(low)
        # Each word has its own blanks on both sides, so that equal words in a row are all replaced.
        out = F.concat(F.lit(" "), F.trim(F.regexp_replace(bare, r"[^\p{L}\p{N}]+", "  ")), F.lit(" "))
        for words, one in SPELLINGS:
            out = F.replace(out, F.lit(f" {words.replace(' ', '  ')} "), F.lit(f" {one.replace(' ', '  ')} "))
        return F.trim(F.replace(out, F.lit("  "), F.lit(" ")))

    return let(ascii_lower(text), rest)


def _words(canon: Column) -> Column:
    return F.length(canon) - F.length(F.replace(canon, F.lit(" "), F.lit(""))) + 1


def known_digests(spark: SparkSession, known: Sequence[tuple[str, str]] = KNOWN + TEXTS, long_texts: Sequence[tuple[str, str, int]] = LONG_TEXTS) -> DataFrame:
    """(digest, license, canon, n_words) of the canonical forms; a digest that two licences share takes the first by name.

    Of ``long_texts`` only the digests are known; ``canon`` then is a word that they have.
    """
    rows = spark.range(0).select(F.lit("").alias("license"), F.lit("").alias("body"))
    if known:
        rows = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(i).alias("license"), F.lit(t).alias("body")) for i, t in known])))
    rows = rows.withColumn("canon", canonical(F.col("body"))).where("canon <> ''")
    rows = rows.select("license", F.sha2("canon", 256).alias("digest"), "canon", _words(F.col("canon")).alias("n_words"))
    if long_texts:
        cells = [F.struct(F.lit(i).alias("license"), F.lit(d).alias("digest"), F.lit("license").alias("canon"), F.lit(n).alias("n_words")) for i, d, n in long_texts]
        rows = rows.unionByName(spark.range(1).select(F.inline(F.array(*cells))))
    return rows.groupBy("digest").agg(F.min("license").alias("license"), F.first("canon").alias("canon"), F.first("n_words").alias("n_words"))


def anchors(digests: DataFrame) -> list[str]:
    """Words that every known form has at least one of, or within a word, chosen greedily, with all their raw spellings.

    A unit whose lower-cased text contains none of them can't match: a canonical
    word is a run of the raw text, or comes from one of its spelling variants.
    The known forms were given by the caller as literals, so their words fit the driver.
    """
    forms = [set(r.canon.split(" ")) for r in digests.select("canon").collect()]
    chosen: list[str] = []
    while forms:
        counts: dict[str, int] = {}
        for f in forms:
            for w in f:
                counts[w] = counts.get(w, 0) + 1
        best = max(counts, key=lambda w: (counts[w] * min(len(w), 12) ** 2, w))
        chosen.append(best)
        forms = [f for f in forms if not any(best in w for w in f)]
    raw = set(chosen)
    while True:
        # A spelling's words may themselves be the one form of others.
        more = {max(words.split(" "), key=len) for words, one in SPELLINGS if raw & set(one.split(" "))} - raw
        if not more:
            return sorted(raw)
        raw |= more


def scan_licenses(df: DataFrame, digests: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, license, scope, n_notices) for each row of ``df``.

    ``license`` has the distinct ids found, sorted and joined by ``;`` (null: none);
    ``scope`` is ``text`` if the document as a whole is a known text, ``line`` if
    only lines or paragraphs of it are, else null; ``n_notices`` counts the matching
    units: the whole text if it matches, else the lines that do and the paragraphs
    of several lines that are no such line without its copyright lines. A unit whose canonical form
    has fewer or more words than any known one can't match and gets no digest.
    ``digests`` is as :func:`known_digests` makes it; a notice may be
    in a third of all documents, so units are not dealt by digest for the join.
    """
    bound = digests.agg(F.min("n_words").alias("least"), F.max("n_words").alias("most"), F.sum(F.octet_length("license") + 256).alias("size")).first()
    lines = F.split("body", "\n")
    none = F.array().cast("array<string>")
    parts = F.when(F.size(lines) > 1, lines).otherwise(none)
    # One line between blank ones is a unit already, and one paragraph is the whole text.
    paragraphs = F.split("body", BETWEEN_PARAGRAPHS)
    wrapped = F.when(F.size(paragraphs) > 1, F.filter(paragraphs, lambda x: F.contains(x, F.lit("\n")))).otherwise(none)
    # Only texts with a word that every match needs are taken apart.
    low = F.lower("body")
    possible = F.lit(False)
    for word in anchors(digests):
        possible = possible | F.contains(low, F.lower(F.lit(word)))
    least, most = bound["least"] or 0, bound["most"] or -1

    def unit(whole: bool, x: Column) -> Column:
        digest = let(canonical(x), lambda c: F.when((c != "") & _words(c).between(least, most), F.sha2(c, 256)))
        return F.struct(F.lit(whole).alias("whole"), digest.alias("digest"))

    def units_of(of_lines: Column) -> Column:
        # Digests of paragraphs that are lines too are found once, as there may be many of either.
        known = F.transform(of_lines, lambda y: F.coalesce(y["digest"], F.lit("")))
        others = lambda more: let(F.array_intersect(F.transform(more, lambda x: x["digest"]), known), lambda both: F.filter(more, lambda x: ~F.array_contains(both, x["digest"])))
        return F.concat(F.array(unit(True, F.col("body"))), of_lines, let(F.transform(wrapped, lambda x: unit(False, x)), others))

    every = let(F.transform(parts, lambda x: unit(False, x)), units_of)
    units = F.when(F.coalesce(possible, F.lit(False)), every).otherwise(F.array(unit(True, F.lit(None).cast("string"))))
    # The row's number is taken before the units are unfolded.
    numbered = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("body")).withColumn("row", F.monotonically_increasing_id())
    hashed = numbered.select("row", "id", F.inline(units)).where("whole OR digest IS NOT NULL")
    # A row without digest matches nothing; rows are spread by their number, so they are no hot key.
    found = spread_join(hashed, digests.select("digest", "license"), ["digest"], bound["size"] or 0, ["row", "whole"], "left", 64)
    got = F.col("license").isNotNull()
    per = found.groupBy("row").agg(
        F.first("id").alias("id"),
        F.max(got & F.col("whole")).alias("entire"),
        F.sum((got & ~F.col("whole")).cast("long")).alias("n_lines"),
        F.min(F.when(F.col("whole"), F.col("license"))).alias("of_text"),
        F.array_join(F.sort_array(F.collect_set(F.when(~F.col("whole"), F.col("license")))), ";").alias("of_lines"),
    )
    return per.select(
        F.col("id").alias(id_col),
        F.when(F.col("entire"), F.col("of_text")).otherwise(F.nullif("of_lines", F.lit(""))).alias("license"),
        F.when(F.col("entire"), "text").when(F.col("n_lines") > 0, "line").alias("scope"),
        F.when(F.col("entire"), 1).otherwise(F.col("n_lines")).cast("long").alias("n_notices"),
    )
