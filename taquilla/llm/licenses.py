"""Licence scan: canonical digests of whole texts, paragraphs and lines, looked up in a table.

Two texts that differ only in case, punctuation, spacing, copyright lines or equivalent spellings
have one canonical form. Its SHA-256 is joined by hash to the digests of known licence texts and
notices. Everything is column expressions; lines meet the known digests where they are read, and
only lines that match move. The known texts are a parameter: beyond the broadcast threshold the
same join is shuffled.

A known text of several lines may stand above, below or between other content, with other line
breaks. Paragraphs are runs of lines that have words; a blank, punctuation-only or copyright line
ends one. A known text is found where as many paragraphs in a row as it has make up its form, or
where one paragraph of several lines does.
A text wrapped so that a line begins with the word copyright is not found: it passes for a copyright
line.

The table is ``KNOWN`` and the files of ``license_texts``, named by licence: the texts of 17
licences as published, and notices that they tell to put on files. It is no complete list: there
is no Creative Commons text but CC0, no AGPL, EPL or OFL.

Defined results. NULL or empty text: no licence. A text of copyright lines and punctuation alone
is canonically empty and matches nothing. Rows with one id are one document, which holds the
licences of all of them; so are rows with a NULL id.
"""

from __future__ import annotations

from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taquilla.llm.common import written

# Known digests, of about 150 bytes each, that are broadcast; more are joined by shuffling.
MOST_BROADCAST = 10_000
COPYRIGHT_LINE = r"(?i)^[ \t]*(copyright\b|\(c\)|©)[^\n]*$"
# Spellings that licence comparison takes as equal, the canonical one second.
EQUIVALENT = [
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("calibre", "caliber"),
    ("cancelled", "canceled"),
    ("centre", "center"),
    ("emphasised", "emphasized"),
    ("favour", "favor"),
    ("favourite", "favorite"),
    ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labelling", "labeling"),
    ("labour", "labor"),
    ("licence", "license"),
    ("licenced", "licensed"),
    ("maximise", "maximize"),
    ("modelled", "modeled"),
    ("offence", "offense"),
    ("optimise", "optimize"),
    ("organisation", "organization"),
    ("organise", "organize"),
    ("practise", "practice"),
    ("programme", "program"),
    ("realise", "realize"),
    ("recognise", "recognize"),
    ("signalling", "signaling"),
    ("sub license", "sublicense"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "wilfull"),
    ("non commercial", "noncommercial"),
    ("per cent", "percent"),
    ("copyright owner", "copyright holder"),
]
# Short licence texts and notices, as published; longer ones are files.
KNOWN = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.""",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("MIT", "Released under the MIT License."),
    (
        "MIT",
        """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.""",
    ),
    (
        "ISC",
        """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.""",
    ),
    ("LicenseRef-All-Rights-Reserved", "All rights reserved."),
]


def _plain(line: Column) -> Column:
    """Lower-case words of one line; none of a copyright line."""
    words = F.trim(F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}]+", " "))
    return F.when(line.rlike(COPYRIGHT_LINE), "").otherwise(words)


def _line_forms(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), _plain)


def _whole(forms: Column) -> Column:
    return F.array_join(F.array_remove(forms, ""), " ")


def _equal_spellings(form: Column) -> Column:
    padded = F.concat(F.lit(" "), form, F.lit(" "))
    same = reduce(
        lambda t, pair: F.replace(t, F.lit(f" {pair[0]} "), F.lit(f" {pair[1]} ")),
        EQUIVALENT,
        padded,
    )
    return F.trim(same)


def _paragraphs(forms: Column) -> Column:
    """Runs of lines with words; the lines of each are parted by a line end."""
    runs = F.split(F.array_join(forms, "\n"), "\n\n+")
    return F.array_remove(F.transform(runs, lambda x: F.trim(x, F.lit("\n"))), "")


def _on_one_line(paragraph: Column) -> Column:
    return F.replace(paragraph, F.lit("\n"), F.lit(" "))


def _digest(form: Column) -> Column:
    return F.sha2(_equal_spellings(form), 256)


def _file_license(name: str) -> str:
    """Licence of a file: ``MPL-2.0.txt`` and ``MPL-2.0.notice.txt`` are both ``MPL-2.0``."""
    stem = name.removesuffix(".txt")
    kind = stem.rpartition(".")[2]
    return stem.removesuffix(f".{kind}") if kind.isalpha() else stem


def known_rows() -> list[tuple[str, str]]:
    files = sorted((Path(__file__).parent / "license_texts").glob("*.txt"))
    return KNOWN + [(_file_license(f.name), f.read_text("utf-8")) for f in files]


def known_texts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(known_rows(), "license string, text string")


def digests(known: DataFrame) -> DataFrame:
    """One licence per canonical digest, the first by name of several, and the form's length.

    ``starts`` has the ways to divide the text: digest of the first paragraph, and their number.
    """
    forms = _line_forms(F.col("text"))
    form = _equal_spellings(_whole(forms)).alias("form")
    paragraphs = F.col("paragraphs")
    divided = F.struct(
        _digest(_on_one_line(F.element_at(paragraphs, 1))).alias("first"),
        F.size(paragraphs).alias("n"),
    )
    at_once = F.struct(F.sha2("form", 256).alias("first"), F.lit(1).alias("n"))
    return (
        known.select("license", form, _paragraphs(forms).alias("paragraphs"))
        .where("form <> ''")
        .withColumn("starts", F.array(divided, at_once))
        .groupBy(F.sha2("form", 256).alias("digest"))
        .agg(
            F.min("license").alias("license"),
            F.array_distinct(F.flatten(F.collect_list("starts"))).alias("starts"),
            F.max(F.length("form")).alias("length"),
            F.min(F.substring_index("form", " ", 1)).alias("opening"),
        )
    )


def _openings(canonical: set[str]) -> list[str]:
    """First words that a form may have before equivalent spellings are put in."""
    found = set(canonical)
    while True:
        more = {a.split()[0] for a, b in EQUIVALENT if b.split()[0] in found} - found
        if not more:
            return sorted(found)
        found |= more


def matches(docs: DataFrame, known: DataFrame) -> DataFrame:
    """What is a known text: ``doc_id``, ``line``, ``paragraph`` and ``license``.

    ``line`` is the place of a line, ``paragraph`` that of the first of some paragraphs; both are
    NULL where the whole text matches, and then its paragraphs together are no match of their own.

    A text's words are taken out once, line by line; the whole is its lines in a row. A form is
    digested only if it can match: no spelling shrinks to less than half by its equivalent, so it
    must not be over twice as long as every known form, and it must open with a word that one of
    them opens with, or an equivalent of it. What follows a paragraph is looked at only if that
    paragraph begins a known text.
    """
    table = written(digests(known))
    starts = table.select("digest", "license", F.explode("starts").alias("s"))
    starts = written(starts.select("digest", "license", "s.first", "s.n"))
    rows, longest = table.agg(F.count("*"), F.max("length")).first()
    most = starts.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    few = rows <= MOST_BROADCAST
    openings = firsts = None
    if few:
        openings = _openings({r["opening"] for r in table.select("opening").collect()})
        firsts = [r["first"] for r in starts.select("first").distinct().collect()]

    def possible(form: Column) -> Column:
        fits = F.length(form).between(1, 2 * (longest or 0))
        return fits & F.substring_index(form, " ", 1).isin(openings) if few else fits

    def begins(form: Column) -> Column:
        return possible(form) & _digest(form).isin(firsts) if few else possible(form)

    none = F.lit(None).cast("int")

    def unit(form: Column, line: Column = none, at: Column = none, rest: Column | None = None):
        rest = F.lit(None).cast("array<string>") if rest is None else rest
        names = {"form": form, "line": line, "paragraph": at, "rest": rest}
        return F.struct(*(c.alias(n) for n, c in names.items()))

    units = docs.where(F.col("text").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), _line_forms(F.col("text")).alias("forms")
    )
    units = units.withColumn("paragraphs", _paragraphs(F.col("forms")))
    lines = F.transform("forms", lambda x, i: unit(x, i))
    numbered = F.transform(
        "paragraphs", lambda x, i: F.struct(i.alias("at"), _on_one_line(x).alias("form"))
    )
    parts = F.transform(
        F.filter(numbered, lambda p: begins(p["form"])),
        lambda p: unit(p["form"], at=p["at"], rest=F.slice("paragraphs", p["at"] + 1, most)),
    )
    every = F.concat(F.array(unit(_whole(F.col("forms")))), lines, parts)
    # the outer form, as the inner one would make the lines a second time to see if there are any
    found = (
        units.select("doc_id", F.size("paragraphs").alias("total"), F.explode_outer(every).alias("u"))
        .select("doc_id", "total", "u.*")
        .where(possible(F.col("form")))
        .withColumn("first", _digest(F.col("form")))
    )

    # n = 0: what a line or a whole text must be
    entire = table.select("digest", "license", F.col("digest").alias("first"), F.lit(0).alias("n"))
    side = entire.unionByName(starts)
    side = F.broadcast(side) if few else side
    in_a_row = F.array_join(F.slice("rest", F.lit(1), F.col("n")), "\n")
    together = (
        (F.size("rest") >= F.col("n"))
        & (F.col("n") < F.col("total"))
        & in_a_row.contains("\n")
        & (_digest(_on_one_line(in_a_row)) == F.col("digest"))
    )
    return (
        found.join(side, "first")
        .where(F.isnull("paragraph") == (F.col("n") == 0))
        .where(F.isnull("paragraph") | together)
        .select("doc_id", "line", "paragraph", "license")
    )


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Per id: the licence its whole text is, its notices, and all licences found."""
    at = {"at": F.coalesce("doc_id", F.lit(0)), "no": F.isnull("doc_id")}  # NULL ids join too
    place = F.coalesce("line", "paragraph")
    per_doc = matches(docs, known).withColumns(at).groupBy(*at).agg(
        F.min(F.when(F.isnull(place), F.col("license"))).alias("whole_license"),
        F.count(place).alias("n_notices"),
        F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"),
    )
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    return ids.withColumns(at).join(per_doc, list(at), "left").select(
        "doc_id",
        "whole_license",
        F.coalesce("n_notices", F.lit(0)).alias("n_notices"),
        F.coalesce("licenses", F.lit("")).alias("licenses"),
    )
