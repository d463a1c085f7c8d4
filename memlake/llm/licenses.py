"""Licence scans by a canonical digest: entire texts are normalised, hashed and joined to the digests of known licences.

An entire text is a whole document, or one of its lines or paragraphs (documents quote short notices as lines), or the full text of a licence at any place
of a document, however it is broken into lines and paragraphs: a run of as many words. Units that lie in each other count once. Normalising lowers the case, drops copyright statements, brings equivalent spellings together and turns all that is no letter or digit into one space. The known texts pass through the same
expressions. Every known text holds one of ANCHORS, so texts without any can't match and are not normalised.

Defined cases: null and empty texts match nothing; a document may match several licences, one row each; repeated rows count together, by doc_id;
an empty table gives no rows; other columns are ignored. The known table is fixed and small, so it is broadcast.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table, text_of

#: Wordings of licences and their notices.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "BSD-3-Clause": "Licensed under the BSD 3-Clause License.",
    "BSD-2-Clause": "Licensed under the BSD 2-Clause License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "Licensed under CC0 1.0 Universal.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
}
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so{condition}
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted{condition}
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
TEXTS = {
    "MIT": _MIT.format(condition=", subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    "MIT-0": _MIT.format(condition="."),
    "ISC": _ISC.format(condition=", provided that the above copyright notice and this permission notice appear in all copies."),
    "0BSD": _ISC.format(condition="."),
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution.",
}
TITLES = ("the mit license", "mit license", "mit no attribution", "isc license", "zero clause bsd license", "bsd zero clause license", "zlib license", "the zlib license")
#: Full texts as published, one file each; of the licences in NOTICES those of AGPL-3.0, CC-BY-4.0 and CC-BY-NC-4.0 are missing.
FILES = Path(__file__).parent / "license_texts"
BSD_TITLES = ("bsd 2 clause license", "bsd 3 clause license", "the 2 clause bsd license", "the 3 clause bsd license", "simplified bsd license", "new bsd license", "bsd license")
#: Words by which a place is looked up before its digest is made.
HEAD = 8
ANCHORS = ("licen", "permission", "mit no attribution", "redistribution and use", "redistribution\nand use")
#: Spellings that count as equal.
SPELLINGS = (("sublicence", "sublicense"), ("licence", "license"), ("acknowledgement", "acknowledgment"), ("acknowledgment", "acknowledgment"), ("judgement", "judgment"), ("non commercial", "noncommercial"), ("sub license", "sublicense"), ("and or", "and/or"), ("whilst", "while"), ("organisation", "organization"), ("https", "http"), ("copyright owner", "copyright holder"), ("version 2 0", "2 0"), ("v 2 0", "2 0"), ("version 3", "3"), ("v3", "3"))
COPYRIGHT = r"(?m)^[^\p{L}\p{N}\n]*(copyright|\(c\)|©)[^\n]*$"
_PROSE = "notice|notices|holder|holders|owner|owners|ownership|law|laws|license|licence|licenses|statement|statements|permission|interest|interests|right|rights|protection|treaty|claim|claims|disclaimer|information|status|material|and|or|on|in|is|of|to|for|as|with|from|that|this|under"
#: A line that states a copyright: the word or sign with (c), a year, a blank to fill in or a holder. A sentence that goes on with 'copyright notice' is none, nor is the item (c) of a list.
STATEMENT = (
    r"(?m)^[^\p{L}\p{N}\n(\[<{]*(?:(?i:copyright)[ \t:,]*(?:(?i:\(c\))|©|[\[<{]|\d{4}|(?i:by )|(?!(?i:" + _PROSE + r")\b)\p{Lu})|©|(?i:\(c\))[ \t]*(?:(?i:copyright)|\d{4}))[^\n]*$"
    r"|(?m)^[ \t]*(?i:all rights reserved)\.?[ \t]*$"
)


def normalised(text: Column) -> Column:
    """Words between single spaces. While spellings are brought together each word has spaces of its own on both sides, so neighbours are all met."""
    out = F.lower(F.regexp_replace(text, STATEMENT, " "))
    out = F.concat(F.lit("  "), F.regexp_replace(out, r"[^\p{L}\p{N}]+", "  "), F.lit("  "))
    for old, new in SPELLINGS:
        if old != new:
            out = F.replace(out, F.lit(f" {old.replace(' ', '  ')} "), F.lit(f" {new.replace(' ', '  ')} "))
    return F.trim(F.regexp_replace(out, " +", " "))


def full_texts() -> list[tuple[str, str]]:
    """(license, text): TEXTS and FILES, also without what follows their terms, and BSD texts without their numbers."""
    rows = list(TEXTS.items())
    for path in sorted(FILES.glob("*.txt")):
        text = path.read_text(encoding="utf-8")
        rows.append((path.stem, text))
        terms = re.split(r"END OF TERMS AND CONDITIONS", text)
        if len(terms) > 1:
            rows += [(path.stem, terms[0]), (path.stem, f"{terms[0]}END OF TERMS AND CONDITIONS")]
        if path.stem.startswith("BSD"):
            rows.append((path.stem, re.sub(r"(?m)^\d\. ", "", text)))
    return rows


def known(spark: SparkSession) -> DataFrame:
    """(digest, license, kind): the fixed table, with and without a title line."""
    full = full_texts()
    rows = [(name, "notice", text) for name, text in NOTICES.items()] + [(name, "text", text) for name, text in full]
    rows += [(name, "text", f"{title}\n{text}") for name, text in TEXTS.items() for title in TITLES]
    rows += [(name, "text", f"{title}\n{text}") for name, text in full if name.startswith("BSD") for title in BSD_TITLES]
    made = spark.createDataFrame(rows, "license string, kind string, text string")
    return made.select(F.sha2(normalised(F.col("text")).cast("binary"), 256).alias("digest"), "license", "kind").dropDuplicates(["digest"])


def _windows(spark: SparkSession) -> DataFrame:
    """(license, head, words, digest) of the full texts: their first HEAD words, their length and the digest of all."""
    rows = spark.createDataFrame(full_texts(), "license string, text string").select("license", F.split(normalised(F.col("text")), " ").alias("w"))
    return rows.select("license", _head(F.col("w"), F.lit(1)).alias("head"), F.get("w", F.lit(0)).alias("first"), F.size("w").alias("words"), F.sha2(F.array_join("w", " ").cast("binary"), 256).alias("digest")).dropDuplicates(["digest"])


def _head(words: Column, at: Column) -> Column:
    return F.xxhash64(F.array_join(F.slice(words, at, F.lit(HEAD)), " "))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, license, n_units, whole): how many entire texts of a document are a known licence or notice, and whether the document is one.

    Units are the document, its paragraphs (runs of lines that aren't blank), and its lines; what lies inside a unit that is a licence doesn't count for it
    again. Full texts are also looked up at any place: where the first words of one stand, the digest of as many words as it has is joined to the known ones."""
    held = lambda c: F.greatest(*(F.contains(F.lower(c), F.lit(a)) for a in ANCHORS))
    docs = docs.select("doc_id", text_of().alias("text")).where(held(F.col("text"))).select("doc_id", "text", F.xxhash64("text").alias("t"))
    digest = lambda c: F.sha2(normalised(c).cast("binary"), 256).alias("digest")
    table_ = F.broadcast(known(docs.sparkSession))
    paragraphs = docs.select("doc_id", "t", F.posexplode(F.split("text", r"\n(?:[ \t]*\n)+")).alias("at", "unit")).where(held(F.col("unit")))
    lines = paragraphs.where(F.contains("unit", F.lit("\n"))).select("doc_id", "t", "at", F.explode(F.split("unit", "\n")).alias("unit")).where(held(F.col("unit")))
    units = docs.select("doc_id", "t", F.lit(-1).alias("at"), F.lit(2).alias("size"), digest(F.col("text")))
    units = units.unionByName(paragraphs.select("doc_id", "t", "at", F.lit(1).alias("size"), digest(F.col("unit")))).unionByName(lines.select("doc_id", "t", "at", F.lit(0).alias("size"), digest(F.col("unit"))))
    found = units.join(table_, "digest").groupBy("doc_id", "t", "license", "at", "size").agg(F.count(F.lit(1)).alias("n"))
    found = found.groupBy("doc_id", "t", "license", "at").agg(F.max_by("n", "size").alias("n"), F.max("size").alias("size"))
    # one row in rows that repeat a document: their units count for each
    found = found.groupBy("doc_id", "t", "license").agg(F.max(F.when(F.col("size") == 2, F.col("n"))).alias("w"), F.sum("n").alias("n"))
    found = found.select("doc_id", "license", F.coalesce("w", "n").alias("n"), F.col("w").isNotNull().alias("whole"))
    full = _windows(docs.sparkSession)
    heads = {r.head: r.first for r in full.select("head", "first").distinct().collect()}  # a row for each full text
    first, at_head = (lambda x: x.isin(sorted(set(heads.values())))), (lambda i: _head(F.col("w"), i).isin(sorted(heads)))
    words = docs.where(F.length("text") >= min(len(t) for _, t in full_texts()) // 2).select("doc_id", F.split(normalised(F.col("text")), " ").alias("w"))
    starts = F.filter(F.transform("w", lambda x, i: F.when(first(x), i + 1)), lambda i: i.isNotNull())
    places = words.select("doc_id", "w", F.explode(F.filter(starts, at_head)).alias("at")).withColumn("head", _head(F.col("w"), F.col("at"))).join(F.broadcast(full), "head")
    inside = places.where(F.sha2(F.array_join(F.slice("w", F.col("at"), F.col("words")), " ").cast("binary"), 256) == F.col("digest"))
    inside = inside.groupBy("doc_id", "license", "digest").agg(F.count(F.lit(1)).alias("n")).groupBy("doc_id", "license").agg(F.max("n").alias("n"))
    both = found.groupBy("doc_id", "license").agg(F.sum("n").alias("n"), F.max("whole").alias("whole")).unionByName(inside.withColumn("whole", F.lit(False)))
    return both.groupBy("doc_id", "license").agg(F.max("n").alias("n_units"), F.max("whole").alias("whole"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql_normalised(x: str) -> str:
    out = f"'  ' || regexp_replace(regexp_replace(lower({x}), '{COPYRIGHT}', ' ', 'g'), '[^\\p{{L}}\\p{{N}}]+', '  ', 'g') || '  '"
    for old, new in SPELLINGS:
        if old != new:
            out = f"replace({out}, ' {old.replace(' ', '  ')} ', ' {new.replace(' ', '  ')} ')"
    return f"trim(regexp_replace({out}, ' +', ' ', 'g'), ' ')"


def _oracle() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rows = [(n, t) for n, t in NOTICES.items()] + [(n, t) for n, t in TEXTS.items()] + [(n, f"{x}\n{t}") for n, t in TEXTS.items() for x in TITLES]
    values = ", ".join(f"({quote(n)}, {quote(t)})" for n, t in rows)
    return f"""
WITH k AS (SELECT DISTINCT {_sql_normalised("t")} AS canon, n AS license FROM (VALUES {values}) v(n, t)),
p AS (SELECT doc_id, unnest(ps) AS unit, generate_subscripts(ps, 1) AS place FROM (SELECT doc_id, regexp_split_to_array(text, '\\n(?:[ \\t]*\\n)+') AS ps FROM documents WHERE text IS NOT NULL)),
u AS (
  SELECT doc_id, text AS unit, 0 AS place, 2 AS size FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT doc_id, unit, place, 1 FROM p
  UNION ALL SELECT doc_id, unnest(string_split(unit, chr(10))), place, 0 FROM p WHERE contains(unit, chr(10))),
f AS (SELECT doc_id, license, place, size, count(*) AS n FROM (SELECT doc_id, place, size, {_sql_normalised("unit")} AS canon FROM u WHERE contains(lower(unit), 'licen') OR contains(lower(unit), 'permission') OR contains(lower(unit), 'mit no attribution')) c JOIN k USING (canon) GROUP BY ALL),
g AS (SELECT doc_id, license, place, arg_max(n, size) AS n, max(size) AS size FROM f GROUP BY ALL)
SELECT doc_id, license, CASE WHEN bool_or(size = 2) THEN max(n) FILTER (size = 2) ELSE CAST(sum(n) AS BIGINT) END AS n_units, bool_or(size = 2) AS whole FROM g GROUP BY doc_id, license
"""


ORACLE_SQL = _oracle()
