"""License scans: canonical texts, looked up by digest; full licence texts, also inside a document."""

from __future__ import annotations

import re
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Short licence texts and notices in common use, by identifier.
KNOWN = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.'),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("LicenseRef-AllRightsReserved", "All rights reserved."),
]
# Spellings that count as equal (whole words of the canonical text).
EQUIVALENT = [
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("sublicence", "sublicense"),
    ("noninfringement", "non infringement"),
    ("merchantibility", "merchantability"),
    ("acknowledgement", "acknowledgment"),
    ("organisation", "organization"),
    ("favour", "favor"),
    ("analyse", "analyze"),
    ("v", "version"),
]


#: Full texts, a file per licence; where the terms begin and end in it (None: at the end of the file).
TEXTS = Path(__file__).parent / "license_texts"
TERMS = {
    "Apache-2.0": ("TERMS AND CONDITIONS FOR USE", "END OF TERMS AND CONDITIONS"),
    "BSD-2-Clause": ("Redistribution and use", None),
    "BSD-3-Clause": ("Redistribution and use", None),
    "CC-BY-SA-4.0": ("By exercising the Licensed Rights", "=====\n\nCreative Commons is not a party"),
    "CC0-1.0": ("Statement of Purpose", None),
    "GFDL-1.2-only": ("0. PREAMBLE", "ADDENDUM: How to use"),
    "GFDL-1.3-only": ("0. PREAMBLE", "ADDENDUM: How to use"),
    "GPL-1.0-only": ("Preamble", "END OF TERMS AND CONDITIONS"),
    "GPL-2.0-only": ("Preamble", "END OF TERMS AND CONDITIONS"),
    "GPL-3.0-only": ("Preamble", "END OF TERMS AND CONDITIONS"),
    "ISC": ("Permission to use", None),
    "LGPL-2.0-only": ("Preamble", "END OF TERMS AND CONDITIONS"),
    "LGPL-2.1-only": ("Preamble", "END OF TERMS AND CONDITIONS"),
    "LGPL-3.0-only": ("This version of the GNU Lesser", None),
    "MIT": ("Permission is hereby", None),
    "MPL-1.1": ("1. Definitions", "EXHIBIT A"),
    "MPL-2.0": ("1. Definitions", "Exhibit A"),
    "OFL-1.1": ("PREAMBLE", None),
}
#: Titles in use besides those of the files.
TITLES = {
    "BSD-2-Clause": ["BSD 2-Clause License", "The 2-Clause BSD License", 'BSD 2-Clause "Simplified" License'],
    "BSD-3-Clause": ["BSD 3-Clause License", "The 3-Clause BSD License", 'BSD 3-Clause "New" or "Revised" License'],
    "ISC": ["ISC License", "The ISC License"],
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"],
}
#: Every full text holds one of these, in whatever case.
GATES = ("warrant", "lesser")
#: Signs that may stand before a line in a comment.
MARKS = r"[ \t#*/;%!<>|-]*"
COPYRIGHT = r"(copyright|\(c\)|©)"
#: Statements only: terms, too, have lines that begin with the word copyright or with (c).
STATEMENT = r"(copyright[ \t]*(\(c\)|©|<|\[|[0-9]{4})|(\(c\)|©)[ \t]*[0-9]{4}|<copyright notice>|all rights reserved\.?[ \t\r]*(?=\n|$))"


def canonical(text: Column, left_out: str = COPYRIGHT) -> Column:
    """Lower case (A-Z), no copyright lines (comment marks may precede them), signs other than letters and digits as one blank, equal spellings made one."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    plain = F.regexp_replace(lower, rf"(^|\n){MARKS}{left_out}[^\n]*", "\n")
    plain = F.trim(F.regexp_replace(plain, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    for spelled, usual in EQUIVALENT:
        plain = F.regexp_replace(plain, rf"(?<![^ ]){spelled}(?![^ ])", usual)
    return plain


def known_digests(spark: SparkSession, known: list[tuple[str, str]] = KNOWN) -> DataFrame:
    """(digest, license, anchor): the lookup table of a fixed, small number of texts.

    The anchor is the longest word of the canonical text that no spelling rule makes: a text with
    this canonical form must hold it, in whatever case.
    """
    made = F.array(*[F.lit(w) for _, usual in EQUIVALENT for w in usual.split(" ")])
    words = F.filter(F.split("canon", " "), lambda w: ~F.array_contains(made, w))
    anchor = F.array_max(F.transform(words, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    canon = spark.createDataFrame(known, "license string, body string").select("license", canonical(F.col("body")).alias("canon"))
    return canon.select(F.sha2("canon", 256).alias("digest"), "license", F.coalesce(anchor, F.lit("")).alias("anchor")).distinct()


def full_texts(spark: SparkSession) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """(licence, canonical terms), and (licence, canonical text) of what a whole document may be."""
    terms, wholes = [], []
    for name, (begin, end) in TERMS.items():
        text = (TEXTS / f"{name}.txt").read_text(encoding="utf-8")
        start = text.index(begin)
        stop = len(text) if end is None else text.index(end, start) + len(end) * end.startswith("END")
        for body in {text[start:stop], re.sub(r"(?m)^[ \t]*[1-9]\. ", "", text[start:stop]) if name.startswith("BSD") else text[start:stop]}:
            terms.append((name, body))
            wholes += [(name, body), *((name, f"{title}\n\n{body}") for title in [text[:start], *TITLES.get(name, [])])]
        wholes.append((name, text))
    made = lambda rows: [(r.license, r.canon) for r in spark.createDataFrame(rows, "license string, body string").select("license", canonical(F.col("body"), STATEMENT).alias("canon")).distinct().collect()]
    return made(terms), made(wholes)


def full_matches(rows: DataFrame) -> DataFrame:
    """(doc_id, whole, license): 1 for a full licence text that is the whole document, 2 for each whose terms lie inside."""
    terms, wholes = full_texts(rows.sparkSession)
    lower = F.lower("text")
    likely = rows.where(reduce(lambda a, b: a | b, [lower.contains(g) for g in GATES])).select("doc_id", canonical(F.col("text"), STATEMENT).alias("canon"))
    spaced = F.concat(F.lit(" "), "canon", F.lit(" "))
    inside = F.array(*[F.when(spaced.contains(f" {body} "), F.struct(F.lit(2).alias("whole"), F.lit(name).alias("license"))) for name, body in terms])
    within = likely.select("doc_id", F.explode(F.array_distinct(F.array_compact(inside))).alias("m")).select("doc_id", "m.whole", "m.license")
    digests = rows.sparkSession.createDataFrame(wholes, "license string, canon string").select(F.sha2("canon", 256).alias("digest"), "license").distinct()
    # a few rows per known text, a fixed number
    entire = likely.select("doc_id", F.sha2("canon", 256).alias("digest")).join(F.broadcast(digests), "digest").select("doc_id", F.lit(1).alias("whole"), "license")
    return within.union(entire)


def scan_licenses(docs: DataFrame, known: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, whole_license, n_lines, licenses of each document.

    whole_license is the licence whose text is the whole document; n_lines counts the lines that
    are, each entire, a known licence text or notice, and licenses lists their identifiers and those
    of the full texts whose terms lie anywhere in the document, however wrapped, sorted and
    comma-joined. Null and empty texts match nothing. A licence text known under several names
    has the smallest. Rows that repeat an id are one document: lines add up. Texts and lines
    without the anchor of any known text cannot match and are not made canonical.
    """
    table = known.groupBy("digest").agg(F.min("license").alias("license"))
    # one word per known text, a fixed number
    anchors = sorted({r.anchor for r in known.select("anchor").distinct().collect()})

    def anchored(c: Column) -> Column:
        lower = F.lower(c)
        return reduce(lambda a, b: a | b, [lower.contains(a) for a in anchors])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    likely = rows.where(anchored(F.col("text")))
    lines = likely.select("doc_id", F.explode(F.split("text", "\n")).alias("line"), F.lit(0).alias("whole")).where(anchored(F.col("line")))
    units = lines.union(likely.select("doc_id", F.col("text").alias("line"), F.lit(1).alias("whole")))
    digests = units.select("doc_id", "whole", F.sha2(canonical(F.col("line")), 256).alias("digest"))
    # the lookup table has one row per known text, a fixed number: it goes to every executor
    matches = digests.join(F.broadcast(table), "digest").select("doc_id", "whole", "license").union(full_matches(rows))
    found = matches.groupBy("doc_id").agg(
        F.min(F.when(F.col("whole") == 1, F.col("license"))).alias("whole_license"),
        F.count(F.when(F.col("whole") == 0, 1)).alias("n_lines"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("whole") != 1, F.col("license")))), ",").alias("licenses"),
    )
    everyone = rows.groupBy("doc_id").agg(F.lit(1).alias("one"))
    out = everyone.join(found, everyone["doc_id"].eqNullSafe(found["doc_id"]), "left")
    return out.select(everyone["doc_id"], "whole_license", F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"), F.coalesce("licenses", F.lit("")).alias("licenses"))


def oracle_sql(known: list[tuple[str, str]] = KNOWN) -> str:
    """DuckDB SQL of scan_licenses over documents."""

    def canonical_sql(x: str) -> str:
        out = f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
        out = rf"regexp_replace({out}, '(^|\n){MARKS}(copyright|\(c\)|©)[^\n]*', chr(10), 'g')"
        out = rf"trim(regexp_replace({out}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'))"
        for spelled, usual in EQUIVALENT:
            # twice: neighbours share their blank
            for _ in range(2):
                out = f"regexp_replace({out}, '(^| ){spelled}( |$)', '\\1{usual}\\2', 'g')"
        return out

    values = ", ".join("('{}', '{}')".format(n, b.replace("'", "''")) for n, b in known)
    return f"""
WITH known AS (SELECT {canonical_sql('body')} AS canon, min(license) AS license FROM (VALUES {values}) t(license, body) GROUP BY 1),
units AS (
  SELECT doc_id, 0 AS whole, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents
  UNION ALL SELECT doc_id, 1, coalesce(text, '') FROM documents),
found AS (
  SELECT doc_id, min(CASE WHEN whole = 1 THEN license END) AS whole_license,
    count(CASE WHEN whole = 0 THEN 1 END) AS n_lines,
    coalesce(string_agg(DISTINCT CASE WHEN whole = 0 THEN license END, ',' ORDER BY CASE WHEN whole = 0 THEN license END), '') AS licenses
  FROM (SELECT doc_id, whole, {canonical_sql('line')} AS canon FROM units) u JOIN known USING (canon) GROUP BY doc_id)
SELECT d.doc_id, f.whole_license, coalesce(f.n_lines, 0) AS n_lines, coalesce(f.licenses, '') AS licenses
FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN found f ON d.doc_id IS NOT DISTINCT FROM f.doc_id"""
