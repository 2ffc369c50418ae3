"""Licence scans by digest lookup, with DataFrame functions only.

A text becomes canonical: copyright lines go, letters become lower case, equivalent spellings become one, and
everything that is no letter or digit becomes a single space.  Digests of whole canonical texts are hash-joined with
those of the known licences, each with and without its title, clause numbers and appendix.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Equivalent spellings as the SPDX matching guidelines list them (a selection).
SPELLINGS = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact", "authorisation": "authorization",
    "authorised": "authorized", "calibre": "caliber", "cancelled": "canceled", "capitalisations": "capitalizations", "catalogue": "catalog",
    "categorise": "categorize", "centre": "center", "colour": "color", "copyright holder": "copyright owner", "emphasised": "emphasized",
    "favour": "favor", "favourite": "favorite", "fulfilment": "fulfillment", "https": "http", "initialise": "initialize", "judgement": "judgment",
    "labelling": "labeling", "labour": "labor", "licence": "license", "maximise": "maximize", "merchantability": "merchantability",
    "modelled": "modeled", "non commercial": "noncommercial", "offence": "offense", "optimise": "optimize", "organisation": "organization",
    "organise": "organize", "per cent": "percent", "practise": "practice", "programme": "program", "realise": "realize",
    "recognise": "recognize", "signalling": "signaling", "sub license": "sublicense", "utilisation": "utilization", "whilst": "while", "wilful": "willful",
}

# Texts of short public licences, and notices that name one.
KNOWN = {
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.""",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT-notice": "Released under the MIT License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
}

# Lines that often stand above a licence's text.
TITLES = {
    "0BSD": ("BSD Zero Clause License", "BSD Zero Clause License (0BSD)", "Zero-Clause BSD", "0BSD"),
    "Apache-2.0": ("Apache License 2.0", "Apache License, Version 2.0", "Apache 2.0 License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The 2-Clause BSD License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License", "The BSD 2-Clause License", "The BSD License", "BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The 3-Clause BSD License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License", "Modified BSD License", "The BSD 3-Clause License", "The BSD License", "BSD License"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "MIT", "License: MIT", "(The MIT License)"),
    "Unlicense": ("The Unlicense", "Unlicense", "UNLICENSE"),
    "Zlib": ("zlib License", "The zlib License", "The zlib/libpng License", "zlib/libpng License"),
}
# A line that only names an owner or a year.  Licences speak of copyright too, and may be wrapped anywhere.
_COPYRIGHT = (
    r"(?m)^[^\p{L}\p{N}©\n]*(?:©|(?i:copyright)[\s:,]*(?:©|(?i:\(c\))|[\[<{(]?(?:[12]\d{3}|(?i:yyyy|year)))|(?i:\(c\))[ \t]*(?:[\[<{]?(?:[12]\d{3}|(?i:yyyy|year))|(?i:copyright))"
    r"|Copyright(?:[ \t]+by)?[ \t]+(?!Holder|Owner|Notice|Licen|Law|Disclaimer)[\p{Lu}\[<{]|(?i:all[ \t]+rights[ \t]+reserved)[^\p{L}\p{N}\n]*$).*$"
)
_END = "END OF TERMS AND CONDITIONS"


def canonical(text: Column) -> Column:
    """The canonical form of a text; empty for null."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), _COPYRIGHT, " ")
    out = F.trim(F.regexp_replace(F.lower(out), r"[^\p{L}\p{N}]+", " "))
    for a, b in SPELLINGS.items():
        if a != b:
            out = F.replace(out, F.lit(a), F.lit(b))
    return out


def _start(lowered: Column) -> Column:
    """The first one to three letters or digits; no spelling in ``SPELLINGS`` changes these."""
    return F.regexp_extract(lowered, r"[\p{L}\p{N}]{1,3}", 0)


def _may_be_known(text: Column, starts: list[str]) -> Column:
    """False only for texts that cannot be known: they start otherwise, and no line of theirs can be a copyright line."""
    lowered = F.lower(text)
    out = _start(lowered).isin(starts)
    for word in ("copyright", "©", "(c)", "rights"):
        out |= F.contains(lowered, F.lit(word))
    return out


def known_licenses(spark: SparkSession, texts: dict[str, str] | None = None) -> DataFrame:
    """(license_id, text) of ``texts``, by default of ``KNOWN`` and the texts of folder ``licenses``, in all their forms.

    An id may have several rows.
    """
    given = list((texts or KNOWN).items())
    if not texts:
        given += [(path.stem, path.read_text(encoding="utf-8")) for path in sorted((Path(__file__).parent / "licenses").glob("*.txt"))]
    rows = {(name, form) for name, text in given for form in (forms(name, text) if not texts else [text])}
    return spark.createDataFrame(sorted(rows), "license_id string, text string")


def forms(name: str, text: str) -> list[str]:
    """A licence's text as it stands in files: without the appendix or clause numbers, and below each of its titles."""
    if "\n" not in text:
        return [text]
    out = [text]
    if _END in text:
        terms = text[: text.index(_END)]
        out += [terms, terms + _END]
    out += [x for x in (re.sub(r"(?m)^[ \t]*\d+\.(?=\s)", "", y) for y in list(out)) if x not in out]
    return out + [f"{title}\n\n{x}" for title in TITLES.get(name, ()) for x in out]


def license_scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Licences that whole texts, or whole lines of them, are equal to in canonical form.

    Returns for each row of ``docs``: doc_id, license_id (of the whole text, or null) and line_licenses (of its lines,
    distinct and sorted; empty if none).  Of licences with equal canonical texts the smallest id counts; known texts
    that are canonically empty match nothing.  A line that several licences consist of counts for the smallest id alone.
    Null and empty texts match nothing; repeated rows give equal results;
    long texts are looked at whole and line by line, other columns not at all; an empty table gives an empty result.
    """
    known = known.withColumn("canonical", canonical(F.col("text"))).where("canonical <> ''")
    table = known.groupBy(F.sha2("canonical", 256).alias("digest")).agg(F.min("license_id").alias("license"))
    starts = [r[0] for r in known.select(_start(F.col("canonical"))).distinct().collect()]
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("_text"), F.xxhash64(text).alias("_hash"))
    # What is no digest matches nothing; it only deals such rows evenly.
    whole = rows.select("doc_id", "_hash", F.when(_may_be_known(F.col("_text"), starts), F.sha2(canonical(F.col("_text")), 256)).otherwise(F.xxhash64("doc_id", "_hash").cast("string")).alias("digest"))
    whole = whole.join(table, "digest", "left").select("doc_id", "_hash", F.col("license").alias("license_id"))
    lines = rows.select("doc_id", "_hash", F.explode(F.split("_text", "\n", -1)).alias("_line"))
    lines = lines.where(_may_be_known(F.col("_line"), starts)).select("doc_id", "_hash", F.sha2(canonical(F.col("_line")), 256).alias("digest")).join(table, "digest")
    # Only the few lines that are known reach this shuffle; repeated rows share a key and give one list.
    lines = lines.groupBy("doc_id", "_hash").agg(F.sort_array(F.collect_set("license")).alias("_found")).withColumnsRenamed({"doc_id": "_id", "_hash": "_h"})
    out = whole.join(lines, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_h")), "left")
    return out.select("doc_id", "license_id", F.coalesce("_found", F.array().cast("array<string>")).alias("line_licenses"))
