"""License scans by digest: texts in canonical form are hash-joined to known licenses.

Canonical form: lower case, copyright lines dropped, equivalent spellings made one,
everything but letters and digits turned into single spaces. The MD5 digest of a whole
text, and of each of its lines, is looked up among the digests of the known texts by an
equi-join, so the cost per document does not depend on how many licenses are known.
All of it is column expressions; one row per document is shuffled.
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lines that name a copyright holder, and spellings that mean the same.
COPYRIGHT_LINE = (
    r"^[^\p{L}\p{N}\n]*(?:(?:portions )?copyright[ \t]*(?:\(c\)|©|:|by |[0-9]{4}|[<\[{])|\(c\)[ \t]*[0-9]|©|all rights reserved)[^\n]*$"
)
SPELLINGS = (
    ("licence", "license"), ("organisation", "organization"), ("authoris", "authoriz"), ("favour", "favor"), ("merchantib", "merchantab"),
    ("acknowledgement", "acknowledgment"), ("behaviour", "behavior"), ("non-infringement", "noninfringement"), ("wilful", "willful"),
    ("judgement", "judgment"), ("per cent", "percent"), ("copyright owner", "copyright holder"), ("https://", "http://"), ("e-mail", "email"),
)
#: Known license texts and notices.
MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
    "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
    "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or "
    "substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, "
    "INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
    "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
ISC_GRANT = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
)
ISC_DISCLAIMER = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES "
    "OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR "
    "ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS "
    "ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
KNOWN = (
    ("MIT", "MIT License\n\n" + MIT), ("MIT", MIT), ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."),
    ("ISC", ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n\n" + ISC_DISCLAIMER),
    ("0BSD", ISC_GRANT + ".\n\n" + ISC_DISCLAIMER),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."), ("WTFPL", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE"),
)


#: Whole license texts, read by the driver: ``<license id>.txt``, further wordings ``<license id>--<name>.txt``.
FOLDER = Path(__file__).parent / "license_texts"
#: The terms end here; what follows says how to apply them and is often left out.
END_OF_TERMS = "END OF TERMS AND CONDITIONS"


def whole_texts() -> list[tuple[str, str]]:
    """(license id, text) of the files, and of their terms alone."""
    found = []
    for file in sorted(FOLDER.glob("*.txt")):
        name, text = file.stem.split("--")[0], file.read_text(encoding="utf-8")
        terms, end, rest = text.partition(END_OF_TERMS)
        found += [(name, text)] + ([(name, terms + end), (name, terms)] if rest.strip() else [])
    return found


def canonical(text: Column) -> Column:
    """Canonical form of a text; empty if nothing is left.

    Only spellings of several words reach across a line break, so the form of a text is the forms of its lines joined by
    spaces and sent through ``_across``.
    """
    text = F.regexp_replace(F.lower(text), "(?md)" + COPYRIGHT_LINE, "")
    for other, usual in SPELLINGS:
        text = F.replace(text, F.lit(other), F.lit(usual))
    return _across(F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " ")))


def _across(form: Column) -> Column:
    """Spellings of several words made one in a form, wherever its lines were broken."""
    for other, usual in SPELLINGS:
        if " " in other:
            form = F.replace(form, F.lit(other), F.lit(usual))
    return form


def _digest(text: Column) -> Column:
    form = canonical(text)
    return F.when(form != "", F.md5(form))


def known_licenses(spark: SparkSession) -> DataFrame:
    """(license_id, text) of the built-in list and of the files of whole texts."""
    listed = json.dumps([{"license_id": i, "text": t} for i, t in (*KNOWN, *whole_texts())])
    return spark.range(1).select(F.inline(F.from_json(F.lit(listed), "array<struct<license_id:string,text:string>>")))


def scan(docs: DataFrame, licenses: DataFrame | None = None) -> DataFrame:
    """Licenses that each document is, and that it holds as a line of its own.

    ``docs``: doc_id, text (other columns are ignored); ``licenses``: license_id, text. Returns doc_id,
    whole_license (whose text is the document's whole text; the first id if several are alike) and
    line_licenses (ids of texts that are one whole line, sorted, joined by commas, empty if none). A null, empty or
    symbol-only text matches nothing. Rows equal in doc_id and canonical text and lines are reported once; an
    empty table gives no rows.
    """
    known = known_licenses(docs.sparkSession) if licenses is None else licenses
    digests = known.select("license_id", _digest(F.col("text")).alias("digest")).filter("digest is not null and license_id is not null").distinct()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    forms = docs.select("doc_id", F.filter(F.transform(F.split(text, "\n"), canonical), lambda f: f != "").alias("_forms"))
    whole = F.when(F.size("_forms") > 0, F.md5(_across(F.array_join("_forms", " "))))
    keyed = forms.select("doc_id", whole.alias("whole"), F.array_sort(F.array_distinct(F.transform("_forms", F.md5))).alias("_lines"))
    keyed = keyed.withColumn("page", F.xxhash64("_lines"))
    units = F.concat(F.array(F.struct(F.col("whole").alias("digest"), F.lit(True).alias("entire"))), F.transform("_lines", lambda d: F.struct(d.alias("digest"), F.lit(False).alias("entire"))))
    found = keyed.select("doc_id", "whole", "page", F.inline(units)).join(digests, "digest", "left")
    return found.groupBy("doc_id", "whole", "page").agg(
        F.min(F.when(F.col("entire"), F.col("license_id"))).alias("whole_license"),
        F.array_join(F.array_sort(F.collect_set(F.when(~F.col("entire"), F.col("license_id")))), ",").alias("line_licenses"),
    ).select("doc_id", "whole_license", "line_licenses")


def _sql() -> str:
    form = f"regexp_replace(lower(t), '(?m){COPYRIGHT_LINE}', '', 'g')"
    for other, usual in SPELLINGS:
        form = f"replace({form}, '{other}', '{usual}')"
    form = f"trim(regexp_replace({form}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    listed = ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in KNOWN)
    return f"""
WITH known AS (SELECT DISTINCT id, {form} AS form FROM (VALUES {listed}) v(id, t)),
units AS (
  SELECT doc_id, text AS t, true AS entire FROM documents
  UNION ALL SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS t, false FROM documents),
forms AS (SELECT doc_id, entire, {form} AS form FROM units),
hits AS (SELECT f.doc_id, f.entire, k.id FROM forms f JOIN known k ON f.form = k.form AND f.form <> '')
SELECT d.doc_id, min(h.id) FILTER (h.entire) AS whole_license, coalesce(string_agg(DISTINCT h.id, ',' ORDER BY h.id) FILTER (NOT h.entire), '') AS line_licenses
FROM documents d LEFT JOIN hits h ON d.doc_id = h.doc_id GROUP BY d.doc_id"""


#: The same over the table ``documents`` with the built-in list.
SQL = _sql()
