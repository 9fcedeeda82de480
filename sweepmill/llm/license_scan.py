"""Licence scanning by canonical digests (DataFrame functions only).

A text is brought to a canonical form - lower case, copyright lines gone, equivalent spellings made one,
punctuation and white space folded to single blanks - and the SHA-256 of the entire form is hash-joined to the digests
of known licences, which get the same treatment. The unit is an entire text; with `notices`, each entire line of
a text is looked up as well, which finds one-line notices at the foot of a document.

Defined results: null and empty texts, and those that are blank in canonical form, match nothing; a row that
repeats is reported again; columns named like a result column are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# Equivalent spellings, applied in this order to lower-case text.
SPELLINGS = (
    ("licence", "license"), ("licenced", "licensed"), ("authorisation", "authorization"), ("authorised", "authorized"),
    ("organisation", "organization"), ("sub-license", "sublicense"), ("non-infringement", "noninfringement"),
    ("fulfilment", "fulfillment"), ("copyright owner", "copyright holder"), ("https://", "http://"), ("per cent", "percent"),
)
COPYRIGHT_LINE = r"(?m)^[^\n\p{L}\p{N}]*(?:copyright|\(c\)|©|all rights reserved)[^\n]*$"
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
# Known licences (public texts and common one-line notices) by SPDX identifier.
KNOWN = (
    ("MIT", _MIT), ("MIT", "MIT License\n\n" + _MIT), ("MIT", "The MIT License\n\n" + _MIT),
    ("ISC", _ISC), ("ISC", "ISC License\n\n" + _ISC),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0", "Released under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-NC-4.0", "This work is licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-4.0", "This work is licensed under CC BY 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
)
# Digests of the canonical forms of entire public texts, with and without their usual headings, by SPDX identifier.
# OP10_SQL knows the forms in KNOWN alone.
FULL_TEXTS = (
    ("Apache-2.0", "0d5838e6f6e5a374e58d608af5c01bc6a67cf18552dd7b346e5aef652b808ee9"),
    ("GPL-1.0", "9e12a40a9b22c45d116f19e1746b08ea0b853519de3e03ceb780f2a36d5f388c"),
    ("GPL-2.0", "b866f5427b78991db8012466b32f51c907f5e974fde5129a47372d0d0552e3a1"),
    ("GPL-3.0", "59a779feaae4de539260be3c8adb19c287a771586d211e12d93932777da37349"),
    ("LGPL-2.0", "b4114daa3dfa52e27e78b2c4e17acd58bf4381e812762f4ded0bcb8eabd1092c"),
    ("LGPL-2.1", "294fb9ec58649c7eb0cf90fc2900ac1b28b82fb6da9d40d7599d6b7d399d4d2e"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "fcb579371133afd771fed87cd5d8c6dc5648746c9945d4adf08ec5c79aba5c61"),
    ("MPL-2.0", "9e79a7d513376f6fa1500e4df4f6276c6e7e61c5c3e28dcdb1acee24033acc56"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "37db86be8f16e9b8dfb0d63e1698ad2e07d54f312494c1cb2dbdb4fa37487f0f"),
    ("GFDL-1.3", "7befa86e5ee53162018d597eee81db6c727f3e64fab4641af93e19deab1807b4"),
    ("BSD-2-Clause", "a56fee4b2f66331ed54da4950ef9c9391453fd1490b4d8ea202bc29683bcbd30"),
    ("BSD-2-Clause", "447686a56472ea2e9713ca89034ee666e6646bd1a33eba38690cb875708663e2"),
    ("BSD-2-Clause", "2c570d136b858b0a4d090e301862eacb53fb1ae2743462bf3b89e602191665f7"),
    ("BSD-2-Clause", "33903615089fdb3ab02696d1bd92eb9580c2c7a0e0c8714aa95b0dfc1dcdb89c"),
    ("BSD-3-Clause", "9b83d3dee0616d07b82a272dd9bf5134a9f402b750f5ee6188458073b0a32ff2"),
    ("BSD-3-Clause", "cc65957a28f15bbcef5b0c23770aae3bd8462cb25904250f77a812ab3b2efe15"),
    ("BSD-3-Clause", "e651765ec94c99c2ea03cf19aceb85785d656ba08685eb0772747c296340cb54"),
    ("BSD-3-Clause", "e612af111b0f62aac3e107973cd804ade8a118ba3c7034d6824ebdce9852ba2e"),
    ("BSD-2-Clause", "986c3c3199a93b916c8f2e0aeed57819bcbdcb2cd9d99902dcc9d74b53f93a74"),
    ("BSD-2-Clause", "23d7258e25bd67982ccec4b5bfc05631a20f8ee5bd5fe7eb70694c100aae88d2"),
    ("BSD-3-Clause", "53075742228962c7ea381b8242c64602fa32e7b8f52facb6d13ee4f9c596ddfa"),
    ("BSD-3-Clause", "f94931e221f919e6cec5ca99e0ea7da1912b2c7d805cdaee8baf508c248bc1af"),
    ("Unlicense", "7a4d92cdb11d254973a073803be1148a5402f1b2ca67808cdb3ef78b596102cd"),
    ("Unlicense", "6077a8a20d606206e486caec85a30b2545701071b1e08d12c37fb9a0e490d1bf"),
    ("MIT", "6c833965e9ca4cf8095655005226f24fe8bf7b1605dbe513204837a7371fa127"),
    ("MIT", "7c3366b22b9f0d6a198b2c29bd1c4b663b2d55eacbd066146e5476c4b8ff1ce4"),
)


def canonical(text):
    """The canonical form of a text column."""
    out = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, " ")
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "))


def digests(spark: SparkSession, known=KNOWN, full=FULL_TEXTS) -> DataFrame:
    """digest, license of known licences: of the texts in known, and those in full as they are."""
    rows = spark.createDataFrame([(b, a) for a, b in known], "text string, license string")
    return rows.select(F.sha2(canonical(F.col("text")).cast("binary"), 256).alias("digest"), "license").unionByName(spark.createDataFrame([(b, a) for a, b in full], "digest string, license string")).distinct()


def scan_licenses(docs: DataFrame, known: DataFrame, notices: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' ids with text_license (the licence that the entire text is, or null), notice_licenses (sorted,
    comma-joined, of entire lines) and n_notices (long). known: digest, license (see digests); one licence for a
    digest, the first by name. Without the text, rows stay short through the shuffle."""
    known = known.groupBy("digest").agg(F.min("license").alias("license"))
    row = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).withColumn("_row", F.monotonically_increasing_id())
    lines = F.split("_text", "\n", -1) if notices else F.array().cast("array<string>")
    units = F.concat(
        F.array(F.struct(F.lit(True).alias("whole"), F.col("_text").alias("unit"))),
        F.when(F.instr("_text", "\n") > 0, F.transform(lines, lambda x: F.struct(F.lit(False).alias("whole"), x.alias("unit")))).otherwise(
            F.array().cast("array<struct<whole:boolean,unit:string>>")
        ),
    )
    each = row.select(id_col, "_row", F.explode(units).alias("u")).select(id_col, "_row", "u.whole", F.sha2(canonical(F.col("u.unit")).cast("binary"), 256).alias("digest"))
    hits = each.join(F.broadcast(known), "digest", "left")
    out = hits.groupBy("_row", id_col).agg(
        F.max(F.when(F.col("whole"), F.col("license"))).alias("text_license"),
        F.array_join(F.array_sort(F.collect_set(F.when(~F.col("whole"), F.col("license")))), ",").alias("notice_licenses"),
        F.count(F.when(~F.col("whole"), F.col("license"))).alias("n_notices"),
    )
    return out.drop("_row")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan_licenses(docs, digests(spark))


def _sql_canonical(column: str) -> str:
    out = f"regexp_replace(lower({column}), '{COPYRIGHT_LINE}', ' ', 'g')"
    for old, new in SPELLINGS:
        out = f"replace({out}, '{old}', '{new}')"
    return rf"trim(regexp_replace({out}, '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


_SQL_KNOWN = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in KNOWN)
OP10_SQL = f"""
WITH known AS (SELECT {_sql_canonical("t")} AS form, min(license) AS license FROM (VALUES {_SQL_KNOWN}) v(license, t) GROUP BY 1),
docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM docs WHERE contains(t, chr(10))),
wholes AS (SELECT d.doc_id, k.license FROM docs d JOIN known k ON {_sql_canonical("d.t")} = k.form),
notices AS (SELECT l.doc_id, k.license FROM lines l JOIN known k ON {_sql_canonical("l.line")} = k.form),
listed AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS names, count(*) AS n FROM notices GROUP BY doc_id)
SELECT d.doc_id, w.license AS text_license, coalesce(l.names, '') AS notice_licenses, coalesce(l.n, 0)::BIGINT AS n_notices
FROM docs d LEFT JOIN wholes w ON d.doc_id = w.doc_id LEFT JOIN listed l ON d.doc_id = l.doc_id
"""
