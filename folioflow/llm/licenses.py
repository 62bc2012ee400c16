"""Licence scan: TF-IDF cosine of headers and licence files to templates, then inheritance along paths."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from folioflow.session import materialise

# Licence names, their usual notices, titles and texts. A template's words in angle brackets must
# all be in whatever matches it; names and versions are told apart by them.
CODES = ("BY", "BY-NC", "BY-SA", "BY-ND", "BY-NC-SA", "BY-NC-ND")
CODE_WORDS = {"BY": "Attribution", "NC": "NonCommercial", "SA": "ShareAlike", "ND": "NoDerivatives"}
NAMES = (
    "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", *(f"CC-{code}-4.0" for code in CODES), "CC0-1.0", "GPL-2.0", "GPL-3.0", "ISC",
    "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0",
)
_DISCLAIMER = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,
BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT
SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
_BSD = """
<Redistribution> and use in source and <binary> forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
following disclaimer in the documentation and/or other materials provided with the distribution.
"""
TEMPLATES = (
    ("Apache-2.0", "<Licensed> under the <Apache> License, Version <2>.0."),
    ("Apache-2.0", "<Apache> <License> Version <2>.0, January 2004 http://www.apache.org/licenses/"),
    ("BSD-2-Clause", "<Licensed> under the <BSD> <2>-Clause License."),
    ("BSD-2-Clause", _BSD + _DISCLAIMER),
    ("BSD-3-Clause", "<Licensed> under the <BSD> <3>-Clause License."),
    (
        "BSD-3-Clause",
        _BSD + """3. Neither the name of the copyright holder nor the names of its contributors may be used to <endorse> or promote
        products derived from this software without specific prior written permission.""" + _DISCLAIMER,
    ),
    ("CC0-1.0", "Released into the <public> <domain> under <CC0> 1.0."),
    ("CC0-1.0", "Creative Commons Legal Code <CC0> 1.0 Universal"),
    ("GPL-2.0", "This work is <licensed> under the <GNU> <General> Public License, version <2>."),
    ("GPL-2.0", "<GNU> <General> Public <License> Version <2>, June 1991"),
    ("GPL-2.0", "<GNU> <General> Public <License> version <2>"),
    ("GPL-2.0", """under the terms of the <GNU> <General> Public <License> as published by the Free Software Foundation; either version <2>
        of the License, or (at your option) any later version."""),
    ("GPL-3.0", "This work is <licensed> under the <GNU> <General> Public License, version <3>."),
    ("GPL-3.0", "<GNU> <General> Public <License> Version <3>, 29 June 2007"),
    ("GPL-3.0", "<GNU> <General> Public <License> version <3>"),
    ("GPL-3.0", """under the terms of the <GNU> <General> Public <License> as published by the Free Software Foundation, either version <3>
        of the License, or (at your option) any later version."""),
    ("ISC", "Released under the <ISC> <License>."),
    ("ISC", """<Permission> to use, copy, modify, and/or distribute this software for any purpose with or without <fee> is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND
        THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
        FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
        WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION,
        ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("LGPL-2.1", "<GNU> <Lesser> General Public <License> Version <2>.<1>, February 1999"),
    ("LGPL-2.1", "under the terms of the <GNU> <Lesser> General Public <License> version <2>.<1>"),
    ("LGPL-3.0", "This work is <licensed> under the <GNU> <Lesser> General Public License, version <3>."),
    ("LGPL-3.0", "<GNU> <Lesser> General Public <License> Version <3>, 29 June 2007"),
    ("MIT", "Released under the <MIT> <License>."),
    ("MIT", """<Permission> is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
        files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
        modify, merge, publish, distribute, <sublicense>, and/or sell copies of the Software, and to permit persons to whom the Software
        is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be
        included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,
        EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
        NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER
        IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS
        IN THE SOFTWARE."""),
    ("MPL-2.0", "This work is <licensed> under the <Mozilla> Public License, version <2>.0."),
    ("MPL-2.0", "<Mozilla> Public <License> Version <2>.0"),
    ("MPL-2.0", """<License>, v. <2>.0. If a copy of the MPL was not distributed with this file, You can obtain one at
        https://<mozilla>.org/MPL/2.0/."""),
    *(("CC-" + code + "-4.0", "<Licensed> under CC " + "-".join(f"<{c}>" for c in code.split("-")) + " 4.0.") for code in CODES),
    *(
        ("CC-" + code + "-4.0", "This work is licensed under a <Creative> Commons "
         + "-".join(f"<{CODE_WORDS[c]}>" for c in code.split("-")) + " 4.0 International <License>.")
        for code in CODES
    ),
    *((name, "<SPDX>-<License>-Identifier: " + "-".join(f"<{part}>" for part in name.replace(".", "-").split("-"))) for name in NAMES),
    *((name, "-".join(f"<{part}>" for part in name.replace(".", "-").split("-")) + " <License>") for name in NAMES),
)
# Every template has a bracketed word that this finds, so a line without one starts no match.
MARKER = "(?i)licen[cs]|permission|redistribution|cc0"
# Lines that may start a whole licence text.
OPENING = "(?i)permission|redistribution"
SPANS = (1, 4)
OPENING_SPANS = (1, 4, 24)
FILE_NAME = "^(?i)(licen[cs]e|copying)([.].*)?$"
TERM = "[a-z0-9]+"
LEAST_COSINE = 0.6
_DIGITS = 9
_RESULT = ("license", "score", "origin", "origin_dir")


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def _weighted(units: DataFrame, key: list[str], idf: DataFrame, total: int) -> DataFrame:
    """TF-IDF weight of every term of every unit; a term that no text unit holds has the largest idf."""
    counts = units.select(*key, F.explode("terms").alias("term")).groupBy(*key, "term").agg(F.count(F.lit(1)).alias("tf"))
    weight = F.col("tf") * (F.log((1.0 + F.lit(total)) / (1.0 + F.coalesce("df", F.lit(0)))) + 1.0)
    return counts.join(idf, "term", "left").select(*key, "term", weight.alias("weight"))


def scan(files: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """One row per file: the columns of ``files`` but ``text``, then ``license, score, origin, origin_dir``.

    ``files`` has ``path`` and ``text``; other columns go through as they are, but those named like one of the
    result's are left out. Every line of a whole text that holds a marker starts a header: the line itself, the
    line and the three after it, and 24 lines where a whole licence text may start. Of files called LICENSE,
    LICENCE or COPYING the whole text counts too. Each is compared with the templates by TF-IDF cosine, with
    document frequencies from all these headers and files; a template matches from ``least`` on if its bracketed
    words are all there. A licence file has the licence of its whole text, else of its first matching line
    (``origin`` file); any other file that of its best match (``origin`` header; ties go to the template's name).
    A file without a match inherits from the licence file in the nearest directory above it (``origin``
    inherited), or has null.

    Null and empty texts name nothing; a null path is a file without directory; repeated paths are each
    scanned, and of several licence files in a directory the best match counts. Only texts with a marker are
    cut into lines. Inheritance joins distinct directories, not files, so a hot directory is one row.
    """
    others = [c for c in files.columns if c.lower() != "text" and c.lower() not in _RESULT]
    key = ["_a", "_b"]
    files = files.select(
        F.struct(*others).alias("others"), "path", "text", F.xxhash64("path", "text").alias("_a"), F.xxhash64("text", "path").alias("_b")
    )
    is_file = F.coalesce(F.element_at(F.split("path", "/"), -1).rlike(FILE_NAME), F.lit(False))
    marked = files.where(F.col("text").rlike(MARKER)).select(*key, "path", is_file.alias("is_file"), "text")
    marked = materialise(marked.dropDuplicates(key), "licence-texts")
    cut = marked.select(*key, F.split("text", "\n").alias("lines"))
    starts = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: F.get("lines", i).rlike(MARKER))
    spans = F.when(F.get("lines", F.col("line")).rlike(OPENING), F.array(*map(F.lit, OPENING_SPANS))).otherwise(F.array(*map(F.lit, SPANS)))
    lines = cut.select(*key, "lines", F.explode(starts).alias("line")).select(*key, "lines", "line", F.explode(spans).alias("span"))
    lines = lines.select(*key, "line", "span", F.array_join(F.slice("lines", F.col("line") + 1, F.col("span")), " ").alias("text"))
    whole = marked.where("is_file").select(*key, F.lit(-1).alias("line"), F.lit(0).alias("span"), "text")
    unit = [*key, "line", "span"]
    units = materialise(lines.unionByName(whole).select(*unit, _terms(F.col("text")).alias("terms")), "licence-units")

    total = units.count()
    terms = units.select(*unit, F.explode(F.array_distinct("terms")).alias("term"))
    idf = materialise(terms.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "licence-idf")
    weights = materialise(_weighted(units, unit, idf, total), "licence-weights")
    kind = ["template", "number", "needs"]
    templates = _weighted(_templates(files.sparkSession), kind, idf, total)
    norm = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy("template", "number")))
    # One row per template and term of TEMPLATES: a fixed number.
    templates = F.broadcast(
        templates.withColumn("norm", norm).select(
            "template", "number", F.size("needs").alias("needs"), "term", (F.col("weight") / F.col("norm")).alias("part"),
            F.array_contains("needs", F.col("term")).cast("int").alias("needed"),
        )
    )
    norms = weights.groupBy(*unit).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    scores = weights.join(templates, "term").groupBy(*unit, "template", "number", "needs")
    scores = scores.agg(F.sum(F.col("weight") * F.col("part")).alias("dot"), F.sum("needed").alias("held")).where("held = needs")
    scores = scores.join(norms, unit).select(*unit, "template", F.round(F.col("dot") / F.col("norm"), _DIGITS).alias("score"))
    scores = scores.where(F.col("score") >= least).join(marked.select(*key, "path", "is_file"), key)
    first = F.when(F.col("is_file"), F.col("line")).otherwise(0)
    order = Window.partitionBy(*key).orderBy(first, F.desc("score"), "template", F.desc("line"))
    best = scores.withColumn("_place", F.row_number().over(order)).where("_place = 1")
    own = best.select(*key, "path", "template", "score", F.when(F.col("is_file"), "file").otherwise("header").alias("kind"))
    own = materialise(own, "licence-own")

    order = Window.partitionBy("above").orderBy(F.desc("score"), "template")
    holders = own.where("kind = 'file'").withColumn("above", _directory("path")).where(F.col("above").isNotNull())
    held = holders.withColumn("_place", F.row_number().over(order)).where("_place = 1")
    held = materialise(held.select("above", F.col("template").alias("above_license"), F.col("score").alias("above_score")), "licence-directories")
    directories = files.select(_directory("path").alias("directory")).distinct()
    parts = F.split("directory", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    nearest = (
        directories.where(F.col("directory").isNotNull())
        .select("directory", F.explode(above).alias("above"))
        .join(held, "above")
        .groupBy("directory")
        .agg(F.max(F.struct(F.length("above").alias("n"), "above", "above_license", "above_score")).alias("near"))
        .select("directory", "near.above", "near.above_license", "near.above_score")
    )
    nearest = materialise(nearest, "licence-nearest")
    has = F.col("template").isNotNull()
    return (
        files.select("others", *key, _directory("path").alias("directory"))
        .join(own.drop("path"), key, "left")
        .join(nearest, "directory", "left")
        .select(
            *(F.col("others").getField(c).alias(c) for c in others),
            F.coalesce("template", "above_license").alias("license"),
            F.when(has, F.col("score")).otherwise(F.col("above_score")).alias("score"),
            F.when(has, F.col("kind")).when(F.col("above").isNotNull(), "inherited").alias("origin"),
            F.when(~has, F.col("above")).alias("origin_dir"),
        )
    )


def _directory(path: str) -> Column:
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), "/"))


def parsed_templates() -> list[tuple[str, list[str], str]]:
    """Licence, needed words and text of every template."""
    return [(name, sorted(set(re.findall("<([a-z0-9]+)>", text.lower()))), re.sub("[<>]", "", text)) for name, text in TEMPLATES]


def _templates(spark: SparkSession) -> DataFrame:
    rows = [
        F.struct(
            F.lit(name).alias("template"), F.lit(n).alias("number"), F.array(*map(F.lit, needs)).alias("needs"), F.lit(text).alias("text")
        )
        for n, (name, needs, text) in enumerate(parsed_templates())
    ]
    rows = spark.range(1).select(F.explode(F.array(*rows)).alias("t"))
    return rows.select("t.template", "t.number", "t.needs", _terms(F.col("t.text")).alias("terms"))


def document_path() -> Column:
    """The documents' place in a tree of directories: source, then blocks of 1024, 64 and 8 ids.

    The first document of each block is the block's licence file.
    """
    blocks = [F.floor(F.col("doc_id") / n).cast("string") for n in (1024, 64, 8)]
    top = F.coalesce("source", F.lit("none"))
    depth = F.when(F.col("doc_id") % 1024 == 0, 1).when(F.col("doc_id") % 64 == 0, 2).otherwise(3)
    name = F.when(F.col("doc_id") % 8 == 0, "LICENSE").otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return F.concat_ws("/", F.slice(F.array(top, *blocks), 1, depth + 1), name)


def _sql() -> str:
    values = ", ".join("({}, '{}', {}, '{}')".format(n, name, needs, text) for n, (name, needs, text) in enumerate(parsed_templates()))
    return rf"""
WITH files AS (
    SELECT doc_id, text, COALESCE(source, 'none') || '/' || (doc_id // 1024)
           || CASE WHEN doc_id % 1024 = 0 THEN '' ELSE '/' || (doc_id // 64) END
           || CASE WHEN doc_id % 64 = 0 THEN '' ELSE '/' || (doc_id // 8) END AS directory,
           CASE WHEN doc_id % 8 = 0 THEN 'LICENSE' ELSE doc_id || '.txt' END AS name
    FROM documents
), marked AS (SELECT * FROM files WHERE regexp_matches(text, '{MARKER}')),
lines AS (
    SELECT doc_id, l, unnest(range(len(l))) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM marked)
), spans AS (
    SELECT doc_id, l, line, unnest(CASE WHEN regexp_matches(l[line + 1], '{OPENING}') THEN {list(OPENING_SPANS)} ELSE {list(SPANS)} END) AS span
    FROM lines WHERE regexp_matches(l[line + 1], '{MARKER}')
), units AS (
    SELECT doc_id, line, span, regexp_extract_all(lower(array_to_string(l[line + 1 : line + span], ' ')), '{TERM}') AS terms FROM spans
    UNION ALL SELECT doc_id, -1, 0, regexp_extract_all(lower(text), '{TERM}') FROM marked WHERE name = 'LICENSE'
), tf AS (
    SELECT doc_id, line, span, term, COUNT(*) AS tf FROM (SELECT doc_id, line, span, unnest(terms) AS term FROM units) GROUP BY ALL
), df AS (SELECT term, COUNT(*) AS df FROM tf GROUP BY term),
n AS (SELECT COUNT(*) AS n FROM units),
w AS (SELECT doc_id, line, span, term, tf * (ln((1.0 + n) / (1.0 + df)) + 1.0) AS w FROM tf JOIN df USING (term), n),
t AS (
    SELECT number, template, needs, term, tf * (ln((1.0 + n) / (1.0 + COALESCE(df, 0))) + 1.0) AS w
    FROM (SELECT number, template, needs, term, COUNT(*) AS tf
          FROM (SELECT number, template, needs, unnest(regexp_extract_all(lower(text), '{TERM}')) AS term
                FROM (VALUES {values}) v(number, template, needs, text)) GROUP BY ALL)
         LEFT JOIN df USING (term), n
), tn AS (SELECT number, sqrt(SUM(w * w)) AS norm FROM t GROUP BY number),
wn AS (SELECT doc_id, line, span, sqrt(SUM(w * w)) AS norm FROM w GROUP BY ALL),
scores AS (
    SELECT doc_id, line, span, template, round(dot / wn.norm, {_DIGITS}) AS score
    FROM (SELECT w.doc_id, w.line, w.span, t.number, t.template, len(t.needs) AS needs, SUM(w.w * t.w / tn.norm) AS dot,
                 COUNT(*) FILTER (list_contains(t.needs, term)) AS held
          FROM w JOIN t USING (term) JOIN tn USING (number) GROUP BY ALL) JOIN wn USING (doc_id, line, span)
    WHERE held = needs
), own AS (
    SELECT doc_id, template, score, CASE WHEN name = 'LICENSE' THEN 'file' ELSE 'header' END AS kind
    FROM scores JOIN files USING (doc_id) WHERE score >= {LEAST_COSINE}
    QUALIFY row_number() OVER (
        PARTITION BY doc_id ORDER BY CASE WHEN name = 'LICENSE' THEN line ELSE 0 END, score DESC, template, line DESC
    ) = 1
), held AS (
    SELECT directory AS above, template, score FROM own JOIN files USING (doc_id) WHERE name = 'LICENSE'
    QUALIFY row_number() OVER (PARTITION BY directory ORDER BY score DESC, template) = 1
), near AS (
    SELECT f.doc_id, h.above, h.template, h.score FROM files f JOIN held h ON f.directory = h.above OR starts_with(f.directory, h.above || '/')
    QUALIFY row_number() OVER (PARTITION BY f.doc_id ORDER BY length(h.above) DESC) = 1
)
SELECT f.doc_id, f.directory || '/' || f.name AS path, COALESCE(o.template, i.template) AS license,
       round(CASE WHEN o.template IS NULL THEN i.score ELSE o.score END, 6) AS score,
       CASE WHEN o.template IS NOT NULL THEN o.kind WHEN i.above IS NOT NULL THEN 'inherited' END AS origin,
       CASE WHEN o.template IS NULL THEN i.above END AS origin_dir
FROM files f LEFT JOIN own o USING (doc_id) LEFT JOIN near i USING (doc_id)
"""


SQL = _sql()
