"""License scan in DataFrame operations alone.

A file's headers are the sentences of its whole text that speak of a licence; in a licence file (LICENSE, COPYING and
the like) they speak for its directory. Equal headers are counted first, so that a notice in a third of all files is
one row from there on. Headers and templates are sparse TF-IDF vectors, with document frequencies over all headers and
templates. A file takes the licence of its best header of cosine LEAST or more; a file without one inherits that of the
nearest directory above it (or its own) whose licence files give one, by a join of its directories' paths.

Beside its sentences, a file's header blocks (runs of consecutive lines that speak of a licence: the paragraphs, and
each whole comment) and, in a licence file, its whole text are vectors too, in a space of their own with the licences'
full texts and standard headers; these count from cosine LEAST_WHOLE on. The best cosine of all wins.

Texts are read once: what is cut from them, headers and bags of terms, is written. Cosines take two steps. The terms of
the templates, a bounded table, give each vector its products with all templates and the part of its norm that they
account for; as no term weighs less than its frequency, that bounds its cosine from above. The few vectors whose bound
reaches the threshold meet the document frequencies of their other terms by a join, and get their exact cosines.

Null texts have no headers and null paths no directory; neither fails. Ties go to the first template name, and among a
directory's licence files to the highest cosine, then the first name. Repeated rows are each judged. Very long texts
are read whole. Empty tables give empty results. Columns of files are carried along; clashing names get underscores.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import fresh, hub_join, table, written

LEAST, LEAST_WHOLE = 0.6, 0.8
#: What a header has to contain, in lower case, and the names of licence files.
CUES = ("licen", "copyright", "spdx", "permission is hereby granted")
LICENSE_FILE = r"(?i)^(?:license|licence|copying|notice)(?:\.[a-z]+)?$"
#: Licence, notice.
TEMPLATES = (
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms are permitted under the BSD 3-Clause License"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0"),
)
#: Licence, standard header of a source file, without the name of the work.
_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by the Free Software Foundation, {1}",
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0}General Public License for more details. "
    "You should have received a copy of the GNU {0}General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
)
_LATER = "either version {0} of the License, or (at your option) any later version."
_APACHE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
)
HEADERS = (
    *((name, text.format(kind, _LATER.format(version))) for name, kind, version in (("AGPL-3.0", "Affero ", 3), ("GPL-2.0", "", 2), ("GPL-3.0", "", 3), ("LGPL-2.1", "Lesser ", "2.1"), ("LGPL-3.0", "Lesser ", 3)) for text in (_GNU[0], " ".join(_GNU))),
    ("Apache-2.0", _APACHE[0]), ("Apache-2.0", " ".join(_APACHE)),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
)
#: A line without letters or digits; a line of a comment.
BLANK, COMMENT = r"^[^\p{L}\p{N}]*$", r"^\s*(?:#|//|/?\*|--|;|%|<!--)"
SENTENCE, TERM = r"\n|[.!?;]\s+|[.!?;]$", r"[a-z0-9]+(?:[.-][a-z0-9]+)*"


def _let(x: Column, f) -> Column:
    """f of x, which is computed once."""
    return F.element_at(F.transform(F.array(x), f), 1)


def bag(text) -> Column:
    """The distinct terms of a text with their frequencies, as an array of (term, tf)."""
    terms = F.array_sort(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))
    firsts = lambda t: F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: (i == 0) | (F.get(t, i) != F.get(t, i - 1)))
    ends = lambda t, f: F.concat(F.slice(f, F.lit(2), F.size(f)), F.array(F.size(t)))
    pair = lambda t: lambda i, j: F.struct(F.get(t, i).alias("term"), (j - i).cast("long").alias("tf"))
    none = F.array().cast("array<struct<term:string,tf:bigint>>")
    return _let(terms, lambda t: F.when(F.size(t) == 0, none).otherwise(_let(firsts(t), lambda f: F.zip_with(f, ends(t, f), pair(t)))))


def headers(text):
    """The sentences of a text that speak of a licence."""
    cue = lambda s: F.reduce(F.array(*(F.contains(s, F.lit(c)) for c in CUES)), F.lit(False), lambda a, b: a | b)
    some = F.coalesce(text, F.lit(""))
    return F.when(cue(F.lower(some)), F.filter(F.transform(F.split(some, SENTENCE), lambda s: F.trim(s)), lambda s: cue(F.lower(s)))).otherwise(F.array().cast("array<string>"))


def blocks(text):
    """The header blocks of a text: paragraphs and whole comments that speak of a licence."""
    cue = lambda s: F.reduce(F.array(*(F.contains(F.lower(s), F.lit(c)) for c in CUES)), F.lit(False), lambda a, b: a | b)
    some = F.translate(F.coalesce(text, F.lit("")), "\u0001", " ")
    paragraph = lambda s: s.rlike(BLANK)
    comment = lambda s: F.when(s.rlike(COMMENT), 1).when(s.rlike(BLANK), 0).otherwise(2)

    def runs(lines, kind):
        kinds = F.transform(lines, lambda s: F.struct(s.alias("s"), kind(s).alias("k")))
        marked = lambda x: F.transform(x, lambda e, i: F.when((i > 0) & (F.get(x, i - 1).k != e.k), F.concat(F.lit("\u0001"), e.s)).otherwise(e.s))
        return F.filter(F.split(F.array_join(_let(kinds, marked), "\n"), "\n?\u0001"), cue)

    of = lambda lines: F.array_distinct(F.concat(runs(lines, paragraph), runs(lines, comment)))
    return F.when(cue(some), _let(F.split(some, r"\r?\n"), of)).otherwise(F.array().cast("array<string>"))


def full_texts() -> list[tuple[str, str]]:
    """(licence, template) of licences' full texts and standard headers."""
    return [*((p.stem, p.read_text()) for p in sorted((Path(__file__).parent / "licenses").glob("*.txt"))), *HEADERS]


def matched(bags: DataFrame, known: tuple | list = TEMPLATES, least: float = LEAST) -> DataFrame:
    """(header, license, score) of the best template of each header.

    bags, a written table: id (unique), header (a key: of the same key, the same bag), n (how often it occurs), bag.
    """
    spark = bags.sparkSession
    rows = [(i, name, text) for i, (name, text) in enumerate(known)]
    templates = spark.createDataFrame(rows, "template int, license string, text string").select("template", F.explode(bag("text")).alias("b")).select("template", "b.*")
    total = (bags.agg(F.sum("n")).first()[0] or 0) + len(known)
    each = bags.select("id", "n", F.explode("bag").alias("b")).select("id", "n", "b.*")
    seen = each.groupBy("term").agg(F.sum("n").alias("df")).unionByName(templates.groupBy("term").agg(F.count("*").alias("df")))
    df = written(seen.groupBy("term").agg(F.sum("df").alias("df")), "frequencies")
    idf = F.log(F.lit(float(1 + total)) / (1 + F.col("df"))) + 1
    # a row per term of the templates: its square, and its weight in each template
    ours = templates.groupBy("term").pivot("template", [r[0] for r in rows]).agg(F.sum("tf")).join(df, "term").select(
        F.col("term").alias("ours"), (idf * idf).alias("square"), *((F.coalesce(F.col(f"`{i}`"), F.lit(0)) * idf * idf).alias(f"t{i}") for i, *_ in rows)
    )
    ours = written(ours, "template_terms")
    norms = templates.join(df, "term").groupBy("template").agg(F.sqrt(F.sum(F.col("tf") * F.col("tf") * idf * idf)).alias("tn"))
    norm = {r["template"]: r["tn"] for r in norms.collect()}  # a row per template
    met = each.join(F.broadcast(ours), F.col("term") == F.col("ours"), "left")  # ours: the terms of the templates
    tf, foreign = F.col("tf"), F.col("ours").isNull()
    sums = met.groupBy("id").agg(
        F.sum(F.when(foreign, 0).otherwise(tf * tf * F.col("square"))).alias("own"), F.sum(F.when(foreign, tf * tf).otherwise(0)).alias("rest"),
        *(F.sum(tf * F.coalesce(F.col(f"t{i}"), F.lit(0.0))).alias(f"t{i}") for i, *_ in rows),
    )
    names = {name: F.greatest(*(F.col(f"t{i}") / F.lit(norm.get(i, 1.0)) for i, of, _ in rows if of == name), F.lit(0.0)) for name in sorted({r[1] for r in rows})}
    dots = F.array(*(F.struct(dot.alias("dot"), F.lit(name).alias("license")) for name, dot in names.items()))
    highest = F.array_max(F.transform("dots", lambda d: d.dot))
    near = sums.select("id", "own", "rest", dots.alias("dots")).where((highest > 0) & (highest >= F.lit(least - 1e-5) * F.sqrt(F.col("own") + F.col("rest"))))
    near = written(near.join(bags.select("id", "header", "bag"), "id").groupBy("header").agg(F.first(F.struct("own", "dots", "bag")).alias("f")).select("header", "f.*"), "near")
    more = near.select("header", F.explode("bag").alias("b")).select("header", "b.term", "b.tf").join(F.broadcast(ours.select("ours")), F.col("term") == F.col("ours"), "left_anti")
    counted = more.groupBy("term").agg(F.count("*").alias("rows")).join(df, "term")
    rest = hub_join(more, counted, "term", "rows", F.xxhash64("header")).groupBy("header").agg(F.sum(F.col("tf") * F.col("tf") * idf * idf).alias("more"))
    score = lambda d: F.round(d.dot / F.sqrt(F.col("own") + F.coalesce("more", F.lit(0.0))), 6)
    best = F.array_min(F.transform("dots", lambda d: F.struct((-score(d)).alias("s"), d.license.alias("license"))))
    out = near.join(rest, "header", "left").select("header", best.alias("b")).select("header", "b.license", (-F.col("b.s")).alias("score"))
    return written(out.where(F.col("score") >= least), "matched")


def licenses(files: DataFrame, path: str = "path", text: str = "text", keep: list[str] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """keep (all columns of files) with license, score, origin (own, inherited or null) and from_path; and those columns' names."""
    keep = files.columns if keep is None else keep
    names, wide = {}, files
    for name in ("license", "score", "origin", "from_path"):
        names[name] = fresh(wide, name)
        wide = wide.withColumn(names[name], F.lit(None))
    p = F.col(path)
    of_licence = F.coalesce(F.element_at(F.split(p, "/"), -1).rlike(LICENSE_FILE), F.lit(False))
    whole = F.when(of_licence & F.col(text).isNotNull(), F.array(F.col(text))).otherwise(F.array().cast("array<string>"))
    key = lambda x: F.concat(F.lit("\u0001"), F.sha2(x, 256))
    long = F.transform(F.array_distinct(F.concat(whole, blocks(F.col(text)))), lambda x: F.struct(key(x).alias("header"), bag(x).alias("bag")))
    parent = F.regexp_extract(p, "^(.*)/[^/]*$", 1)
    # under neutral names from here on, whatever the columns of files are called
    at = written(files.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), p.alias("path"), of_licence.alias("declares"), parent.alias("dir"), F.array_distinct(headers(F.col(text))).alias("found"), long.alias("long")), "files")
    notices = at.select(F.explode("found").alias("header")).groupBy("header").agg(F.count("*").alias("n"))
    number = F.monotonically_increasing_id().alias("id")  # the tables are written at once
    short = written(notices.select(number, "header", "n", bag("header").alias("bag")), "notices")
    texts = written(at.select(F.explode("long").alias("l")).select(number, "l.header", F.lit(1).cast("long").alias("n"), "l.bag"), "texts")
    known = matched(short).unionByName(matched(texts, full_texts(), LEAST_WHOLE))
    # a file's licence follows from its set of headers and a directory's from its licence files: both are small tables
    at = at.withColumn("found", F.concat("found", F.transform("long", lambda x: x.header))).drop("long")
    at = at.withColumn("set", F.when(F.size("found") > 0, F.sha2(F.to_json("found"), 256)))
    sets = at.where("set IS NOT NULL").groupBy("set").agg(F.count("*").alias("rows"), F.first("found").alias("found"))
    told = sets.select("set", "rows", F.explode("found").alias("header"))
    counted = told.groupBy("header").agg(F.count("*").alias("uses")).join(known, "header", "left")
    own = hub_join(told, counted, "header", "uses", F.xxhash64("set")).groupBy("set").agg(F.first("rows").alias("rows"), F.min(F.when(F.col("score").isNotNull(), F.struct((-F.col("score")).alias("s"), "license"))).alias("b"))
    own = written(own.select("set", "rows", F.col("b.license").alias("own"), (-F.col("b.s")).alias("own_score")), "sets")
    at = hub_join(at.drop("found"), own, "set", "rows", F.xxhash64("path"), "left")
    by_dir = at.where("declares AND own IS NOT NULL").groupBy("dir").agg(F.min(F.struct((-F.col("own_score")).alias("s"), "own", F.col("path").alias("f"))).alias("b"))
    by_dir = by_dir.select(F.col("dir").alias("above"), F.col("b.own").alias("given"), (-F.col("b.s")).alias("given_score"), F.col("b.f").alias("given_by"))
    # the nearest directory of each distinct parent: its ancestors meet the directories that give a licence
    steps = F.split("dir", "/")
    up = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(steps, F.lit(1), n), "/").alias("above")))
    parents = at.where("dir IS NOT NULL").groupBy("dir").agg(F.count("*").alias("rows"))
    lines = parents.select("dir", "rows", F.explode(up).alias("u")).select("dir", "rows", "u.depth", "u.above")
    shared = written(lines.groupBy("above").agg(F.count("*").alias("uses")).join(by_dir, "above", "left"), "directories")
    near = hub_join(lines, shared, "above", "uses", F.xxhash64("dir"))
    given = F.when(F.col("given").isNotNull(), F.struct("given", "given_score", "given_by"))
    near = written(near.groupBy("dir").agg(F.first("rows").alias("rows"), F.max_by(given, F.when(given.isNotNull(), F.col("depth"))).alias("near")), "nearest")
    out = hub_join(at, near, "dir", "rows", F.xxhash64("path"), "left")
    mine = F.col("own").isNotNull()
    return out.select(
        *(F.col(f"row.`{c}`").alias(c) for c in keep), F.coalesce("own", "near.given").alias(names["license"]), F.coalesce("own_score", "near.given_score").alias(names["score"]),
        F.when(mine, "own").when(F.col("near").isNotNull(), "inherited").alias(names["origin"]), F.when(mine, F.col("path")).otherwise(F.col("near.given_by")).alias(names["from_path"]),
    ), names


def as_files(docs: DataFrame) -> DataFrame:
    """doc_id, path and text of documents laid out as source trees: a directory per thousand ids, a licence file in ten,
    every thousandth of them beside the directories."""
    i = F.col("doc_id")
    name = F.when(i % 10 == 0, F.concat(F.lit("LICENSE."), F.lit("txt"))).otherwise(F.concat(i.cast("string"), F.lit(".txt")))
    folder = F.concat_ws("/", "source", F.when(i % 1000 != 0, F.floor(i / 1000).cast("string")))
    return docs.select("doc_id", F.concat_ws("/", folder, name).alias("path"), "text")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, n = licenses(as_files(table(spark, sf_dir, "documents")), keep=["doc_id", "path"])
    return out.select("doc_id", "path", *(F.col(n[c]).alias(c) for c in ("license", "score", "origin", "from_path")))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


ORACLE = (
    "WITH tpl AS (SELECT * FROM (VALUES "
    + ", ".join(f"({i}, {_quoted(a)}, {_quoted(b)})" for i, (a, b) in enumerate(TEMPLATES))
    + ") AS v(template, license, text)),\n"
    + r"""
f AS (SELECT row_number() OVER () AS rid, doc_id, text, source || '/' || CASE WHEN doc_id % 1000 <> 0 THEN (doc_id // 1000) || '/' ELSE '' END || CASE WHEN doc_id % 10 = 0 THEN 'LICENSE.txt' ELSE doc_id || '.txt' END AS path FROM documents),
s AS (SELECT DISTINCT rid, path, trim(s) AS header FROM (SELECT rid, path, unnest(regexp_split_to_array(coalesce(text, ''), '\n|[.!?;]\s+|[.!?;]$')) AS s FROM f)
  WHERE contains(lower(s), 'licen') OR contains(lower(s), 'copyright') OR contains(lower(s), 'spdx') OR contains(lower(s), 'permission is hereby granted')),
nt AS (SELECT header, count(*) AS n FROM s GROUP BY header),
ht AS (SELECT header, n, term, count(*) AS tf FROM (SELECT header, n, unnest(regexp_extract_all(lower(header), '[a-z0-9]+(?:[.-][a-z0-9]+)*')) AS term FROM nt) GROUP BY ALL),
tt AS (SELECT template, license, term, count(*) AS tf FROM (SELECT template, license, unnest(regexp_extract_all(lower(text), '[a-z0-9]+(?:[.-][a-z0-9]+)*')) AS term FROM tpl) GROUP BY ALL),
idf AS (SELECT term, ln((1 + coalesce((SELECT sum(n) FROM nt), 0) + (SELECT count(*) FROM tpl)) / (1 + sum(n))) + 1 AS idf FROM (SELECT term, n FROM ht UNION ALL SELECT term, 1 FROM tt) GROUP BY term),
h AS (SELECT header, term, tf * idf AS w FROM ht JOIN idf USING (term)),
t AS (SELECT template, license, term, tf * idf AS w FROM tt JOIN idf USING (term)),
hn AS (SELECT header, sqrt(sum(w * w)) AS hn FROM h GROUP BY header), tn AS (SELECT template, sqrt(sum(w * w)) AS tn FROM t GROUP BY template),
cs AS (SELECT header, license, round(sum(h.w * t.w) / (any_value(hn) * any_value(tn)), 6) AS score FROM h JOIN t USING (term) JOIN hn USING (header) JOIN tn USING (template) GROUP BY header, template, license),
b AS (SELECT header, license, score FROM cs WHERE score >= 0.6 QUALIFY row_number() OVER (PARTITION BY header ORDER BY score DESC, license) = 1),
own AS (SELECT rid, path, license, score FROM s JOIN b USING (header) QUALIFY row_number() OVER (PARTITION BY rid ORDER BY score DESC, license) = 1),
dir AS (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, license, score, path AS from_path FROM own WHERE path LIKE '%/LICENSE.txt'
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, license, path) = 1),
near AS (SELECT rid, d.license, d.score, d.from_path FROM f JOIN dir d ON d.dir = regexp_extract(f.path, '^(.*)/[^/]*$', 1) OR d.dir = regexp_extract(f.path, '^([^/]*)/.*$', 1)
  QUALIFY row_number() OVER (PARTITION BY rid ORDER BY length(d.dir) DESC) = 1)
SELECT doc_id, f.path, coalesce(own.license, near.license) AS license, coalesce(own.score, near.score) AS score,
  CASE WHEN own.rid IS NOT NULL THEN 'own' WHEN near.rid IS NOT NULL THEN 'inherited' END AS origin, CASE WHEN own.rid IS NOT NULL THEN f.path ELSE near.from_path END AS from_path
FROM f LEFT JOIN own USING (rid) LEFT JOIN near USING (rid)
"""
)
