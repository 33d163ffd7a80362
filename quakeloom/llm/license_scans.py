"""License scans: TF-IDF cosine of header lines to templates, inherited along directories. DataFrame
functions only.

Every line or sentence of a whole text that speaks of a licence is a header. Equal headers are scored
once. Headers and templates are sparse vectors of token counts times inverse document frequency over
all distinct headers and templates, of which a license may have several; the best template of cosine
`threshold` or more names the header's license unless another license is nearly as close (a line that
leaves the version open names none), and the best header names the file's. The texts of licence files are vectors as a whole too, of
token counts, and are compared with the characteristic paragraphs of full license texts; the share of a
paragraph's weight that a text covers in the same proportions must reach `WHOLE_THRESHOLD`. A licence file (LICENSE, COPYING and the like) gives its
license to its directory. A file without a license of its own takes that of its nearest ancestor
directory, found by joining the directories' ancestors with the licensed ones.

Defined results: null and empty texts have no header; a null path lies in the root directory; a header
between two licenses has none; between headers of a file the higher cosine counts, then the first name;
repeated rows are each answered; columns other than doc_id, path and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeloom.session import cut, table

#: The usual sentences and titles by which texts state these licenses.
STATEMENTS = (
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-1.1", "Licensed under the Apache Software License, Version 1.1."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "Licensed under GPL version 2 only."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under GPL version 3 only."),
    ("ISC", "Released under the ISC License."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "The MIT License (MIT)"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This work is subject to the terms of the Mozilla Public License, version 2.0."),
)
#: Licenses whose machine-readable identifier also says "only" or "or later".
VERSIONED = ("AGPL-3.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0")
_NAMES = sorted({name for name, _ in STATEMENTS})
_IDENTIFIERS = [(n, n) for n in _NAMES] + [(n, n + end) for n in VERSIONED for end in ("-only", "-or-later")]
TEMPLATES = STATEMENTS + tuple((name, f"SPDX-License-Identifier: {i}") for name, i in _IDENTIFIERS)
THRESHOLD = 0.7
#: Largest distance (1 - cosine) to a header's license, as a share of the distance to the next one.
CLEAR = 0.6
#: Characteristic paragraphs of the full texts, for licence files without a title line.
FULL_TEXTS = (
    ("Apache-2.0", """Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""),
    ("GPL-3.0", """The GNU General Public License is a free, copyleft license for software and other kinds of works. The licenses for most software and other practical works are designed to take away your freedom to share and change the works. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change all versions of a program, to make sure it remains free software for all its users."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""),
    ("LGPL-3.0", """This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below."""),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""),
    ("MPL-2.0", """Each Contributor hereby grants You a world-wide, royalty-free, non-exclusive license under intellectual property rights (other than patent or trademark) Licensable by such Contributor to use, reproduce, make available, modify, display, perform, distribute, and otherwise exploit its Contributions, either on an unmodified basis, with Modifications, or as part of a Larger Work."""),
)
#: Covered share of a paragraph.
WHOLE_THRESHOLD = 0.9
HEADER, SPLIT, TOKEN = r"(?i)licen[cs]", r"\n|(?<=[.!?])[ \t]+", r"[\p{L}\p{N}]+(?:[.-][\p{L}\p{N}]+)*"
LICENSE_FILE = r"(?i)(^|/)(licen[cs]e|copying|copyright)[^/]*$"


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 0)


def headers(files: DataFrame) -> DataFrame:
    """doc_id, path and each header, from files that have one."""
    lines = F.explode(F.array_distinct(F.split(F.col("text"), SPLIT))).alias("header")
    return files.where(F.col("text").rlike(HEADER)).select("doc_id", "path", lines).where(F.col("header").rlike(HEADER))


def scored(distinct: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """header, license and cosine of the distinct headers that are like a template."""
    spark = distinct.sparkSession
    given = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(n).alias("license"), F.lit(t).alias("template"), F.lit(t).alias("header")) for n, t in templates))).alias("x")).select("x.*")
    count = lambda df, *keys: df.select(*keys, F.explode(_tokens(F.col("header"))).alias("token")).groupBy(*keys, "token").agg(F.count("*").alias("tf"))
    ours, theirs = count(distinct, "header"), count(given, "license", "template")
    each = ours.select("token").unionByName(theirs.select("token"))
    frequency = each.groupBy("token").agg(F.count("*").alias("df"))
    idf = frequency.select("token", (F.log(F.lit(distinct.count() + len(templates)) / F.col("df")) + 1).alias("idf"))
    weigh = lambda df, *keys: df.join(idf, "token").select(*keys, "token", (F.col("tf") * F.col("idf")).alias("w"))
    a, b = weigh(ours, "header"), weigh(theirs, "license", "template")
    norms = a.groupBy("header").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    lengths = b.groupBy("license", "template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    # templates are few and fixed: all their tokens fit every task
    dots = a.join(F.broadcast(b.withColumnRenamed("w", "v")), "token").groupBy("header", "license", "template").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    cosine = F.floor(F.col("dot") / (F.col("norm") * F.col("length")) * 1e6 + 0.5) / 1e6
    near = dots.join(norms, "header").join(F.broadcast(lengths), ["license", "template"]).groupBy("header", "license").agg(F.max(cosine).alias("cosine"))
    ranked = F.sort_array(F.collect_list(F.struct("cosine", "license")), asc=False)  # one entry a license
    best, rest = F.col("ranked")[0], F.try_element_at("ranked", F.lit(2))["cosine"]
    clear = (best["cosine"] >= threshold) & (1.0 - best["cosine"] <= CLEAR * (1.0 - F.coalesce(rest, F.lit(0.0))))
    return near.groupBy("header").agg(ranked.alias("ranked")).where(clear).select("header", best["license"].alias("license"), best["cosine"].alias("cosine"))


def whole_files(files: DataFrame, texts=FULL_TEXTS, threshold: float = WHOLE_THRESHOLD) -> DataFrame:
    """doc_id, path, license and cosine of the licence files that hold a full text's paragraph.

    Words in pairs, as prose shares single words with any license. The vectors are token counts over the
    whole text, cut at the paragraph's own counts: the file may hold more than the paragraph. Ties go to
    the longest paragraph, as one license's conditions hold another's.
    """
    spark = files.sparkSession
    given = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(n).alias("license"), F.lit(t).alias("text")) for n, t in texts))).alias("x")).select("x.*")
    words = F.filter(_tokens(F.coalesce(F.col("text"), F.lit(""))), lambda t: ~t.rlike(r"^\d+\.?$"))
    couples = lambda w: F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    count = lambda df, *keys: df.select(*keys, words.alias("w")).select(*keys, F.explode(couples(F.col("w"))).alias("token")).groupBy(*keys, "token").agg(F.count("*").alias("tf"))
    theirs = count(given, "license")
    lengths = theirs.groupBy("license").agg(F.sum(F.col("tf") * F.col("tf")).alias("length"))
    ours = count(files.where(F.col("path").rlike(LICENSE_FILE)), "doc_id", "path")
    cut_off = F.least(F.col("tf"), F.col("v"))
    dots = ours.join(F.broadcast(theirs.withColumnRenamed("tf", "v")), "token").groupBy("doc_id", "path", "license").agg(F.sum(cut_off * F.col("v")).alias("dot"), F.sum(cut_off * cut_off).alias("norm"))
    # the cosine with the file's cut vector, which lies within the paragraph
    cosine = F.floor(F.col("dot") / F.sqrt(F.col("norm") * F.col("length")) * 1e6 + 0.5) / 1e6
    near = dots.join(F.broadcast(lengths), "license").select("doc_id", "path", "license", "length", cosine.alias("cosine")).where(F.col("cosine") >= threshold)
    best = F.max(F.struct("length", "cosine", "license")).alias("x")
    return near.groupBy("doc_id", "path").agg(best).select("doc_id", "path", F.col("x.license").alias("license"), F.col("x.cosine").alias("cosine"))


def directory(path: Column) -> Column:
    """Path without its last part; the root is the empty string."""
    return F.regexp_replace(F.coalesce(path, F.lit("")), r"/?[^/]*$", "")


def scan(files: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, path, license, how ('header', 'text' or 'inherited') and cosine of every file; null without a license."""
    files = files.select("doc_id", "path", "text")
    found = cut(headers(files))
    named = found.join(scored(found.select("header").distinct(), templates, threshold), "header")
    # a header says by name what a full text only tells by its words
    mine = ["doc_id", "path", "license", "cosine"]
    ranked = named.select(*mine, F.lit(0).alias("rank")).unionByName(whole_files(files).select(*mine, F.lit(1).alias("rank")))
    best = F.min(F.struct("rank", (-F.col("cosine")).alias("farness"), "license")).alias("x")
    own = ranked.groupBy("doc_id", "path").agg(best).select(F.col("doc_id").alias("own_id"), F.col("path").alias("own_path"), F.col("x.license").alias("own"), F.col("x.rank").alias("rank"), (-F.col("x.farness")).alias("cosine"))

    licensed = own.where(F.col("own_path").rlike(LICENSE_FILE)).groupBy(directory(F.col("own_path")).alias("ancestor")).agg(F.min(F.struct((-F.col("cosine")).alias("farness"), F.col("own").alias("license"))).alias("x"))
    licensed = licensed.select("ancestor", F.col("x.license").alias("given"))
    places = files.select(directory(F.col("path")).alias("dir")).distinct()
    parts = F.split("dir", "/")
    up = F.transform(F.sequence(F.lit(0), F.when(F.col("dir") == "", 0).otherwise(F.size(parts))), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("ancestor")))
    nearest = places.select("dir", F.explode(up).alias("x")).select("dir", "x.*").join(licensed, "ancestor").groupBy("dir").agg(F.max_by("given", "depth").alias("given"))

    out = files.select("doc_id", "path", directory(F.col("path")).alias("dir"))
    out = out.join(own, F.col("doc_id").eqNullSafe(F.col("own_id")) & F.col("path").eqNullSafe(F.col("own_path")), "left").join(nearest, "dir", "left")
    how = F.when(F.col("rank") == 1, "text").when(F.col("own").isNotNull(), "header").when(F.col("given").isNotNull(), "inherited")
    return out.select("doc_id", "path", F.coalesce("own", "given").alias("license"), how.alias("how"), "cosine")


def with_paths(documents: DataFrame) -> DataFrame:
    """Documents as files: a folder per source, thousand and hundred; every fiftieth is its folder's licence file."""
    place = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.floor(F.col("doc_id") / 1000), F.floor(F.col("doc_id") / 100))
    name = F.when(F.col("doc_id") % 50 == 0, F.lit("LICENSE")).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return documents.select("doc_id", F.concat_ws("/", place, name).alias("path"), "text")


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The license of every document and where it comes from."""
    return scan(with_paths(table(spark, sf_dir, "documents")))


_VALUES = ", ".join("('{}', '{}')".format(n, t) for n, t in TEMPLATES)
ORACLE = rf"""
WITH f AS MATERIALIZED (SELECT doc_id, text, concat_ws('/', coalesce(source, 'none'), doc_id // 1000, doc_id // 100) AS dir,
  concat_ws('/', coalesce(source, 'none'), doc_id // 1000, doc_id // 100, CASE WHEN doc_id % 50 = 0 THEN 'LICENSE' ELSE doc_id || '.txt' END) AS path FROM documents),
tpl(license, template) AS (VALUES {_VALUES}),
l AS (SELECT DISTINCT doc_id, unnest(string_split_regex(regexp_replace(text, '([.!?])[ \t]+', '\1' || chr(10), 'g'), '\n')) AS header FROM f WHERE regexp_matches(text, '{HEADER}')),
h AS MATERIALIZED (SELECT * FROM l WHERE regexp_matches(header, '{HEADER}')),
dh AS MATERIALIZED (SELECT DISTINCT header FROM h),
ot AS MATERIALIZED (SELECT header, token, count(*) AS tf FROM (SELECT header, unnest(regexp_extract_all(lower(header), '{TOKEN}')) AS token FROM dh) GROUP BY ALL),
tt AS MATERIALIZED (SELECT license, template, token, count(*) AS tf FROM (SELECT license, template, unnest(regexp_extract_all(lower(template), '{TOKEN}')) AS token FROM tpl) GROUP BY ALL),
idf AS MATERIALIZED (SELECT token, ln((SELECT count(*) + {len(TEMPLATES)} FROM dh) / count(*)) + 1 AS idf FROM (SELECT token FROM ot UNION ALL SELECT token FROM tt) GROUP BY token),
a AS MATERIALIZED (SELECT header, token, tf * idf AS w FROM ot JOIN idf USING (token)),
b AS MATERIALIZED (SELECT license, template, token, tf * idf AS w FROM tt JOIN idf USING (token)),
c AS (SELECT header, license, template, floor(sum(a.w * b.w) / (any_value(na.n) * any_value(nb.n)) * 1e6 + 0.5) / 1e6 AS cosine
  FROM a JOIN b USING (token) JOIN (SELECT header, sqrt(sum(w * w)) AS n FROM a GROUP BY 1) na USING (header)
  JOIN (SELECT license, template, sqrt(sum(w * w)) AS n FROM b GROUP BY 1, 2) nb USING (license, template) GROUP BY header, license, template),
ranked AS (SELECT header, license, max(cosine) AS cosine FROM c GROUP BY 1, 2),
best AS (SELECT header, license, cosine FROM (SELECT *, row_number() OVER o AS place, lead(cosine) OVER o AS rest FROM ranked WINDOW o AS (PARTITION BY header ORDER BY cosine DESC, license DESC))
  WHERE place = 1 AND cosine >= {THRESHOLD} AND 1e0 - cosine <= {CLEAR}::DOUBLE * (1e0 - coalesce(rest, 0e0))),
own AS MATERIALIZED (SELECT doc_id, license, cosine FROM h JOIN best USING (header) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC, license) = 1),
lic AS (SELECT dir AS ancestor, license FROM own JOIN f USING (doc_id) WHERE doc_id % 50 = 0 QUALIFY row_number() OVER (PARTITION BY dir ORDER BY cosine DESC, license) = 1),
near AS (SELECT dir, max_by(license, length(ancestor)) AS given FROM (SELECT DISTINCT dir FROM f) JOIN lic ON starts_with(dir || '/', ancestor || '/') GROUP BY dir)
SELECT doc_id, path, coalesce(license, given) AS license, CASE WHEN license IS NOT NULL THEN 'header' WHEN given IS NOT NULL THEN 'inherited' END AS how, cosine
FROM f LEFT JOIN own USING (doc_id) LEFT JOIN near USING (dir)"""

QUERIES = {"op9_license_scans": op9_license_scans}
ORACLE_SQL = {"op9_license_scans": ORACLE}
