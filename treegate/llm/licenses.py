"""Licence scans with DataFrame operations alone.

Candidates of a file are its header lines (lines with a word of ``ANCHORS``) and, where
it has one, its whole text, which are held against ``TEMPLATES``, and its header blocks,
which are held with the whole text against the notices of several lines and the licence
texts in ``NOTICES``.  A block is a paragraph with such a word, or up to ``WINDOW``
paragraphs from one that opens a notice; paragraphs end at lines without a letter or
digit, and once more where comments begin or end.  Each candidate is a sparse TF-IDF vector: terms are runs of ASCII
letters and digits in lower case, weights are counts times the inverse document
frequency over the licence templates, and terms that no template has weigh as the
rarest.  The best cosine to a template of at least ``THRESHOLD`` names the licence;
blocks of several lines at ``STRONG`` or above go first, as a line says less.

A file is a licence file if its name is one of ``LICENCE_NAMES`` or its whole text is a
notice or licence text (``WHOLE``); its licence holds for its directory.  A file without a
licence of its own inherits from the nearest ancestor directory that has one.  Only
distinct directories are expanded into their ancestors, so a directory with a third of
all files is one row there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treegate.llm.notices import NOTICES

THRESHOLD, STRONG, WHOLE, WINDOW = 0.55, 0.75, 0.9, 6

#: Public licence notices, by SPDX identifier; templates of one licence are alternatives.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work: CC0 1.0 public domain dedication"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright Free Software Foundation"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("EPL-2.0", "Licensed under the Eclipse Public License, version 2.0."),
    ("ISC", "Licensed under the ISC License."),
    ("Unlicense", "Released into the public domain under the Unlicense."),
]
TEMPLATES += [(name, f"SPDX-License-Identifier: {name}") for name in sorted({name for name, _ in TEMPLATES})]

#: What a header line or a licence text mentions, and names of licence files.
ANCHORS = "(?i)licen[cs]e|copyright|public domain|spdx|permission is hereby|redistribution and use"
LICENCE_NAMES = ["LICENSE", "LICENSE.md", "LICENSE.txt", "LICENCE", "COPYING", "COPYING.txt", "NOTICE", "UNLICENSE"]

#: What opens a notice of several paragraphs, and a comment line.
OPENINGS = "(?i)redistribution and use|permission (is hereby|to use)|free and unencumbered|licensed (to|under)|free software"
COMMENT = r"[ \t]*(?:#|//|/?\*|--|;|%|!|dnl |rem |REM |<!--)"

_CUT = "[^a-z0-9]+"
_PARAGRAPH = r"\n[^\p{L}\p{N}]*\n"


def _terms(text: F.Column) -> F.Column:
    return F.filter(F.split(F.lower(text), _CUT), lambda t: t != "")


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _templates(spark, templates: list[tuple[str, str]]) -> tuple[DataFrame, DataFrame, float]:
    """(term, template, weight over the vector's length), (term, idf), and the idf of terms in no template.

    As many rows as the templates have terms: a parameter, independent of the files.
    """
    rows = ", ".join(f"({i}, {_quoted(text)})" for i, (_, text) in enumerate(templates))
    base = spark.sql(f"select * from values {rows} as t(template, text)").select("template", F.explode(_terms(F.col("text"))).alias("term")).groupBy("template", "term").agg(F.count("*").alias("n"))
    n = len(templates)
    idf = base.groupBy("term").agg((F.log(F.lit(1.0 + n) / (1.0 + F.count("*"))) + 1.0).alias("idf"))
    rarest = F.log(F.lit(1.0 + n)) + 1.0
    weighed = base.join(idf, "term").withColumn("w", F.col("n") * F.col("idf"))
    norms = weighed.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weighed.join(norms, "template").select("term", "template", (F.col("w") / F.col("norm")).alias("share")), idf, rarest


def _blocks(holding: DataFrame) -> DataFrame:
    """(doc_id, path, unit): the header blocks of files that mention a licence."""
    apart = F.regexp_replace(F.regexp_replace("text", rf"(?m)(^{COMMENT}[^\n]*)\n(?!{COMMENT})", "$1\n\n"), rf"(?m)(^(?!{COMMENT})[^\n]+)\n(?={COMMENT})", "$1\n\n")
    # exploded, so that lambdas read a made array
    cut = holding.select("doc_id", "path", F.explode(F.array_distinct(F.array(F.split("text", _PARAGRAPH), F.split(apart, _PARAGRAPH)))).alias("parts"))
    opening = F.filter(F.sequence(F.lit(0), F.size("parts") - 1), lambda i: F.get("parts", i).rlike(OPENINGS))
    windows = F.flatten(F.transform(opening, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(WINDOW), F.size("parts") - i)), lambda m: F.array_join(F.slice("parts", i + 1, m), "\n"))))
    return cut.select("doc_id", "path", F.explode(F.array_union(F.filter("parts", lambda x: x.rlike(ANCHORS)), windows)).alias("unit"))


def _best(distinct: DataFrame, templates: list[tuple[str, str]], threshold: float) -> DataFrame:
    """(key, license, similarity) of the candidates (key, unit) that are close to a template."""
    shares, idf, rarest = _templates(distinct.sparkSession, templates)
    names = F.create_map(*[x for i, (name, _) in enumerate(templates) for x in (F.lit(i), F.lit(name))])
    counted = distinct.select("key", F.explode(_terms(F.col("unit"))).alias("term")).groupBy("key", "term").agg(F.count("*").alias("n"))
    weighed = counted.join(F.broadcast(idf), "term", "left").withColumn("w", F.col("n") * F.coalesce("idf", rarest))
    norms = weighed.groupBy("key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = weighed.join(F.broadcast(shares), "term").groupBy("key", "template").agg(F.sum(F.col("w") * F.col("share")).alias("dot"))
    cosine = F.round(F.col("dot") / F.col("norm"), 4)
    return dots.join(norms, "key").where(cosine >= threshold).groupBy("key").agg(F.min(F.struct((-cosine).alias("minus"), F.element_at(names, F.col("template")).alias("license"))).alias("b")).select("key", "b.license", (-F.col("b.minus")).alias("similarity"))


def license_scan(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, notices: list[tuple[str, str]] = NOTICES) -> DataFrame:
    """One row per row of ``files`` (doc_id, path, text): (doc_id, path, license, origin, similarity).

    origin: ``file`` (a licence file), ``header`` (a notice in the file), ``inherited``
    (from the nearest ancestor directory), or null with a null license. Ties go to the
    first identifier. Null and empty texts have no notice of their own and inherit; a
    null path inherits nothing; a null doc_id is a row like any other. Rows that repeat
    doc_id and path are each returned with the best notice among them. An empty table
    gives an empty result; other columns are not read.
    """
    rows = files.select("doc_id", "path", F.coalesce("text", F.lit("")).alias("text"))

    # candidates, of files that mention a licence at all
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(ANCHORS))
    holding = rows.where(F.col("text").rlike(ANCHORS))
    # equal candidates are one, whatever the number of files that hold them
    keyed = lambda df: df.select("doc_id", "path", "whole", F.sha2("unit", 256).alias("key"), "unit")
    whole = holding.select("doc_id", "path", F.lit(True).alias("whole"), F.col("text").alias("unit"))
    units = keyed(holding.select("doc_id", "path", F.lit(False).alias("whole"), F.explode(F.array_distinct(lines)).alias("unit")).unionByName(whole))
    blocks = keyed(_blocks(holding).withColumn("whole", F.lit(False)).unionByName(whole))
    near = lambda df, against: df.join(_best(df.select("key", "unit").dropDuplicates(["key"]), against, threshold), "key")
    several = F.col("unit").rlike(r"[\p{L}\p{N}][^\n]*\n[^\p{L}\p{N}]*[\p{L}\p{N}]")
    strong = (F.col("similarity") >= STRONG) & (F.col("whole") | several)
    # a text that is one such line says under what it stands, but is no licence for others
    ranked = near(units, templates).withColumn("rank", F.when(F.col("whole"), 1).otherwise(2)).withColumn("whole", F.lit(False))
    noticed = near(blocks, notices).withColumn("rank", F.when(strong, 0).otherwise(2)).withColumn("whole", F.col("whole") & (F.col("similarity") >= WHOLE))

    order = F.struct(F.col("rank").alias("rank"), (-F.col("similarity")).alias("minus"), F.col("license").alias("license"))
    found = ranked.drop("unit").unionByName(noticed.drop("unit"))
    own = found.groupBy("doc_id", "path").agg(F.min(order).alias("o"), F.max("whole").alias("whole")).select(F.col("doc_id").alias("__id"), F.col("path").alias("__path"), F.col("o.license").alias("own"), (-F.col("o.minus")).alias("similarity"), "whole")
    named = F.element_at(F.split("path", "/"), -1).isin(LICENCE_NAMES)
    joined = rows.select("doc_id", "path").join(own, F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("path").eqNullSafe(F.col("__path")), "left").select("doc_id", "path", "own", "similarity", (F.col("own").isNotNull() & F.coalesce(F.col("whole") | named, F.lit(False))).alias("is_file"), F.regexp_replace("path", "/?[^/]*$", "").alias("dir"))

    # licences of directories, and the nearest one above each directory in need
    held = joined.where("is_file and path is not null").groupBy("dir").agg(F.min(F.struct((-F.col("similarity")).alias("minus"), F.col("own").alias("license"))).alias("h")).select(F.col("dir").alias("ancestor"), F.col("h.license").alias("held"), (-F.col("h.minus")).alias("held_similarity"))
    parts = F.split("dir", "/")
    ancestors = F.when(F.col("dir") == "", F.array(F.lit(""))).otherwise(F.array_union(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))))
    needy = joined.where("own is null and path is not null").select("dir").distinct().select("dir", F.posexplode(ancestors).alias("depth", "ancestor"))
    nearest = needy.join(held, "ancestor").groupBy("dir").agg(F.max(F.struct("depth", "held", "held_similarity")).alias("a")).select(F.col("dir").alias("__dir"), "a.held", "a.held_similarity")
    final = joined.join(nearest, (F.col("dir") == F.col("__dir")) & F.col("own").isNull(), "left")
    origin = F.when(F.col("is_file"), "file").when(F.col("own").isNotNull(), "header").when(F.col("held").isNotNull(), "inherited")
    return final.select("doc_id", "path", F.coalesce("own", "held").alias("license"), origin.alias("origin"), F.coalesce("similarity", "held_similarity").alias("similarity"))


def oracle(templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same scan of ``documents`` in DuckDB SQL, on the paths of the query."""
    values = ", ".join("({}, '{}', '{}')".format(i, name, text.replace("'", "''")) for i, (name, text) in enumerate(templates))
    licence_names = ", ".join(f"'{x}'" for x in LICENCE_NAMES)
    anchors = ANCHORS.removeprefix("(?i)")
    n = len(templates)
    return f"""
with t as (select * from (values {values}) t(template, license, text)),
tt as (select template, term, count(*) n from (select template, unnest(regexp_split_to_array(lower(text), '{_CUT}')) term from t) where term <> '' group by 1, 2),
idf as (select term, ln({1.0 + n} / (1.0 + count(*))) + 1.0 idf from tt group by 1),
tw as (select tt.template, tt.term, n * idf w from tt join idf using (term)),
shares as (select template, term, w / sqrt(sum(w * w) over (partition by template)) share from tw),
f as (select doc_id, concat(source, '/', doc_id // 1000, '/', doc_id, '.txt') path, coalesce(text, '') text from documents),
h as (select * from f where regexp_matches(text, '{anchors}', 'i')),
u as (select doc_id, path, false whole, unnest(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{anchors}', 'i'))) unit from h
      union all select doc_id, path, true, text from h),
d as (select distinct unit from u),
c as (select unit, term, count(*) n from (select unit, unnest(regexp_split_to_array(lower(unit), '{_CUT}')) term from d) where term <> '' group by 1, 2),
w as (select unit, term, n * coalesce(idf, ln({1.0 + n}) + 1.0) w from c left join idf using (term)),
norms as (select unit, sqrt(sum(w * w)) norm from w group by 1),
dots as (select unit, template, sum(w * share) dot from w join shares using (term) group by 1, 2),
cos as (select unit, license, round(dot / norm, 4) cosine from dots join norms using (unit) join t using (template)),
best as (select unit, license, cosine from cos where cosine >= {threshold} qualify row_number() over (partition by unit order by cosine desc, license) = 1),
own as (select doc_id, path, license own, cosine similarity, whole from u join best using (unit)
        qualify row_number() over (partition by doc_id, path order by whole desc, cosine desc, license) = 1),
j as (select f.doc_id, f.path, own, similarity, own is not null and split_part(f.path, '/', -1) in ({licence_names}) is_file, regexp_replace(f.path, '/?[^/]*$', '') dir from f left join own using (doc_id, path)),
held as (select dir ancestor, own held, similarity held_similarity from j where is_file qualify row_number() over (partition by dir order by similarity desc, own) = 1),
near as (select j.dir, held, held_similarity from (select distinct dir from j where own is null) j join held on ancestor = '' or j.dir = ancestor or starts_with(j.dir, concat(ancestor, '/'))
         qualify row_number() over (partition by j.dir order by length(ancestor) desc) = 1)
select doc_id, path, coalesce(own, held) license,
       case when is_file then 'file' when own is not null then 'header' when held is not null then 'inherited' end origin,
       coalesce(similarity, held_similarity) similarity
from j left join near on j.dir = near.dir and own is null
"""
