"""License scan: sparse TF-IDF cosine to templates, then inheritance by directory.

Native DataFrame code. Possible headers are, over every whole text, each line, each
run of consecutive lines with words that consist mostly of header words, each part
of a run of 2 to ``window`` lines (None: of any number), and the whole text. Lines,
runs and parts are compared with the ``TEMPLATES``, whole texts with the full license
texts in ``license_texts``. Lines without a word (blank, or a comment mark) do not end
a run. A line with an SPDX tag names the licenses of its expression.

Features are the distinct words, weighted by inverse document frequency; the
frequencies of the template words are counted over all lines of the corpus (for
whole texts: over all texts), and a word that no template has weighs as much as one
seen once. The cosine of a header and a template is summed over the words they
share, by a join with the templates' postings (a fixed table). A cosine of at least
``threshold`` is a match. A match needs at least threshold ** 2 of a header's words
to be template words, since no word weighs more than a foreign one, so others go no
further. Runs are lines of which each meets that; a part of a run or a whole text
counts as a header of its own only if it holds no smaller match, but all compete for
the license.

A match names the template of the highest cosine. What several licenses of one name
share (a sentence of both BSD licenses; a part of a notice that leaves the version
out) names the group, such as BSD. Evidence is then weighed: an SPDX tag before a
whole text, that before other matches, and of those the one that shares more words
with its template, then the higher cosine, then the smaller name. A match that
overlaps stronger evidence for a license of the same kin (the same name, or GNU) is a
piece of that and names nothing; nor does a group of which a member is found.

A file that is named as a license file, or all of whose lines with words match, or
that matches a full text, is a license file. A file's license is that of its own
strongest match, else that of the nearest directory above it that holds a license
file. Ancestor paths are exploded and joined with the directories that have one.

Among license files of a directory the smaller path decides. Null and empty texts have
no header and can only inherit; a null path has no directory. A text of any length is
read whole; its lines are rows. Repeated rows are answered each. An empty table gives
an empty result. Columns named like results are left out, other columns, whatever
their names, carried.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pactum.llm.rowkeys import let
from pactum.plans.scratch import scope, small, written

# Sentences and notices by which licenses are known; a name without a version is a group.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("Proprietary", "All rights reserved."),
)

#: A tag's license expression, and what stands between its licenses.
SPDX_TAG = "SPDX-License-Identifier:"
SPDX = r"SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+\-() \t]+)"
SPDX_BETWEEN = r"(?i)[()]|\s+WITH\s+[A-Z0-9.\-]+|\s+(AND|OR)\s+"

#: Lines of a part of a run; None for parts of any number, whose count grows with the square of a run.
WINDOW = 8

LICENSE_FILE = r"(?i)^(license|licence|copying|notice|unlicense)([.\-_].*)?$"

#: A word: letters and digits, with . + - between them.
WORD = r"[\p{L}\p{N}]+(?:[.+-]+[\p{L}\p{N}]+)*"

THRESHOLD = 0.75

#: Columns of the result; columns of the files with these names are left out.
RESULT = ("license", "cosine", "origin", "n_headers", "licenses", "license_dir")


def line_words(line: Column) -> Column:
    """Distinct lower-cased words of a line."""
    return F.array_distinct(F.regexp_extract_all(F.lower(line), F.lit(WORD), F.lit(0)))


def _vocabulary(templates) -> list[str]:
    return sorted({w for _, t in templates for w in re.findall(r"[^\W_]+(?:[.+-]+[^\W_]+)*", t.lower())})


def _template_table(spark: SparkSession, templates) -> DataFrame:
    rows = spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(templates)], "template int, license string, text string")
    return rows.select("template", "license", F.explode(line_words(F.col("text"))).alias("word"))


def full_texts() -> tuple[tuple[str, str], ...]:
    return tuple((p.stem, p.read_text(encoding="utf-8")) for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt")))


def stem(license: Column) -> Column:
    """A license's name without versions and clauses, which is the name of its group."""
    return F.regexp_extract(license, "^[^-]+", 0)


def kin(license: Column) -> Column:
    """Licenses whose texts share sentences."""
    return F.when(stem(license).isin("GPL", "LGPL", "AGPL"), "GNU").otherwise(stem(license))


def _matches(known: DataFrame, seen: DataFrame, total: int, templates, threshold: float) -> DataFrame:
    """_file, block, license, cosine, words (those shared) for blocks (_file, block, n, _known) that match, by their best template."""
    idf = lambda df: F.log((1.0 + total) / (1.0 + df)) + 1.0
    foreign = idf(F.lit(1.0))
    words = _template_table(known.sparkSession, templates).join(F.broadcast(seen), "word", "left").withColumn("w", F.least(idf(F.coalesce("df", F.lit(0)).cast("double")), foreign)).withColumn("w2", F.col("w") * F.col("w"))
    norms = Window.partitionBy("template")
    # a fixed table: a row for each word of each template
    postings = words.select("template", "license", F.col("word").alias("_word"), "w2", F.count("*").over(norms).alias("template_words"), F.sqrt(F.sum("w2").over(norms)).alias("template_norm"))
    near = known.filter(F.size("_known") >= threshold * threshold * F.col("n")).select("_file", "block", "n", F.explode("_known").alias("word"))
    near = near.distinct().join(F.broadcast(words.select(F.col("word").alias("_w"), F.col("w2").alias("_w2")).distinct()), F.col("word") == F.col("_w"))
    size = near.groupBy("_file", "block").agg(F.sqrt(F.sum("_w2") + (F.max("n") - F.count("*")) * foreign * foreign).alias("norm"))
    dots = near.select("_file", "block", "word").join(F.broadcast(postings), F.col("word") == F.col("_word")).groupBy("_file", "block", "template", "license", "template_words", "template_norm").agg(F.sum("w2").alias("dot"), F.count("*").alias("words"))
    scored = dots.join(size, ["_file", "block"]).withColumn("cosine", F.round(F.col("dot") / (F.col("norm") * F.col("template_norm")), 9)).filter(F.col("cosine") >= threshold)
    # at most a row for each template
    found = scored.groupBy("_file", "block").agg(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("c"), "license", "words", F.col("template_words").alias("of"), stem(F.col("license")).alias("stem")))).alias("_t"))
    best = F.col("_t")[0]
    alike = F.array_distinct(F.transform(F.filter("_t", lambda x: (x["stem"] == best["stem"]) & (x["words"] == best["words"]) & (x["of"] == best["of"])), lambda x: x["license"]))
    return found.select("_file", "block", F.when(F.size(alike) > 1, best["stem"]).otherwise(best["license"]).alias("license"), (-best["c"]).alias("cosine"), best["words"].alias("words"))


def _tagged(files: DataFrame) -> DataFrame:
    """_file, line_no, license of every license that an SPDX tag names; lines are numbered among those with words."""
    names = {n.lower(): n for n, _ in (*TEMPLATES, *full_texts()) if "-" in n or n in ("MIT", "ISC", "Unlicense")}
    known = F.create_map(*(F.lit(x) for pair in sorted(names.items()) for x in pair))
    lines = files.filter(F.contains("text", F.lit(SPDX_TAG))).select("_file", F.posexplode(F.filter(F.split("text", "\n"), lambda x: F.size(line_words(x)) > 0)).alias("line_no", "_line"))
    ids = F.split(F.regexp_replace(F.regexp_extract("_line", SPDX, 1), SPDX_BETWEEN, " "), r"\s+")
    ids = lines.filter(F.contains("_line", F.lit(SPDX_TAG))).select("_file", "line_no", F.explode(ids).alias("_id")).filter("_id <> ''")
    plain = F.regexp_replace("_id", r"(?i)(-only|-or-later|\+)$", "")
    return ids.select("_file", "line_no", F.coalesce(F.try_element_at(known, F.lower(plain)), plain).alias("license")).distinct()


def _frequencies(known: DataFrame, name: str) -> tuple[DataFrame, int]:
    """(word, df) over all blocks, and their number; at most one row for each template word and task is shuffled."""
    seen = written(known.select(F.explode(F.concat("_known", F.array(F.lit("")))).alias("word")).groupBy("word").agg(F.count("*").alias("df")), name)
    return seen, seen.filter("word = ''").agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]


def _run_parts(near: DataFrame, window: int | None) -> DataFrame:
    """(_file, block, _words): every run of two lines or more of (_file, line_no, _words), and its parts of up to ``window`` lines."""
    run = F.col("line_no") - F.row_number().over(Window.partitionBy("_file").orderBy("line_no"))
    near = near.withColumn("_run", run)
    # a line and those that follow it in its run, as far as a part may reach
    ahead = Window.partitionBy("_file", "_run").orderBy("line_no").rowsBetween(Window.currentRow, Window.unboundedFollowing if window is None else window - 1)
    begun = near.select("_file", F.col("line_no").alias("first"), F.collect_list("_words").over(ahead).alias("_r")).filter(F.size("_r") > 1)
    parts = begun.select("_file", "first", "_r", F.explode(F.sequence(F.lit(2), F.size("_r"))).alias("_k"))
    block = F.struct("first", "last").alias("block")
    parts = parts.withColumn("last", F.col("first") + F.col("_k") - 1).select("_file", block, F.array_distinct(F.flatten(F.slice("_r", F.lit(1), F.col("_k")))).alias("_words"))
    if window is None:
        return parts
    whole = near.select("_file", "_run", "line_no", F.explode("_words").alias("_word")).groupBy("_file", "_run").agg(F.min("line_no").alias("first"), F.max("line_no").alias("last"), F.collect_set("_word").alias("_words"))
    return parts.unionByName(whole.filter(F.col("last") - F.col("first") >= window).select("_file", block, "_words"))


def headers(files: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, texts=None, window: int | None = WINDOW) -> DataFrame:
    """_file, first and last of the lines with words, kind (2 a tag, 1 a whole text, 0 others), license, cosine, words, own of every match; own: it holds no smaller one."""
    texts = full_texts() if texts is None else texts
    among = lambda words, given: F.array_intersect(words, F.array(*map(F.lit, _vocabulary(given))))
    split = files.select("_file", F.filter(F.transform(F.split("text", "\n"), line_words), lambda w: F.size(w) > 0).alias("_lines")).filter(F.size("_lines") > 0)
    split = written(split, "line-words")
    lines = split.select("_file", F.posexplode("_lines").alias("line_no", "_words"))
    line = F.struct(F.col("line_no").alias("first"), F.col("line_no").alias("last")).alias("block")
    known = lambda blocks, given: blocks.select("_file", "block", F.size("_words").alias("n"), among(F.col("_words"), given).alias("_known"))
    seen, total = _frequencies(known(lines.select("_file", line, "_words"), templates), "line-frequency")
    near = lines.withColumn("_known", among(F.col("_words"), templates)).filter(F.size("_known") >= threshold * threshold * F.size("_words"))
    near = written(near.distinct(), "near-lines")
    single = written(_matches(near.select("_file", line, F.size("_words").alias("n"), "_known"), seen, total, templates, threshold), "single")
    runs = written(_matches(known(_run_parts(near.select("_file", "line_no", "_words"), window), templates), seen, total, templates, threshold), "runs")
    # a text of one line is a line; equal rows are one text
    whole = split.filter(F.size("_lines") > 1).select("_file", F.struct(F.lit(0).alias("first"), (F.size("_lines") - 1).alias("last")).alias("block"), F.array_distinct(F.flatten("_lines")).alias("_words"))
    whole = written(known(whole, texts), "text-words")
    seen_whole, texts_total = _frequencies(whole, "text-frequency")
    whole_found = written(_matches(whole, seen_whole, texts_total, texts, threshold), "whole")
    tags = _tagged(files).select("_file", line, "license", F.lit(1.0).alias("cosine"), F.lit(0).cast("long").alias("words"))
    found = [t.select("_file", "block.first", "block.last", F.lit(k).alias("kind"), "license", "cosine", "words") for t, k in ((single, 0), (runs, 0), (whole_found, 1), (tags, 2))]
    # the least match that begins at a line or later and ends first: an own match ends before any that holds it
    order = Window.partitionBy("_file").orderBy(F.col("first").desc(), F.col("last"), F.col("kind") == 1).rowsBetween(Window.unboundedPreceding, -1)
    least = F.min("last").over(order)
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3]).withColumn("own", least.isNull() | (least > F.col("last")))


def strongest(found: DataFrame) -> DataFrame:
    """_file, license, kind, words, cosine: the best match for each license, of those that overlap no stronger one of their kin."""
    strength = F.struct("kind", "words", "cosine")
    lines = found.select("_file", "first", "last", "license", strength.alias("_s"), F.explode(F.sequence("first", "last")).alias("_line"))
    # a line is in a bounded number of parts, and in one run and one whole text
    most = F.max("_s").over(Window.partitionBy("_file", kin(F.col("license")), "_line"))
    kept = lines.withColumn("_most", most).groupBy("_file", "first", "last", "license", "_s").agg(F.bool_and(F.col("_most") == F.col("_s")).alias("_kept"))
    return kept.filter("_kept").groupBy("_file", "license").agg(F.max("_s").alias("_s")).select("_file", "license", "_s.*")


def directory(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).when(path.isNotNull(), F.lit(""))


def ancestors(path: Column) -> Column:
    """(depth, directory) of every directory above a path, the root ('') included."""
    parts = F.split(directory(path), "/")
    up = lambda a: F.transform(F.sequence(F.lit(0), F.when(a[0] == "", F.size(a) - 1).otherwise(F.size(a))), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(a, F.lit(1), n + F.when(a[0] == "", 1).otherwise(0)), "/").alias("dir")))
    return F.when(path.isNotNull(), let(parts, up))


def scan_licenses(files: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, window: int | None = WINDOW) -> DataFrame:
    """``files`` (path, text, and other columns) with license, cosine, origin ('header', 'inherited' or null), n_headers, licenses, license_dir.

    Only (row number, path, matches) are shuffled, never texts: the result is
    keyed by the columns other than the text.
    """
    own = F.struct(*(F.col(f"`{c}`") for c in files.columns if c != "text"))
    keyed = files.select(own.alias("_row"), "text").withColumn("_file", F.struct(*(F.xxhash64(F.lit(k), F.to_json("_row"), F.coalesce("text", F.lit(""))).alias(f"h{k}") for k in (1, 2))))
    with scope() as kept:
        found = written(headers(keyed, templates, threshold, window=window), "headers")
        counts = found.groupBy("_file").agg(F.count_if("own").alias("n_headers"), F.count_if(F.col("own") & (F.col("first") == F.col("last"))).alias("_single"), F.bool_or(F.col("kind") == 1).alias("_whole"))
        # a row for each license that a file names
        named = strongest(found).groupBy("_file").agg(F.collect_list(F.struct((-F.col("kind")).alias("k"), (-F.col("words")).alias("w"), (-F.col("cosine")).alias("c"), "license")).alias("_all"))
        settled = F.filter("_all", lambda g: ~F.exists("_all", lambda x: F.startswith(x["license"], F.concat(g["license"], F.lit("-")))))
        named = named.select("_file", F.array_sort(settled).alias("_named"))
        named = named.select("_file", F.col("_named")[0].alias("_m"), F.array_sort(F.transform("_named", lambda x: x["license"])).alias("licenses"))
        best = written(counts.join(named, "_file"), "best")
        lines = F.coalesce(F.size(F.filter(F.split("text", "\n"), lambda s: s.rlike(r"[\p{L}\p{N}]"))), F.lit(0))
        rows = keyed.select("_row", F.col("_row.path").alias("path"), "_file", lines.alias("_lines"))
        rows = written(rows.join(best.hint("merge"), "_file", "left"), "files")
        name = F.regexp_extract("path", "[^/]*$", 0)
        is_license = F.col("_m").isNotNull() & (name.rlike(LICENSE_FILE) | (F.col("_single") == F.col("_lines")) | F.col("_whole"))
        dirs = rows.filter(is_license & F.col("path").isNotNull()).groupBy(directory(F.col("path")).alias("_dir")).agg(F.min(F.struct("path", F.col("_m.license").alias("license"))).alias("_d"))
        dirs = small(written(dirs.select("_dir", F.col("_d.license").alias("_license")), "dirs"))
        # each directory asks once, however many files it holds
        asking = written(rows.select(directory(F.col("path")).alias("_from")).filter("_from is not null").distinct(), "asking")
        steps = asking.select("_from", F.explode(ancestors(F.concat("_from", F.lit("/")))).alias("_a")).select("_from", "_a.depth", "_a.dir")
        nearest = steps.join(dirs, steps["dir"] == dirs["_dir"]).groupBy("_from").agg(F.max(F.struct("depth", "dir", "_license")).alias("_n"))
        nearest = written(nearest.select("_from", F.col("_n.dir").alias("_license_dir"), F.col("_n._license").alias("_inherited")), "nearest")
        kept += [rows, nearest]
    out = rows.join(small(nearest), directory(rows["path"]) == nearest["_from"], "left")
    has = F.col("_m").isNotNull()
    return out.select(
        *(F.col(f"_row.`{c}`") for c in files.columns if c not in RESULT and c != "text"),
        F.when(has, F.col("_m.license")).otherwise(F.col("_inherited")).alias("license"),
        F.when(has, -F.col("_m.c")).alias("cosine"),
        F.when(has, "header").when(F.col("_inherited").isNotNull(), "inherited").alias("origin"),
        F.coalesce("n_headers", F.lit(0)).alias("n_headers"),
        F.coalesce("licenses", F.array().cast("array<string>")).alias("licenses"),
        F.when(~has, F.col("_license_dir")).alias("license_dir"),
    )


SQL = rf"""
WITH tpl(template, license, text) AS (VALUES {", ".join(f"({i}, '{n}', '{t}')" for i, (n, t) in enumerate(TEMPLATES))}),
tw AS (SELECT template, license, unnest(list_distinct(regexp_extract_all(lower(text), '{WORD}'))) AS word FROM tpl),
voc AS (SELECT list(DISTINCT word) AS v FROM tw),
ls AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents),
lw AS (SELECT doc_id, line_no, list_distinct(regexp_extract_all(lower(l), '{WORD}')) AS w FROM ls),
kn AS (SELECT doc_id, line_no, len(w) AS n, list_intersect(w, v) AS k FROM lw, voc WHERE len(w) > 0),
tot AS (SELECT count(*) AS total FROM kn),
df AS (SELECT word, count(*) AS df FROM (SELECT unnest(k) AS word FROM kn) GROUP BY word),
fo AS (SELECT ln((1.0 + total) / 2.0) + 1.0 AS f, total FROM tot),
wd AS (SELECT template, license, word, least(ln((1.0 + total) / (1.0 + coalesce(df, 0))) + 1.0, f) AS w FROM tw LEFT JOIN df USING (word), fo),
tn AS (SELECT *, sqrt(sum(w * w) OVER (PARTITION BY template)) AS tnorm, count(*) OVER (PARTITION BY template) AS tn FROM wd),
nr AS (SELECT doc_id, line_no, n, unnest(k) AS word FROM kn WHERE len(k) >= {THRESHOLD} * {THRESHOLD} * n),
sz AS (SELECT doc_id, line_no, sqrt(sum(w * w) + (max(n) - count(*)) * max(f) * max(f)) AS norm FROM nr JOIN (SELECT DISTINCT word, w FROM wd) USING (word), fo GROUP BY ALL),
sc AS (SELECT nr.doc_id, nr.line_no, license, max(tn) AS tn, count(*) AS words, split_part(license, '-', 1) AS stem, round(sum(w * w) / (max(norm) * max(tnorm)), 9) AS cosine FROM nr JOIN tn USING (word) JOIN sz ON sz.doc_id = nr.doc_id AND sz.line_no = nr.line_no GROUP BY nr.doc_id, nr.line_no, template, license),
sb AS (SELECT doc_id, line_no, arg_min(struct_pack(license, cosine, words, tn, stem), row(-cosine, license)) AS t FROM sc WHERE cosine >= {THRESHOLD} GROUP BY doc_id, line_no),
h AS (SELECT doc_id, line_no, CASE WHEN count(DISTINCT sc.license) > 1 THEN max(t.stem) ELSE max(t.license) END AS license, max(t.cosine) AS cosine, max(t.words) AS words
 FROM sb JOIN sc USING (doc_id, line_no) WHERE sc.cosine >= {THRESHOLD} AND sc.stem = t.stem AND sc.words = t.words AND sc.tn = t.tn GROUP BY doc_id, line_no),
nh AS (SELECT doc_id, count(*) AS n_headers FROM h GROUP BY doc_id),
hs AS (SELECT * FROM h WHERE NOT EXISTS (SELECT 1 FROM h o WHERE o.doc_id = h.doc_id AND starts_with(o.license, h.license || '-'))),
b AS (SELECT doc_id, arg_min(license, row(-words, -cosine, license)) AS license, arg_min(cosine, row(-words, -cosine, license)) AS cosine, max(n_headers) AS n_headers, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses FROM hs JOIN nh USING (doc_id) GROUP BY doc_id),
full_text AS (SELECT doc_id, count(*) FILTER (regexp_matches(l, '[\p{{L}}\p{{N}}]')) AS n FROM ls GROUP BY doc_id),
f AS (SELECT d.doc_id, CASE d.doc_id % 3 WHEN 0 THEN concat_ws('/', source) WHEN 1 THEN concat_ws('/', source, lang) ELSE concat_ws('/', source, lang, 'k' || d.doc_id % 5) END AS dir, CASE WHEN d.doc_id % 4 = 1 THEN 'LICENSE-' ELSE '' END || d.doc_id || '.txt' AS name,
 b.*, b.license IS NOT NULL AND (d.doc_id % 4 = 1 OR b.n_headers = full_text.n) AS is_file
 FROM documents d LEFT JOIN b ON b.doc_id = d.doc_id LEFT JOIN full_text ON full_text.doc_id = d.doc_id),
dl AS (SELECT dir, arg_min(license, CASE WHEN dir = '' THEN '' ELSE dir || '/' END || name) AS license FROM f WHERE is_file GROUP BY dir),
an AS (SELECT dir, depth, array_to_string(parts[1:depth], '/') AS up FROM (SELECT dir, parts, unnest(range(0, len(parts) + 1)) AS depth FROM (SELECT DISTINCT dir, string_split(dir, '/') AS parts FROM f))),
ne AS (SELECT an.dir, arg_max(dl.license, depth) AS license, arg_max(dl.dir, depth) AS license_dir FROM an JOIN dl ON dl.dir = an.up GROUP BY an.dir)
SELECT f.doc_id, coalesce(f.license, ne.license) AS license, round(f.cosine, 6) AS cosine, CASE WHEN f.license IS NOT NULL THEN 'header' WHEN ne.license IS NOT NULL THEN 'inherited' END AS origin,
 coalesce(f.n_headers, 0)::BIGINT AS n_headers, coalesce(f.licenses, '') AS licenses, CASE WHEN f.license IS NULL THEN ne.license_dir END AS license_dir
FROM f LEFT JOIN ne USING (dir)
"""
