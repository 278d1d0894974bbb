"""Licence scan: sparse TF-IDF cosine of headers and licence files to templates, then inheritance by directory.

A document that holds a licence word is compared with the templates in parts: as a whole, and its leading comment block,
with the full licence texts (licence_texts; a cosine of WHOLE) and with the short forms; each run of lines that hold a
licence word, and each such line, with the short forms. Terms `[a-z0-9]+(\\.[0-9]+)*` (A-Z lower-cased) are weighed by
tf * idf with idf = 1 - ln(df / N + RARE), where N and df count all documents, for every term of a part or a template: a
score depends on the shares of the terms, not on the size of the corpus. The template (one of several forms of a
licence) with the best cosine of at least `least` is the file's own licence; what a full text says goes before an SPDX
tag, and that before what lines say (the GPL names other licences). A file without one takes that of the licence file in
its nearest ancestor directory. A licence file is one that as a whole is like a template, of any length, or one named
like LICENSE or COPYING that has a licence of its own.

All steps are DataFrame functions. Edge cases: null or empty text has no licence of its own, nor has a null doc_id; ties
go to the template first by name; several licence files in a directory: the highest cosine, then the lowest id; null path
inherits nothing; repeated rows are judged row by row as one file; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from importlib import resources

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

TEMPLATES = {
    "agpl-3.0": "Licensed under the GNU Affero General Public License, version 3",
    "all-rights-reserved": "Copyright. All rights reserved",
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 3-Clause License",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License",
    "cc0-1.0": "Released into the public domain under the CC0 1.0 Universal dedication",
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "lgpl-3.0": "This work is licensed under the GNU Lesser General Public License, version 3",
    "mit": "Released under the MIT License",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0",
}
CREATIVE = {"by": "Attribution", "by-sa": "Attribution-ShareAlike", "by-nc": "Attribution-NonCommercial", "by-nd": "Attribution-NoDerivatives", "by-nc-sa": "Attribution-NonCommercial-ShareAlike", "by-nc-nd": "Attribution-NonCommercial-NoDerivatives"}
#: Other forms that headers have.
FORMS = [
    ("all-rights-reserved", "All rights reserved"), ("mit", "MIT License"), ("mit", "The MIT License (MIT)"),
    ("apache-2.0", "Apache License 2.0"), ("apache-2.0", "Apache License Version 2.0, January 2004"), ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License)"),
    ("bsd-2-clause", "BSD 2-Clause License"), ("bsd-3-clause", "BSD 3-Clause License"),
    ("mpl-2.0", "Mozilla Public License Version 2.0"), ("mpl-2.0", "Licensed under the Mozilla Public License 2.0"), ("cc0-1.0", "CC0 1.0 Universal public domain dedication"), ("cc0-1.0", "Licensed under CC0 1.0"),
    *[(f"{short}-{v if '.' in v else v + '.0'}", f"{form} {name} General Public License, version {v}") for short, name, versions in (("gpl", "GNU", "123"), ("lgpl", "GNU Lesser", ("2.1", "3")), ("agpl", "GNU Affero", "3")) for v in versions for form in ("", "Licensed under the", "under the terms of the")],
    *[(f"{short}-{v if '.' in v else v + '.0'}", f"This {work} is free software: you can redistribute it and/or modify it under the terms of the {name} General Public License as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version") for short, name, versions, work in (("gpl", "GNU", "23", "program"), ("lgpl", "GNU Lesser", ("2.1", "3"), "library"), ("agpl", "GNU Affero", "3", "program")) for v in versions],
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License) you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 distributed under the License is distributed on an AS IS BASIS See the License for the specific language governing permissions and limitations under the License."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"), ("bsd-3-clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file"),
    *[(f"cc-{short}-4.0", form) for short, name in CREATIVE.items() for form in (f"Licensed under CC {short} 4.0", f"This work is licensed under a Creative Commons {name} 4.0 International License", f"Creative Commons {name} 4.0 International Public License")],
]
LICENCE_WORDS = r"(?i)licen[sc]e|copyright|rights reserved|public domain|redistribut"
TERM = r"[a-z0-9]+(?:\.[0-9]+)*"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST, RARE, WHOLE = 0.6, 1e-4, 0.9
RUN = r"(?m)(?:^[^\n]*(?i:licen[sc]e|copyright|rights reserved|public domain|redistribut)[^\n]*(?:\n|$))"  # lines in a row that hold a licence word, with + after it
HEAD = r"^(?:[ \t]*(?:#|//|/?\*|;|--|<!--|%)[^\n]*(?:\n|$)|[ \t]*\n)"  # the leading comment, with + after it
SPDX = r"SPDX-License-Identifier:[ \t]*([A-Za-z0-9.-]+?)(?:-only|-or-later|\+)?(?:[^A-Za-z0-9.+-]|$)"
NAME = r"(?i)(?:^|/)(?:un)?(?:licen[sc]e|copying)(?:[-_.](?:txt|md|rst|html?|mit|apache|bsd|isc|[al]?gpl|lesser|mpl|cc0?|by|nc|nd|sa|v?[0-9]+))*$"


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(TERM), F.lit(0))


def counts(text: str) -> list[tuple[str, int]]:
    return sorted(Counter(re.findall(TERM, text.translate(str.maketrans(UPPER, LOWER)))).items())


def templates() -> list[tuple[str, str, bool]]:
    """(licence, text, whether it is the full text) of all templates."""
    full = sorted((f for f in resources.files(__package__).joinpath("licence_texts").iterdir() if f.name.endswith(".txt")), key=lambda f: f.name)
    return [(name, text, False) for name, text in [*TEMPLATES.items(), *FORMS]] + [(f.name.removesuffix(".txt"), f.read_text("utf-8"), True) for f in full]


def term_weights(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(term, idf) of the wanted terms, from their share of all documents."""
    n = max(docs.count(), 1)
    df = docs.select(F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return wanted.join(df, "term", "left").select("term", (1 - F.log(F.coalesce("df", F.lit(0)) / F.lit(n) + F.lit(RARE))).alias("idf"))


def weighed_templates(weights: DataFrame, rows: list[tuple[int, str, bool, str, int]]) -> DataFrame:
    """(form, licence, full, term, weight) of all templates, each of length 1."""
    spark = weights.sparkSession
    vocabulary = spark.createDataFrame([(t,) for t in sorted({r[3] for r in rows})], "term string")
    idf = {r["term"]: r["idf"] for r in weights.join(F.broadcast(vocabulary), "term").collect()}
    norms = Counter()
    for i, _, _, term, n in rows:
        norms[i] += (n * idf[term]) ** 2
    return spark.createDataFrame([(i, licence, full, term, n * idf[term] / math.sqrt(norms[i])) for i, licence, full, term, n in rows], "form int, licence string, full boolean, term string, weight double")


def own_licences(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """(doc_id, licence, cosine, whole) of the documents that as a whole, or in a header, are like a template."""
    forms = [(i, licence, full, term, n) for i, (licence, text, full) in enumerate(templates()) for term, n in counts(text)]
    text = F.col("text")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(LICENCE_WORDS))
    headers = F.array_distinct(F.concat(F.regexp_extract_all(text, F.lit(RUN + "++"), F.lit(0)), lines))
    files = docs.where(text.rlike(LICENCE_WORDS)).select("doc_id", F.xxhash64("text").alias("text_id"), "text")
    parts = files.select("doc_id", "text_id", F.posexplode(F.concat(F.array(text, F.regexp_extract(text, HEAD + "++", 0)), headers)).alias("part", "body"))  # part 0 is the whole, part 1 the leading comment
    key = ["doc_id", "text_id", "part"]
    counted = stored(parts.select(*key, F.explode(terms(F.col("body"))).alias("term")).groupBy(*key, "term").agg(F.count("*").alias("tf")), "licence-terms")
    of_templates = docs.sparkSession.createDataFrame([(t,) for t in sorted({f[3] for f in forms})], "term string")
    weights = stored(term_weights(docs, counted.select("term").union(of_templates).distinct()), "licence-weights")
    weighed = counted.join(weights, "term").withColumn("w", F.col("tf") * F.col("idf"))
    norm = weighed.groupBy(*key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    of_forms = F.broadcast(weighed_templates(weights, forms))
    dot = weighed.join(of_forms, "term").where("part < 2 or not full").groupBy(*key, "form", "licence", "full").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    cosine = dot.join(norm, key).withColumn("cosine", F.round(F.col("dot") / F.col("norm"), 6)).where((F.col("cosine") >= least) & (~F.col("full") | (F.col("cosine") >= WHOLE)))
    like = cosine.select("doc_id", "licence", "cosine", F.when(F.col("full"), 0).otherwise(2).alias("rank"), (F.col("part") == 0).alias("whole"))
    tagged = F.translate(F.regexp_extract(text, SPDX, 1), UPPER, LOWER)
    tags = docs.where(text.contains("SPDX-License-Identifier:")).select("doc_id", tagged.alias("licence"), F.lit(1.0).alias("cosine"), F.lit(1).alias("rank"), F.lit(False).alias("whole")).where("licence <> ''")
    best = F.min_by(F.struct("licence", "cosine"), F.struct("rank", -F.col("cosine"), "licence"))
    return like.unionByName(tags).where("doc_id is not null").groupBy("doc_id").agg(best.alias("best"), F.max("whole").alias("whole")).select("doc_id", "best.*", "whole")


def scan_licences(files: DataFrame, least: float = LEAST) -> DataFrame:
    """(doc_id, path, licence, cosine, found) of every row of files (doc_id, path, text); found is own, inherited or none."""
    rows = files.select(F.col("doc_id").cast("long"), F.col("path").cast("string"), F.col("text").cast("string"))
    own = own_licences(rows, least)
    directory = F.regexp_replace("path", "/?[^/]*$", "")
    placed = rows.select("doc_id", "path", directory.alias("directory"))
    with_own = placed.join(own, "doc_id", "left")
    of_directory = (
        with_own.where((F.col("whole") | F.col("path").rlike(NAME) & F.col("licence").isNotNull()) & F.col("directory").isNotNull())
        .groupBy(F.col("directory").alias("ancestor")).agg(F.min_by(F.struct("licence", "cosine"), F.struct(-F.col("cosine"), "doc_id")).alias("given"))
    )
    parts = F.split("directory", "/")
    ancestors = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, 1, i), "/").alias("ancestor")))
    inherited = (
        placed.select("directory").where("directory is not null").distinct().select("directory", F.explode(ancestors).alias("a")).select("directory", "a.*")
        .join(of_directory, "ancestor").groupBy("directory").agg(F.max_by("given", "depth").alias("given"))
    )
    return with_own.join(inherited, "directory", "left").select(
        "doc_id", "path", F.coalesce("licence", "given.licence").alias("licence"), F.coalesce("cosine", "given.cosine").alias("cosine"),
        F.when(F.col("licence").isNotNull(), "own").when(F.col("given").isNotNull(), "inherited").otherwise("none").alias("found"),
    )
