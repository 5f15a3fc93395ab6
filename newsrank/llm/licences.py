"""Licences of files: sparse TF-IDF cosine of headers to templates, then inheritance from the nearest ancestor folder.

1. Every line, and every sentence of a line, that names a licence, a copyright or an SPDX tag is a header; so is
   the whole text of a licence file. Headers are folded to distinct normalised texts first, so a line that a third of all
   files share is scored once.
2. Headers and templates are sparse vectors of word counts times idf, where document frequencies are counted over all
   headers and templates. They meet on their words: a header takes at most one row for each word of a template, and
   templates are a small fixed table. The best template with cosine >= ``least`` names the header, of those that agree with it: a negated
   header has no licence, and versions and the words that tell siblings (lesser, affero, ShareAlike ...) must be those of the template.
3. A file's own licence is that of its best header. It belongs to the folder too, whatever the length of the file, where the
   file is a licence file, or its best header is all it holds or speaks for the folder, project or the like; each distinct folder
   of the table meets its ancestors by a path join and takes the nearest one that has a licence; files without
   a licence of their own take that of their folder.

Ties go to the higher cosine, then the smaller licence name. Null text has no header; null path has no folder and
inherits nothing. Repeated rows are rows. Extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K

# fixed values: names and opening words of common licences
TEMPLATES = {
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3.", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License",
                 "SPDX-License-Identifier: AGPL-3.0"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "you may not use this file except in compliance with the License", "SPDX-License-Identifier: Apache-2.0"],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted", "SPDX-License-Identifier: BSD-3-Clause"],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "SPDX-License-Identifier: EPL-2.0"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2",
                "SPDX-License-Identifier: GPL-2.0"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "you can redistribute it and/or modify it under the terms of the GNU General Public License",
                "SPDX-License-Identifier: GPL-3.0"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "Released under the ISC License.", "SPDX-License-Identifier: ISC"],
    "LGPL-2.1": ["This work is licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1"],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3.", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
                 "SPDX-License-Identifier: LGPL-3.0"],
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "SPDX-License-Identifier: MIT"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
}
MENTION = r"(?i)licen[sc]e|copyright|spdx|redistribut|permission is hereby|permission to use|subject to the terms"
SPACE = r"(?:folder|directory|project|repository|package|distribution)"
FOR_ALL = rf"(?i)\b(?:in|of|under)\s+this\s+{SPACE}\b|\bthis\s+{SPACE}\s+(?:is|are|may|and)\b"
WORD = r"[a-z]+|[0-9]+(?:\.[0-9]+)*"

# words of a header that tell a licence from its siblings, by the part of the licence's name that they stand for
TELLING = {"LGPL": r"\b(?:lesser|lgpl)\b", "AGPL": r"\b(?:affero|agpl)\b", "-SA": r"\b(?:share ?alike|sa)\b", "-NC": r"\b(?:non ?commercial|nc)\b",
           "-ND": r"\b(?:no ?deriv[a-z]*|nd)\b"}
NEGATED = r"\b(?:not|never|no longer) (?:[a-z]+ ){0,2}(?:licensed|released|distributed|available|covered|subject)\b|\b(?:no|without a) licen[sc]e\b"
VERSION = r"\b(?:version|v|by|by nc|by sa|attribution|license|gpl|lgpl|agpl) ([0-9]+(?:\.[0-9]+)?)(?: |$)"


def template_table(spark: SparkSession, templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    return spark.createDataFrame([(name, i, text) for name, texts in templates.items() for i, text in enumerate(texts)], "licence string, part int, text string")


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), 0)


def _normal(text: Column) -> Column:
    return F.concat_ws(" ", _words(text))


def headers(files: DataFrame) -> DataFrame:
    """(file, header, grants) of each distinct header of a file; ``files`` has (file, text, whole)."""
    # a text without any mention is left after one search
    named = files.where(F.col("text").rlike(MENTION)).withColumn("units", F.split(F.btrim("text", F.lit(" \t\r\n")), r"\n|(?<=[.!?])\s+(?=\p{Lu})"))
    alone = F.col("whole") | (F.size("units") == 1)
    lines = F.filter("units", lambda x: x.rlike(MENTION))
    units = F.when(F.col("whole"), F.concat(F.array("text"), lines)).otherwise(lines)
    each = F.transform(units, lambda x: F.struct(_normal(x).alias("header"), (alone | x.rlike(FOR_ALL)).alias("grants")))
    return named.select("file", F.explode(F.array_distinct(each)).alias("x")).select("file", "x.*").where("header != ''")


def _agrees(header: Column, licence: Column) -> Column:
    """Whether a header is not negated, tells no sibling of the licence, and names its version where it names any."""
    told = [header.rlike(pattern) == licence.contains(name) for name, pattern in TELLING.items()]
    plain = lambda x: F.regexp_replace(x, r"\.0$", "")
    versions = F.transform(F.regexp_extract_all(header, F.lit(VERSION), 1), plain)
    own = plain(F.regexp_extract(licence, r"-([0-9]+(?:\.[0-9]+)?)$", 1))
    ok = ~header.rlike(NEGATED) & ((own == "") | (F.size(versions) == 0) | F.array_contains(versions, own))
    for x in told:
        ok &= x
    return ok


def score_headers(seen: DataFrame, templates: DataFrame, least: float) -> DataFrame:
    """(header, licence, cosine) of the distinct headers that match a template."""
    texts = templates.select("licence", "part", _normal(F.col("text")).alias("t"))
    counts = lambda df, *by, text: (df.select(*by, F.explode(F.split(text, " ")).alias("word")).groupBy(*by, "word").agg(F.count("*").alias("tf")))
    mine = K.stored(counts(seen.select("header"), "header", text="header"))
    theirs = counts(texts, "licence", "part", text="t")
    total = seen.count() + texts.count()
    df = mine.select("word").unionByName(theirs.select("word")).groupBy("word").agg((F.log(F.lit(1.0 + total) / (1 + F.count("*"))) + 1).alias("idf"))
    df = K.stored(df)
    weigh = lambda x: x.join(df, "word").withColumn("w", (1 + F.log("tf")) * F.col("idf"))
    t = K.stored(weigh(theirs))                                        # as large as the templates
    t_norm = t.groupBy("licence", "part").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("t_norm"))
    h = weigh(mine)
    h_norm = h.groupBy("header").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("h_norm"))
    common = h.select("header", "word", "w").join(F.broadcast(t.select("licence", "part", "word", F.col("w").alias("v"))), "word")
    dots = common.groupBy("header", "licence", "part").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    best = dots.join(F.broadcast(t_norm), ["licence", "part"]).groupBy("header", "licence").agg(F.max(F.col("dot") / F.col("t_norm")).alias("x"))
    best = best.join(h_norm, "header").select("header", "licence", F.round(F.col("x") / F.col("h_norm"), 9).alias("cosine")).where(F.col("cosine") >= least)
    best = best.where(_agrees(F.col("header"), F.col("licence")))
    # the smaller name of equal cosines
    top = best.groupBy("header").agg(F.max("cosine").alias("cosine"))
    return best.join(top, ["header", "cosine"]).groupBy("header", "cosine").agg(F.min("licence").alias("licence"))


def scan(files: DataFrame, templates: DataFrame | None = None, least: float = 0.6) -> DataFrame:
    """(file, path, licence, cosine, origin, folder): origin is own, inherited or none; folder is the one inherited from.

    ``files`` has (file, path, text, is_licence_file).
    """
    spark = files.sparkSession
    templates = template_table(spark) if templates is None else templates
    files = files.select("file", "path", "text", F.coalesce("is_licence_file", F.lit(False)).alias("whole"))
    found = K.stored(headers(files))
    seen = found.groupBy("header").agg(F.count("*").alias("n"))
    named = K.stored(seen.join(score_headers(seen, templates, least), "header"))
    own = K.spread_join(found, named, "header").where("licence is not null")
    own = own.groupBy("file").agg(F.min_by(F.struct("licence", "cosine", "grants"), F.struct(-F.col("cosine"), F.col("licence"), ~F.col("grants"))).alias("x")).select("file", "x.*")
    folder = F.when(F.col("path").contains("/"), F.regexp_replace("path", r"/[^/]*$", "")).when(F.col("path").isNotNull(), "")
    rows = K.stored(files.select("file", "path", folder.alias("folder")).join(own, "file", "left"))
    granted = rows.where("grants and licence is not null and folder is not null").groupBy(F.col("folder").alias("above")).agg(
        F.min_by(F.struct("licence", "cosine"), F.struct(-F.col("cosine"), F.col("licence"))).alias("grant"))
    folders = rows.where("folder is not null").groupBy("folder").agg(F.count("*").alias("n"))
    parts = F.split("folder", "/")
    ancestors = folders.select("folder", "n", F.explode(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/")))).alias("above"))
    nearest = ancestors.distinct().join(granted, "above").groupBy("folder", "n").agg(F.max_by(F.struct("grant", "above"), F.length("above")).alias("from"))
    need = rows.where("licence is null").select("file", "path", "folder")
    inherited = K.spread_join(K.stored(need), K.stored(nearest), "folder")
    mine = rows.where("licence is not null").select("file", "path", "licence", "cosine", F.lit("own").alias("origin"), F.lit(None).cast("string").alias("folder"))
    theirs = inherited.select("file", "path", F.col("from.grant.licence").alias("licence"), F.col("from.grant.cosine").alias("cosine"),
                              F.when(F.col("from").isNotNull(), "inherited").otherwise("none").alias("origin"), F.col("from.above").alias("folder"))
    return mine.unionByName(theirs)
