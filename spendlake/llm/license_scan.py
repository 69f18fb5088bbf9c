"""License scans by sparse TF-IDF cosine and directory inheritance (operator 8), in DataFrame functions only.

Each line of a file, windows of words that begin at its lines, and the whole text of a licence file are
compared with licence templates by cosine of TF-IDF vectors. Only lines with an anchor word are scored:
the anchors of a template are its heaviest words, as many as it takes until the rest of its vector is
shorter than the threshold, so by Cauchy-Schwarz a line without any of them cannot reach it. A window is
as long as the template that it is for, whatever lines it is wrapped over, and begins at a line with an
anchor word or at the line before one; those whose words cannot reach the threshold by the same bound are
left out. A file without a licence of its own inherits that of the nearest ancestor directory that has a
licence file, by joins on the directories' paths.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise

# SPDX ids and the wording of common public licence titles, headers and notices.
TEMPLATES = [
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
#: A tag with a licence expression, taken as it stands.
SPDX = r"SPDX-License-Identifier:[ \t]*(\(?[A-Za-z0-9][A-Za-z0-9.+-]*\)?(?: (?:AND|OR|WITH) \(?[A-Za-z0-9][A-Za-z0-9.+-]*\)?)*)"
SPLIT = r"[^\p{L}\p{N}]+"
#: Directories and licence verdicts are joined under this many keys each, so that no path fills one task.
SALTS = 32


def words_of(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.array_remove(F.split(F.lower(text), SPLIT), "")


def template_words(templates: list[tuple[str, str]]) -> list[Counter]:
    return [Counter("".join(c if c.isalnum() else " " for c in t.lower()).split()) for _, t in templates]


def inverse_frequencies(files: DataFrame, vocabulary: list[str]) -> tuple[dict[str, float], float]:
    """idf of each template word over all files, and that of a word that no file has.

    idf = ln((1 + files) / (1 + files with the word)) + 1. The driver gets one count per template word.
    """
    listed = F.array(*[F.lit(w) for w in vocabulary])
    seen = files.select(F.explode(F.array_intersect(words_of(F.col("content")), listed)).alias("w"))
    df = {r["w"]: r["count"] for r in seen.groupBy("w").count().collect()}
    n = files.count()
    idf = lambda k: math.log((1 + n) / (1 + k)) + 1
    return {w: idf(df.get(w, 0)) for w in vocabulary}, idf(0)


def anchors(vectors: list[dict[str, float]], threshold: float) -> list[str]:
    """Words of which any line that reaches ``threshold`` with any template has at least one."""
    out = set()
    for v in vectors:
        rest = sum(x * x for x in v.values())
        least = threshold * threshold * rest * (1 - 1e-9)
        for w, x in sorted(v.items(), key=lambda p: (-p[1], p[0])):
            if rest < least:
                break
            out.add(w)
            rest -= x * x
    return sorted(out)


def windows(lines: Column, cued: Column, counts: list[Counter], vectors: list[dict[str, float]], threshold: float) -> Column:
    """Texts of the windows that may reach ``threshold``: of each template as many words as it has, from each
    line that is ``cued`` or comes before such a line; fewer where the file ends. Every line has a word.

    A window's cosine with a template is at most the share of the template's length that lies on words
    which the window has.
    """
    longest = max(c.total() for c in counts)
    forms = []
    for c, v in zip(counts, vectors, strict=True):
        whole = sum(x * x for x in v.values())
        shares = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(x * x / whole).alias("x")) for w, x in sorted(v.items())])
        forms.append(F.struct(F.lit(c.total()).alias("n"), F.array(*map(F.lit, anchors([v], threshold))).alias("cues"), shares.alias("shares")))
    table = F.array(*forms)

    def ahead(i: Column) -> Column:
        # a line has a word at least, so that many lines are enough
        text = F.slice(lines, i, F.lit(longest))
        grown = F.aggregate(text, F.array().cast("array<string>"), lambda acc, x: F.when(F.size(acc) >= longest, acc).otherwise(F.concat(acc, words_of(x))))
        return grown

    def fitting(words: Column) -> Column:
        def may(t: Column) -> Column:
            def reaches(w: Column) -> Column:
                share = F.aggregate(t["shares"], F.lit(0.0), lambda acc, e: acc + F.when(F.array_contains(w, e["w"]), e["x"]).otherwise(0.0))
                return F.arrays_overlap(w, t["cues"]) & (share >= threshold * threshold * (1 - 1e-9))

            # a list of one binds the window to a name, so that it is cut once and not at each word
            return F.exists(F.array(F.slice(words, F.lit(1), t["n"])), reaches)

        return F.transform(F.filter(table, may), lambda t: F.array_join(F.slice(words, F.lit(1), t["n"]), " "))

    numbers = F.sequence(F.lit(1), F.size(lines))
    begins = F.filter(numbers, lambda i: F.get(cued, i - 1) | F.coalesce(F.get(cued, i), F.lit(False)))
    return F.when(F.size(lines) > 0, F.array_distinct(F.flatten(F.transform(F.transform(begins, ahead), fitting)))).otherwise(F.array().cast("array<string>"))


def alternatives(words: list[str]) -> str:
    """A pattern of any of ``words``, in which common beginnings are tried once."""
    if words in ([], [""]):
        return ""
    by: dict[str, list[str]] = {}
    for w in words:
        by.setdefault(w[:1], []).append(w[1:])
    return "(?:" + "|".join(c + alternatives(rest) for c, rest in sorted(by.items(), reverse=True)) + ")"


def nearest_license(files: DataFrame) -> DataFrame:
    """``(dir, license, from_dir)`` of every directory that has a licence file in it or above it.

    ``files`` has dir, license, score and is_license_file. Directories are reduced to distinct ones
    before their ancestors are listed, so a directory's files cost nothing here.
    """
    own = files.where("is_license_file and license is not null and dir is not null").groupBy("dir").agg(
        F.max(F.struct("score", "license")).alias("s")
    )
    own = own.select(F.col("dir").alias("from_dir"), F.col("s.license").alias("license"))
    own = own.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    steps = F.split("dir", "/")
    up = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda i: F.array_join(F.slice(steps, 1, i), "/"))
    dirs = files.select("dir").where("dir is not null").distinct().withColumn("salt", F.pmod(F.xxhash64("dir"), F.lit(SALTS)).cast("int"))
    above = dirs.select("dir", "salt", F.explode(F.array_distinct(up)).alias("from_dir"))
    found = above.join(own, ["from_dir", "salt"])
    depth = F.when(F.col("from_dir") == "", 0).otherwise(F.size(F.split("from_dir", "/")))
    return found.groupBy("dir").agg(F.max(F.struct(depth.alias("d"), "from_dir", "license")).alias("s")).select("dir", "s.license", "s.from_dir")


def scan(
    files: DataFrame,
    id_col: str = "doc_id",
    path_col: str = "path",
    text_col: str = "text",
    threshold: float = 0.75,
    file_names: str = r"(?i)(^|/)(licen[sc]e|copying|unlicense)(\.[a-z]+)?$",
    templates: list[tuple[str, str]] = TEMPLATES,
) -> DataFrame:
    """``(id_col, license, score, scope, from_dir)``, one row per row of ``files``.

    ``scope`` is ``own`` (a line of the file, a window of words over its lines, or the whole text of a
    licence file reaches ``threshold``), ``inherited`` or ``none``; the best template wins, of equals the
    first id in alphabetical order. ``score`` is the cosine, null unless own. A vector has a word's count
    times its idf; a word outside all templates weighs as one that no file has. The first
    ``SPDX-License-Identifier`` of a file goes before all templates, with its expression as it stands and
    score 1.

    Null or empty texts have no licence of their own, a file with a null path inherits nothing, the
    directory of a path without ``/`` is the root ``''``. Repeated rows are scanned as often as they
    stand there. Empty tables give no rows; other columns are not read.
    """
    spark = files.sparkSession
    path = F.col(path_col)
    src = files.select(
        F.col(id_col).alias("id"),
        F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).when(path.isNotNull(), F.lit("")).alias("dir"),
        F.coalesce(path.rlike(file_names), F.lit(False)).alias("is_license_file"),
        F.coalesce(F.col(text_col), F.lit("")).alias("content"),
    )
    counts = template_words(templates)
    vocabulary = sorted(set().union(*counts))
    idf, unseen = inverse_frequencies(src, vocabulary)
    vectors = [{w: n * idf[w] for w, n in c.items()} for c in counts]
    cue = "|".join(anchors(vectors, threshold))
    cue = rf"(?:^|[^\p{{L}}\p{{N}}]){alternatives(anchors(vectors, threshold))}(?:$|[^\p{{L}}\p{{N}}])"
    none = F.array().cast("array<string>")
    src = src.withColumn("tag", F.nullif(F.regexp_extract("content", SPDX, 1), F.lit("")))
    src = src.withColumn("split", F.transform(F.split(F.lower("content"), "\n"), lambda x: F.struct(x.alias("x"), x.rlike(cue).alias("c"))))
    # of files without an anchor word no line is looked at again
    worded = F.filter("split", lambda p: p["c"] | p["x"].rlike(r"[\p{L}\p{N}]"))
    src = src.withColumn("worded", F.when(F.exists("split", lambda p: p["c"]), worded).otherwise(F.slice("split", 1, 0)))
    src = src.withColumn("lines", F.col("worded.x")).withColumn("cued", F.col("worded.c"))
    single = F.filter("lines", lambda x, i: F.get("cued", i))
    whole = F.when(F.col("is_license_file"), F.array("content")).otherwise(none)
    units = F.concat(single, windows(F.col("lines"), F.col("cued"), counts, vectors, threshold), whole)
    lines = src.select("id", "dir", "is_license_file", "tag", F.array_distinct(units).alias("units"))
    lines = materialise(lines.withColumn("row", F.monotonically_increasing_id()), "license-lines")
    best = _best(spark, lines, templates, vectors, idf, unseen, threshold)
    own = lines.drop("units").join(best, "row", "left")
    tagged = F.col("tag").isNotNull()
    own = own.withColumns({"license": F.coalesce("tag", "license"), "score": F.when(tagged, 1.0).otherwise(F.col("score"))}).drop("tag")
    own = materialise(own, "licenses")
    above = nearest_license(own).select("dir", F.col("license").alias("up"), "from_dir")
    above = above.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = own.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int")).join(above, ["dir", "salt"], "left")
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("license", "up").alias("license"),
        "score",
        F.when(F.col("license").isNotNull(), "own").when(F.col("up").isNotNull(), "inherited").otherwise("none").alias("scope"),
        F.when(F.col("license").isNull(), F.col("from_dir")).alias("from_dir"),
    )


def _best(spark: SparkSession, lines: DataFrame, templates, vectors, idf, unseen: float, threshold: float) -> DataFrame:
    """``(row, license, score)`` of the rows in which a unit reaches the threshold."""
    norms = [math.sqrt(sum(x * x for x in v.values())) for v in vectors]
    weights = [(w, k, x / n) for k, (v, n) in enumerate(zip(vectors, norms, strict=True)) for w, x in v.items()]
    # the templates' weights, a constant of the call; in the plan as literals
    quoted = ", ".join(f"named_struct('w', '{w}', 'k', {k}, 'x', {x!r}D)" for w, k, x in weights)
    table = F.broadcast(spark.range(1).select(F.explode(F.expr(f"array({quoted})")).alias("t")).select("t.*"))
    scale = F.broadcast(spark.range(1).select(F.explode(F.expr("array(" + ", ".join(f"named_struct('w', '{w}', 'idf', {x!r}D)" for w, x in idf.items()) + ")")).alias("t")).select("t.*"))
    names = F.array(*[F.lit(t) for t, _ in templates])
    unit = lines.select("row", F.posexplode("units").alias("u", "unit"))
    words = unit.select("row", "u", F.explode(words_of(F.col("unit"))).alias("w")).groupBy("row", "u", "w").count()
    words = words.join(scale, "w", "left").withColumn("y", F.col("count") * F.coalesce("idf", F.lit(unseen)))
    norm = words.groupBy("row", "u").agg(F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("norm"))
    dots = words.join(table, "w").groupBy("row", "u", "k").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    cos = dots.join(norm, ["row", "u"]).select("row", F.get(names, F.col("k")).alias("license"), F.round(F.col("dot") / F.col("norm"), 9).alias("score"))
    top = cos.where(F.col("score") >= threshold).groupBy("row").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b"))
    return top.select("row", "b.license", (-F.col("b.s")).alias("score"))
