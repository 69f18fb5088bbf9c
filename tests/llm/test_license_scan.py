"""License scan against a brute-force cosine of every line with every template, and path walks."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spendlake.llm import license_scan as ls
from spendlake.llm.queries import op8_license_scan

NAME = re.compile(r"(?i)(^|/)(licen[sc]e|copying|unlicense)(\.[a-z]+)?$")


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def brute(rows, threshold=0.75):
    """(id, license, score, scope, from_dir) of (id, path, text) rows."""
    temp = [(name, Counter(words(t))) for name, t in ls.TEMPLATES]
    vocab = set().union(*(c for _, c in temp))
    df = Counter(w for _, _, t in rows for w in set(words(t)) & vocab)
    idf = lambda w: math.log((1 + len(rows)) / (1 + (df[w] if w in vocab else 0))) + 1
    vec = lambda c: {w: n * idf(w) for w, n in c.items()}
    size = lambda v: math.sqrt(sum(x * x for x in v.values()))
    lengths = sorted({c.total() for _, c in temp})
    temp = [(name, vec(c)) for name, c in temp]
    cues = set(ls.anchors([u for _, u in temp], threshold))
    own = []
    for _, path, t in rows:
        tag = re.search(ls.SPDX, t or "")
        if tag:
            own.append((tag[1], 1.0))
            continue
        lines = [w for w in map(words, (t or "").split("\n")) if w]
        units = lines + ([words(t)] if NAME.search(path or "") else [])
        for i, line in enumerate(lines):
            if cues & {*line, *(lines[i + 1] if i + 1 < len(lines) else [])}:
                ahead = []
                for x in lines[i:]:
                    if len(ahead) >= lengths[-1]:
                        break
                    ahead += x
                units += [ahead[:n] for n in lengths]
        best = (0, None)
        for v in map(vec, map(Counter, set(map(tuple, units)))):
            for name, u in temp:
                c = round(sum(x * u.get(w, 0) for w, x in v.items()) / (size(u) * size(v)), 9) if v else 0
                if c >= threshold and (-c, name) < best:
                    best = (-c, name)
        own.append((best[1], -best[0]))
    folder = lambda p: None if p is None else p.rpartition("/")[0]
    have = {}
    for (_, path, _), (name, score) in zip(rows, own, strict=True):
        if name and NAME.search(path or ""):
            have[folder(path)] = max(have.get(folder(path), (0, "")), (score, name))
    out = []
    for (i, path, _), (name, score) in zip(rows, own, strict=True):
        if name:
            out.append((i, name, score, "own", None))
            continue
        at = folder(path)
        while at is not None and at not in have:
            at = folder(at) if at else None
        out.append((i, have[at][1], None, "inherited", at) if at is not None else (i, None, None, "none", None))
    return out


def same(got, want):
    key = lambda r: str((r[0], r[1], r[3], r[4]))
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [key(r) for r in got] == [key(r) for r in want]
    assert all(a[2] == b[2] or abs(a[2] - b[2]) < 1e-6 for a, b in zip(got, want, strict=True))


def test_files_headers_and_inheritance(spark):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    rows = [
        (0, "LICENSE", mit), (1, "a/x.txt", "text\n  " + apache.upper() + "  \nmore"), (2, "a/y.txt", "the license of the version"), (3, "a/b/LICENSE.md", "licensed under\nCC BY-SA 4.0"),
        (4, "a/b/c/z.txt", None), (5, "ab/q.txt", ""), (6, None, "nothing here"), (7, None, mit), (8, "a/b/COPYING", apache), (None, "k/LICENSE", "é " * 30_000 + mit),
        (9, "k/LICENSE", "\n".join(["This work is licensed under the", "GNU General Public License, version 2."])), (10, "k/d//e.txt", "x"), (4, "a/b/c/z.txt", None),
        (11, "top.txt", "mit"), (12, "w/LICENSE", "a license of another kind, which no template has"), (13, "w/f", " ".join(["word"] * 50_000)),
    ]
    files = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, path string, text string, license string, row int")
    same(ls.scan(files).collect(), brute(rows))
    assert ls.scan(files.limit(0)).collect() == []


def test_wrapped_headers_titles_and_tags(spark):
    texts = {
        "BSD-3-Clause": "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions are\n# met:",
        "GPL-2.0": "/* This program is free software; you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation; either version 2 of the License, or\n * (at your option) any later version. */\nint x;",
        "LGPL-2.1": " This library is free software; you can redistribute it and/or\n modify it under the terms of the GNU Lesser General Public\n License as published by the Free Software Foundation; either\n version 2.1 of the License, or (at your option) any later version.",
        "GPL-3.0": "   GNU GENERAL PUBLIC LICENSE\n      Version 3, 29 June 2007\n\n Copyright (C) of the text",
        "Apache-2.0": "   Apache License\n   Version 2.0, January 2004\n   TERMS AND CONDITIONS",
        "MIT": "MIT License\n\nCopyright (c) 2020 Somebody\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction",
        "MIT OR Apache-2.0": "// SPDX-License-Identifier: MIT OR Apache-2.0\nx",
        "Zlib": "/* SPDX-License-Identifier: Zlib */",
    }
    rows = [(i, f"d{i}/x.c", t) for i, t in enumerate(texts.values())] + [(90, "d0/y.c", "\n" * 5_000 + "version of the text\nlicense"), (91, "d/z", "gnu " * 9_000)]
    got = ls.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()
    assert {r.doc_id: r.license for r in got} == dict(enumerate(texts)) | {90: None, 91: None}
    same(got, brute(rows))


def test_no_line_without_an_anchor_can_reach_the_threshold():
    counts = ls.template_words(ls.TEMPLATES)
    vectors = [{w: float(n + len(w)) for w, n in c.items()} for c in counts]
    cue = set(ls.anchors(vectors, 0.75))
    for v in vectors:
        rest = math.sqrt(sum(x * x for w, x in v.items() if w not in cue))
        assert rest < 0.75 * math.sqrt(sum(x * x for x in v.values()))


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "text").collect()

    def path(d):
        up = [d.source, str(d.doc_id // 400)] + ([str(d.doc_id // 20)] if d.doc_id % 400 else [])
        return "/".join([*up, "LICENSE" if d.doc_id % 20 == 0 else f"{d.doc_id}.txt"])

    got = op8_license_scan(spark, sf)
    assert "Python" not in got._jdf.queryExecution().toString()
    same(got.collect(), brute([(d.doc_id, path(d), d.text) for d in docs]))
    assert got.where(F.col("scope") == "own").count() > 0
