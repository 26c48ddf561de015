"""License scans: MinHash bands over overlapping windows, verified by exact containment.

A template of ``n`` words is looked for in windows of ``n + s`` words that begin at every
multiple of ``s = n // 4`` words, so some window holds any occurrence whole. A window and a
template whose shingles it contains to ``CONTAINMENT`` have a Jaccard similarity that follows
from both lengths; the number of bands is chosen so that their signatures meet in some band with a
probability of at least ``1 - MISS``. What meets is verified on the shingles' words.

Signatures can meet only where a shingle is shared. So, without loss, windows without
a template's shingle (by a bitmap with no false negatives) are passed over before hashing, and so are documents without any of
``STEMS`` where no template can match without one; for given templates this is worked out, and where it does not hold no document is passed over.

Everything is built-in expressions inside one scan. Each window's bands are looked up in the table of the templates' bands by a hash join on
length, band and key; the only shuffle gathers the verified matches.

Fixed results: a null or empty text matches nothing; texts shorter than a shingle match nothing; a very long text is split in
one row, and its windows are rows of their own; a null id is
grouped like a value; repeated rows add to the same matches; of equal containments the first place counts; an
empty table gives no row, nor do templates shorter than a shingle; other columns are never read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import if_small, once, slim

SHINGLE = 3
CONTAINMENT = 0.8
#: Templates of so many shingles or fewer must be contained whole.
SHORT = 5
#: Bound on the chance that a matching window's signature meets in no band.
MISS = 1e-5
ROWS = 2
_GLOBAL_BITS, _CLASS_BITS = 1 << 16, 1 << 12

#: Each of these templates has the stems in so many of its shingles that none can match without one.
STEMS = ("licen", "copyright", "reserved", "warrant", "distribut", "permission", "commons", "domain", "software", "source")

#: Notices and passages of public licenses.
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "mit-notice-licensed": "Licensed under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "all-rights-reserved": "All rights reserved.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "bsd-3-endorsement": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-as-is": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED",
    "gpl-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "agpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "epl-2.0-notice": "terms of the Eclipse Public License 2.0",
    "zlib": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "bsl-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software",
    "apache-2.0-as-is": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "cc0-1.0": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
    "as-is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED",
}

_WORD_SPLIT = "[^a-z0-9]+"


def words(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.filter(F.split(F.lower(text), _WORD_SPLIT), lambda w: w != "")


def _words(text: str) -> list[str]:
    import re

    return [w for w in re.split(_WORD_SPLIT, text.lower()) if w]


def _grams(text: str) -> set[str]:
    w = _words(text)
    return {" ".join(w[i : i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)}


def safe_stems(templates: dict[str, str]) -> tuple[str, ...]:
    """``STEMS`` if no template can match a text without any of them, else none."""
    grams = [_grams(t) for t in templates.values()]
    sure = all(sum(not any(s in g for s in STEMS) for g in gs) < needed(len(gs)) for gs in grams if gs)
    return STEMS if sure else ()


def stride(n: int) -> int:
    return max(1, n // 4)


def needed(n_shingles: int) -> int:
    """Distinct shingles of a template that a match holds at least; a short notice must stand whole."""
    return n_shingles if n_shingles <= SHORT else math.ceil(CONTAINMENT * n_shingles - 1e-9)


def bands(n: int, n_shingles: int) -> int:
    """Bands that make a miss of a window with the needed shingles less likely than ``MISS``."""
    window = n + stride(n) - SHINGLE + 1
    j = needed(n_shingles) / (window + n_shingles - needed(n_shingles))
    return math.ceil(math.log(MISS) / math.log(1 - j**ROWS)) if j < 1 else 1


def _bitmap(values: list[int], bits: int, shift: int) -> list[int]:
    out = [0] * (bits // 64)
    for v in values:
        at = (v >> shift) & (bits - 1)
        out[at // 64] |= 1 << (at % 64)
    return [x - (1 << 64) if x >> 63 else x for x in out]


def _held(bitmap: list[int], bits: int, shift: int, value: str) -> str:
    """SQL: whether the bitmap has the value's bit."""
    cells = "array(" + ",".join(f"{x}L" if x != -(1 << 63) else "(-9223372036854775807L - 1L)" for x in bitmap) + ")"
    part = f"(shiftright({value}, {shift}) & {bits - 1}L)"
    return f"(shiftright({cells}[cast(shiftright({part}, 6) AS int)], cast({part} & 63 AS int)) & 1L) = 1L"


def _hashes(w: str) -> str:
    return f"transform(sequence(0, size({w}) - {SHINGLE}), i -> xxhash64({', '.join(f'{w}[i + {k}]' for k in range(SHINGLE))}))"


def _shingles(w: str) -> str:
    return f"array_distinct(transform(sequence(0, size({w}) - {SHINGLE}), i -> concat_ws(' ', {', '.join(f'{w}[i + {k}]' for k in range(SHINGLE))})))"


def _signature(sh: str, n_bands: str) -> str:
    least = ", ".join(f"array_min(transform({sh}, x -> xxhash64(x, {ROWS} * k + {r})))" for r in range(ROWS))
    return f"transform(sequence(0, {n_bands} - 1), k -> xxhash64(k, {least}))"


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """``doc_id, license, containment, first_word, n_windows``: a row for each document and template that match."""
    spark = docs.sparkSession
    templates = TEMPLATES if templates is None else templates
    templates = {k: t for k, t in templates.items() if _grams(t)}
    known = spark.createDataFrame([(k, t) for k, t in templates.items()], "license string, body string").coalesce(1)
    known = known.select("license", words(F.col("body")).alias("w")).withColumn("n", F.size("w")).select("license", "n", F.expr(_shingles("w")).alias("shingles"), F.expr(_hashes("w")).alias("h"))
    size = {n: min(len(_grams(t)) for t in templates.values() if len(_words(t)) == n) for n in {len(_words(t)) for t in templates.values()}}
    own: dict[int, list[int]] = {}
    for r in known.select("n", "h").collect():  # the given templates, hashed as Spark does
        own.setdefault(r["n"], []).extend(r["h"])
    if not own:
        return docs.limit(0).selectExpr("doc_id", "'' AS license", "0D AS containment", "0L AS first_word", "0L AS n_windows")
    count = {n: bands(n, m) for n, m in size.items()}
    per_class = F.expr("CASE n " + " ".join(f"WHEN {n} THEN {b}" for n, b in count.items()) + " END")
    known = known.withColumn("b", per_class).select("n", "license", "shingles", F.expr(_signature("h", "b")).alias("tkeys")).select("*", F.posexplode("tkeys").alias("band", "key"))

    every = [h for hs in own.values() for h in hs]
    rows = slim(docs, "doc_id", "text").where("text IS NOT NULL")
    if stems := safe_stems(templates):
        rows = rows.where(F.greatest(*(F.contains(F.lower("text"), F.lit(s)) for s in stems)))
    rows = rows.select("doc_id", once(words(F.col("text"))).alias("w")).where(f"size(w) >= {SHINGLE}").select("doc_id", "w", once(F.expr(_hashes("w"))).alias("h"))
    near = " AND ".join(_held(_bitmap(every, _GLOBAL_BITS, s), _GLOBAL_BITS, s, "h[i]") for s in (0, 20))
    rows = rows.select("doc_id", "w", "h", once(F.expr(f"filter(sequence(0, size(h) - 1), i -> {near})")).alias("anchors")).where("size(anchors) > 0")
    found = []
    for n, hs in sorted(own.items()):
        s, width = stride(n), n + stride(n)
        mine = _held(_bitmap(hs, _CLASS_BITS, 8), _CLASS_BITS, 8, "h[i]")
        starts = f"array_distinct(flatten(transform(filter(anchors, i -> {mine}), i -> sequence(greatest(0, cast(ceil((i + {SHINGLE - width}) / {s}) AS int) * {s}), i - i % {s}, {s}))))"
        found.append(f"transform({starts}, a -> struct({n} AS n, {count[n]} AS b, a AS a, slice(h, a + 1, {width - SHINGLE + 1}) AS sh, slice(w, a + 1, {width}) AS ww))")
    windows = rows.select("doc_id", once(F.expr(f"concat({', '.join(found)})")).alias("v")).select("doc_id", F.explode("v").alias("v")).select("doc_id", "v.*")
    signed = windows.select("doc_id", "n", "a", "ww", once(F.expr(_signature("sh", "b"))).alias("keys")).select("*", F.posexplode("keys").alias("band", "key"))
    # A window that meets a template in several bands counts in the first of these only.
    met = signed.join(if_small(known), ["n", "band", "key"]).where("band = 0 OR NOT exists(sequence(0, band - 1), k -> keys[k] = tkeys[k])")
    share = F.size(F.array_intersect(F.expr(_shingles("ww")), "shingles")) / F.size("shingles")
    sure = met.select("doc_id", "license", "a", once(share).alias("containment"), F.size("shingles").alias("m")).where(f"containment * m >= IF(m <= {SHORT}, m, ceil({CONTAINMENT} * m - 1e-9)) - 1e-6")
    best = sure.groupBy("doc_id", "license").agg(F.max("containment").alias("containment"), F.min("a").alias("first_word"), F.count("*").alias("n_windows"))
    return best.select("doc_id", "license", F.round("containment", 6).alias("containment"), F.col("first_word").cast("long").alias("first_word"), "n_windows")


def oracle_sql(templates: dict[str, str] | None = None) -> str:
    """The same matches by brute force over all windows, in DuckDB's SQL."""
    rows = []
    for name, body in (TEMPLATES if templates is None else templates).items():
        w = _words(body)
        for g in sorted({" ".join(w[i : i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)}):
            rows.append(f"('{name}', {len(w)}, {stride(len(w))}, '{g}')")
    return f"""
WITH t(license, n, s, g) AS (VALUES {", ".join(rows)}),
m AS (SELECT license, count(*) AS m FROM t GROUP BY license),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, w, unnest(generate_series(0, len(w) - {SHINGLE})) AS i FROM d WHERE len(w) >= {SHINGLE}),
g AS (SELECT doc_id, i, {" || ' ' || ".join(f"w[i + {k + 1}]" for k in range(SHINGLE))} AS g FROM p),
hit AS (SELECT doc_id, license, n, s, i, g FROM g JOIN t USING (g)),
win AS (SELECT doc_id, license, g, unnest(generate_series(CAST(greatest(0, ceil((i + {SHINGLE} - n - s) / s)) * s AS BIGINT), i - i % s, s)) AS a FROM hit),
c AS (SELECT doc_id, license, a, count(DISTINCT g) AS k FROM win GROUP BY ALL)
SELECT doc_id, license, round(max(k / m), 6) AS containment, CAST(min(a) AS BIGINT) AS first_word, count(*) AS n_windows
FROM c JOIN m USING (license) WHERE k >= CASE WHEN m <= {SHORT} THEN m ELSE ceil({CONTAINMENT} * m - 1e-9) END GROUP BY doc_id, license
"""
