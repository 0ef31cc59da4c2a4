"""License scans: winnowed fingerprints pick candidates, banded alignment measures them.

Templates and documents are read as words (A-Z folded, digits, letters, everything outside
ASCII). Of every ``WINDOW`` consecutive hashes of ``GRAM`` words the least one is a fingerprint,
so a common run of GRAM + WINDOW - 1 words shares one. The fingerprints of the templates are an
inverted index (fingerprint, template, place) that is broadcast in slices of at most
``SLICE_ROWS`` rows; more templates take more scans. Documents are only scanned, never shuffled.

Hits of a template that lie close in the document and on close diagonals are one candidate; it
is aligned with the template inside the band of its diagonals and ``BAND`` words more on each
side (match 2, mismatch and gap -1). Coverage is the share of the template's words that match; a
candidate is reported if that is ``COVERAGE`` or more. Of overlapping reports of one template the
better one stays.

Defined results: null and empty texts have no matches. Templates of fewer than GRAM words, or
without id or words, take no part; templates that share an id are alternatives of one license.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvasser.llm.common import pieces, saved
from canvasser.llm.hashing import join_texts, windows, words

GRAM = 3
WINDOW = 2
BAND = 8
COVERAGE = 0.8
SLICE_ROWS = 200_000
MATCH = "array<struct<license:string,coverage:double,first:int,last:int,start:int,end:int>>"

# Short notices of common licenses.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
]


def winnow(hashes: np.ndarray, size: int = GRAM, width: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of a sequence of word hashes, and their places."""
    grams = windows(hashes, size)
    if not len(grams):
        return grams, np.zeros(0, np.int64)
    width = min(width, len(grams))
    view = np.lib.stride_tricks.sliding_window_view(grams, width)
    at = np.unique(np.argmin(view, axis=1) + np.arange(len(view)))
    return grams[at], at


def align(template: np.ndarray, part: np.ndarray, low: int, high: int) -> tuple[int, int, int]:
    """Best local alignment on diagonals low..high (place in part less place in template).

    Returns matched words and the first and last place (exclusive) in ``part``.
    """
    m, n, width = len(template), len(part), high - low + 1
    offsets = np.arange(width)
    score = np.zeros((m + 1, width + 2), np.int32)  # one column of zeros on each side
    for i in range(1, m + 1):
        j = i - 1 + low + offsets
        inside = (j >= 0) & (j < n)
        same = inside & (part[np.clip(j, 0, max(0, n - 1))] == template[i - 1])
        above = score[i - 1]
        row = np.maximum(above[1:-1] + np.where(same, 2, -1), above[2:] - 1)
        row = np.where(inside, np.maximum(row, 0), 0)
        ahead = np.maximum.accumulate(row + offsets) - offsets  # gaps along the row cost 1 each
        score[i, 1:-1] = np.where(inside, ahead, 0)
    i, k = np.unravel_index(int(np.argmax(score)), score.shape)
    matched, first, last = 0, 0, 0
    while i > 0 and 0 < k <= width and score[i, k] > 0:
        j = i - 1 + low + k - 1
        same = 0 <= j < n and part[j] == template[i - 1]
        if score[i, k] == score[i - 1, k] + (2 if same else -1):
            if same:
                matched += 1
                first, last = j, last or j + 1
            i -= 1
        elif score[i, k] == score[i - 1, k + 1] - 1:
            i, k = i - 1, k + 1
        else:
            k -= 1
    return matched, first, last


def _index(rows: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inverted index of the templates: sorted fingerprints, templates, places."""
    found = [(f, np.full(len(f), t), at) for t, (f, at) in ((t, winnow(h)) for t, h in rows)]
    values, template, place = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(values, kind="stable")
    return values[order], template[order], place[order]


def _candidates(doc_at: np.ndarray, template: np.ndarray, place: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int, int]]:
    """(template, lowest diagonal, highest diagonal) of hits that belong together."""
    diagonal = doc_at - place
    order = np.lexsort((diagonal, template))
    out, begin = [], 0
    for e in range(1, len(order) + 1):
        if e == len(order) or template[order[e]] != template[order[begin]] or diagonal[order[e]] - diagonal[order[e - 1]] > BAND:
            group = order[begin:e]
            out.append((int(template[group[0]]), int(diagonal[group].min()), int(diagonal[group].max())))
            begin = e
    wide = []
    for t, low, high in out:  # hits all along a document: one candidate per stretch of a template's length
        step = int(sizes[t])
        for a in range(low, high + 1, step):
            wide.append((t, a, min(high, a + step - 1)))
    return wide


def _scan(texts: list, index, templates: list[np.ndarray], names: list[str], least: float) -> list[list[tuple]]:
    data, begins = join_texts(texts)
    starts, ends, hashes = words(data)
    bounds = np.searchsorted(starts, begins)
    sizes = np.array([len(t) for t in templates])
    values, of, place = index
    full = windows(hashes, GRAM)
    known = np.unique(values)
    at = np.minimum(np.searchsorted(known, full), max(0, len(known) - 1))
    some = np.flatnonzero(known[at] == full) if len(known) else np.zeros(0, np.int64)
    out: list[list[tuple]] = [[] for _ in texts]
    for d in np.unique(np.searchsorted(bounds, some, "right") - 1):
        own = hashes[bounds[d] : bounds[d + 1]]
        prints, spots = winnow(own)
        left, right = np.searchsorted(values, prints, "left"), np.searchsorted(values, prints, "right")
        hits = [(s, k) for s, a, b in zip(spots, left, right) for k in range(a, b)]
        if not hits:
            continue
        spot, which = np.array([h[0] for h in hits]), np.array([h[1] for h in hits])
        found, left_of = [], {}
        for t, low, high in _candidates(spot, of[which], place[which], sizes):
            left = left_of.setdefault(t, own.copy())  # words of a reported match are not matched again
            a, b = max(0, low - BAND), min(len(own), high + len(templates[t]) + BAND)
            while True:
                matched, first, last = align(templates[t], left[a:b], low - BAND - a, high + BAND - a)
                if matched < least * len(templates[t]):
                    break
                found.append((names[t], matched / len(templates[t]), a + first, a + last))
                left[a + first : a + last] = 0
        for name, coverage, first, last in sorted(set(found), key=lambda x: (-x[1], x[2], x[3] - x[2], x[0])):
            if all(o[0] != name or last <= o[2] or first >= o[3] for o in out[d]):
                s, e = starts[bounds[d] + first], ends[bounds[d] + last - 1]
                start = len(data[begins[d] : s].decode("utf-8", "surrogatepass"))
                out[d].append((name, coverage, int(first), int(last), start, start + len(data[s:e].decode("utf-8", "surrogatepass"))))
        out[d].sort(key=lambda x: (x[2], x[0]))
    return out


def scan(docs: DataFrame, templates: DataFrame, text: str = "text", into: str = "licenses", least: float = COVERAGE, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """The documents with an array of matches: license, coverage, first and last word, start and end character.

    ``templates`` has the columns license and text.
    """
    spark = docs.sparkSession
    counted = templates.dropna(subset=["license", "text"]).select("license", "text", F.length("text").alias("size"))
    slices = max(1, math.ceil((counted.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]) / (4 * slice_rows)))  # a fingerprint takes four characters at least
    parts = []
    for k in range(slices):
        rows = counted.filter(F.pmod(F.xxhash64("license", "text"), F.lit(slices)) == k).orderBy("license", "text").collect()
        hashes = [(r["license"], words(join_texts([r["text"]])[0])[2]) for r in rows]
        hashes = [(name, h) for name, h in hashes if len(h) >= GRAM]
        if not hashes:
            continue
        listed = [h for _, h in hashes]
        shared = spark.sparkContext.broadcast((_index(list(enumerate(listed))), listed, [name for name, _ in hashes]))

        @F.pandas_udf(MATCH)
        def look(bodies: pd.Series) -> pd.Series:
            index, known, names = shared.value
            keys = ("license", "coverage", "first", "last", "start", "end")
            found = [row for a, b in pieces(bodies) for row in _scan(list(bodies[a:b]), index, known, names, least)]
            return pd.Series([[dict(zip(keys, m)) for m in row] for row in found], dtype=object)

        part = f"_{into}_{k}"
        docs = docs.withColumn(part, look(F.coalesce(F.col(text), F.lit(""))))
        if slices > 1:
            docs = saved(docs, "licenses")
        parts.append(part)
    every = F.concat(*[F.col(p) for p in parts]) if parts else F.array().cast(MATCH)
    return docs.withColumn(into, every).drop(*parts)


def report(docs: DataFrame, templates: DataFrame, **options) -> DataFrame:
    """Per document and license: doc_id, license, n_matches, coverage (best), start and end of the best match."""
    rows = scan(docs.select("doc_id", "text"), templates, **options)
    name = F.explode(F.array_distinct(F.transform("licenses", lambda m: m["license"]))).alias("license")
    rows = rows.select("doc_id", "licenses", name).withColumn("own", F.filter("licenses", lambda m: m["license"] == F.col("license")))
    order = F.transform("own", lambda m: F.struct((-m["coverage"]).alias("c"), m["start"].alias("start"), m["end"].alias("end")))
    best = F.array_min(order)
    return rows.select("doc_id", "license", F.size("own").cast("long").alias("n_matches"), (-best["c"]).alias("coverage"), best["start"].alias("start"), best["end"].alias("end"))
