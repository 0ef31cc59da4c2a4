"""Benchmark decontamination: find benchmark windows in documents, cut them or drop the documents.

Both sides are read as words (A-Z folded, digits, letters, everything outside ASCII). An item is
represented by its windows of ``size`` consecutive words, or by one window if it is shorter. The
windows of the benchmark become a table of hashes that is broadcast; documents are only scanned,
so no document text and no document window is ever shuffled.

The table is broadcast in slices of at most about ``slice_rows`` rows of 40 bytes. A benchmark
of one slice takes one scan. A larger one takes one scan per slice, each adding to what the scans
before have found; the result is the same.

Every hash hit is verified by the SHA-256 of the window's words.

Defined results: a null or empty text has no words and no hit. Items without an id or without
words take no part. Items that repeat an id count as one item. Repeated documents are judged
row by row.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from canvasser.llm.common import pieces, saved
from canvasser.llm.hashing import WORD_BYTES, join_texts, windows, words

SIZE = 13
SLICE_ROWS = 200_000
FOUND = "n_words long, hits array<int>, items array<string>"
_FOLD = bytes(WORD_BYTES)
_BITS = 1 << 20


def _joined(folded: bytes, starts: np.ndarray, ends: np.ndarray, first: int, size: int) -> bytes:
    return b" ".join([folded[starts[k] : ends[k]] for k in range(first, first + size)])


def benchmark_windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """Distinct (item, n, hash, digest) of the windows of all items."""

    def run(batches):
        for batch in batches:
            rows = []
            for item, body in zip(batch["item"], batch["body"]):
                data, _ = join_texts([body])
                starts, ends, hashes = words(data)
                n = min(size, len(starts))
                folded = data.translate(_FOLD)
                for k, h in enumerate(windows(hashes, n) if n else ()):
                    digest = hashlib.sha256(_joined(folded, starts, ends, k, n)).digest()
                    rows.append((item, n, int(h.astype(np.int64)), digest))
            yield pd.DataFrame(rows, columns=["item", "n", "hash", "digest"])

    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("body")).dropna()
    return items.mapInPandas(run, "item string, n int, hash long, digest binary").distinct()


def _index(rows: pd.DataFrame) -> dict:
    """Windows by length: sorted hashes, a bit table of their low bits, and digests with items by hash."""
    out = {}
    for n, group in rows.groupby("n"):
        known: dict[int, dict[bytes, list[str]]] = {}
        for h, digest, item in zip(group["hash"], group["digest"], group["item"]):
            known.setdefault(h, {}).setdefault(bytes(digest), []).append(item)
        hashes = np.sort(np.array(list(known), np.int64)).view(np.uint64)
        bits = np.zeros(_BITS, bool)
        bits[(hashes & np.uint64(_BITS - 1)).astype(np.int64)] = True
        out[int(n)] = (hashes.view(np.int64), bits, known)
    return out


def _merged(spans: list[tuple[int, int]]) -> list[int]:
    flat: list[int] = []
    for a, b in sorted(spans):
        if flat and a <= flat[-1]:
            flat[-1] = max(flat[-1], b)
        else:
            flat += [a, b]
    return flat


def _scan(texts: list, index: dict, before: list[tuple[list, list]]) -> list[tuple[int, list[int], list[str]]]:
    """Words, merged hit spans (in words) and items of each text, with what earlier slices have found."""
    data, begins = join_texts(texts)
    starts, ends, hashes = words(data)
    doc = np.searchsorted(begins, starts, "right") - 1
    spans = [list(zip(old[0][::2], old[0][1::2])) for old in before]
    items = [set(old[1]) for old in before]
    first = np.searchsorted(doc, np.arange(len(texts)))
    folded = data.translate(_FOLD)
    for n, (sorted_hashes, bits, known) in index.items():
        found = windows(hashes, n)
        maybe = np.flatnonzero(bits[(found & np.uint64(_BITS - 1)).astype(np.int64)])
        maybe = maybe[doc[maybe] == doc[maybe + n - 1]]
        value = found[maybe].view(np.int64)
        at = np.minimum(np.searchsorted(sorted_hashes, value), len(sorted_hashes) - 1)
        for k, h in zip(maybe[sorted_hashes[at] == value], value[sorted_hashes[at] == value]):
            held = known[int(h)].get(hashlib.sha256(_joined(folded, starts, ends, k, n)).digest())
            if held:
                d = doc[k]
                place = int(k - first[d])
                spans[d].append((place, place + n))
                items[d].update(held)
    n_words = np.bincount(doc, minlength=len(texts))
    return [(int(n_words[i]), _merged(spans[i]), sorted(items[i])) for i in range(len(texts))]


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", size: int = SIZE, slice_rows: int = SLICE_ROWS, into: str = "found") -> DataFrame:
    """The documents with a struct ``into``: n_words, hits (word spans, start and end in turn), items."""
    spark = docs.sparkSession
    rows = saved(benchmark_windows(benchmark, size=size), "windows")
    slices = max(1, math.ceil(rows.count() / slice_rows))
    docs = docs.withColumn(into, F.lit(None).cast("struct<n_words:bigint,hits:array<int>,items:array<string>>"))
    for k in range(slices):
        part = rows.filter(F.pmod(F.xxhash64("hash", "item"), F.lit(slices)) == k)
        shared = spark.sparkContext.broadcast(_index(part.toPandas()))

        @F.pandas_udf(FOUND)
        def scan(bodies: pd.Series, before: pd.DataFrame) -> pd.DataFrame:
            out = []
            old = [(list(h) if h is not None else [], list(i) if i is not None else []) for h, i in zip(before["hits"], before["items"])]
            for a, b in pieces(bodies):
                out += _scan(list(bodies[a:b]), shared.value, old[a:b])
            return pd.DataFrame(out, columns=["n_words", "hits", "items"])

        docs = docs.withColumn(into, scan(F.col(text), F.col(into)))
        if k + 1 < slices:
            docs = saved(docs, "scanned")
    return docs


def n_hit(found: str = "found"):
    """Words inside hits: ends less starts."""
    return F.aggregate(f"{found}.hits", F.lit(0).cast("long"), lambda total, x: x.cast("long") - total)


def contaminated(found: str = "found", part: int = 20):
    """Any hit, and hits make at least one ``part``-th of the words."""
    return (n_hit(found) > 0) & (n_hit(found) * part >= F.col(f"{found}.n_words"))


@F.pandas_udf(StringType())
def _cut(bodies: pd.Series, hits: pd.Series) -> pd.Series:
    out = []
    for body, flat in zip(bodies, hits):
        if flat is not None and len(flat):
            data, _ = join_texts([body])
            starts, ends, _ = words(data)
            kept, at = [], 0
            for a, b in zip(flat[::2], flat[1::2]):
                kept.append(data[at : starts[a]])
                at = ends[b - 1]
            body = b"".join([*kept, data[at:-1]]).decode("utf-8", "surrogatepass")
        out.append(body)
    return pd.Series(out, dtype=object)


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", text: str = "text", **options) -> DataFrame:
    """The documents without contaminated ones (``documents``), or with every hit cut out (``spans``)."""
    if remove not in ("documents", "spans"):
        raise ValueError("remove is 'documents' or 'spans'")
    mark = "_contamination"
    while mark in docs.columns:
        mark += "_"
    found = find(docs, benchmark, text, into=mark, **options)
    if remove == "documents":
        return found.filter(~contaminated(mark)).drop(mark)
    return found.withColumn(text, _cut(F.col(text), F.col(f"{mark}.hits"))).drop(mark)


def report(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = find(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), benchmark, "text", **options)
    return found.select(
        "doc_id",
        F.col("found.n_words").alias("n_words"),
        n_hit().alias("n_hit"),
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )
