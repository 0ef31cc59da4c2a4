"""Two tokenizers side by side: which tokens share bytes, end together and fall into one group.

A text is cut by tokenizer A (a byte-level file of the tokenizers library) and by B (a
sentencepiece model). Both cuts are incidence matrices of tokens and bytes in compressed rows
(``incidence.py``), of all texts of a batch at once, as both cuts of a text hold the same bytes:

* A x B' over all bytes of the tokens: overlap links, with the bytes they share;
* A x B' over last bytes: the links proper, tokens that end together;
* places where both end cut the tokens into groups; the products of the group incidences are the
  shared-group links. Their number can grow with the square of a group, so they are only counted
  (a matrix-vector product).

``align`` does that where the rows are and saves, per text, figures, digest and its distinct linked
id pairs with how often each occurs. ``pair_counts`` adds these up over the corpus. ``with_counts``
brings the counts back: the most frequent pairs (``TABLE`` at most) are broadcast, and only pairs
beyond them travel as rows. So no frequent pair is ever shuffled, and a pair that is shuffled is
one row per document for a document key that is unique.

Defined results: texts that are null, empty, or whose bytes are not those of the tokens of both
(B changes or lacks some characters) have no tokens: figures 0, digest ''. Special strings inside
texts are plain text. Every row counts, repeated rows and ids too, a null id as well. Empty
tables give empty results. Other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvasser.llm import bpe
from canvasser.llm.common import pieces, saved
from canvasser.llm.incidence import Rows, members, ranges

PIECE = 500_000  # characters aligned at once, about
TABLE = 2_000_000  # id pairs that are broadcast (17 bytes each)
_SHIFT = np.int64(32)
_FIGURES = ["n_a", "n_b", "n_groups", "n_links", "n_overlaps", "n_shared"]


class Pieces:
    """The bytes of every id of a tokenizer, in one array."""

    def __init__(self, found: list[bytes]):
        self.raw = np.frombuffer(b"".join(found), np.uint8)
        self.sizes = np.fromiter(map(len, found), np.int64, len(found))
        self.starts = np.cumsum(self.sizes) - self.sizes

    def joined(self, ids: np.ndarray) -> bytes:
        at = np.repeat(self.starts[ids] - (np.cumsum(self.sizes[ids]) - self.sizes[ids]), self.sizes[ids])
        return self.raw[at + np.arange(len(at))].tobytes()


class Tokenizers:
    """Both tokenizers with the bytes of their ids.

    A's ids are those of the library (``bpe.py``), with words met before remembered.
    """

    def __init__(self, json_path: str, model_path: str):
        import sentencepiece

        plain = bpe.Vocabulary(bpe.without_special(Path(json_path).read_text(encoding="utf-8")))
        self.a = bpe.Remembered(plain)
        self.b = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.bytes_a = Pieces(plain.pieces)
        self.bytes_b = Pieces([self._piece(i) for i in range(self.b.get_piece_size())])

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of A of a blank and the text, and of B of the text (which adds the blank)."""
        ids, counts = self.a.encode([" " + t for t in texts])
        return np.split(ids, np.cumsum(counts)[:-1]), [np.array(x, np.int64) for x in self.b.encode(texts, num_threads=1)]


@lru_cache(maxsize=2)
def tokenizers_of(json_path: str, model_path: str) -> Tokenizers:
    """The tokenizers, read once per worker."""
    return Tokenizers(json_path, model_path)


@dataclass
class Alignment:
    """Links and groups of the tokens of a run of texts; tokens are numbered over all texts."""

    ends_a: np.ndarray  # byte behind each token
    ends_b: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    overlaps: Rows  # (token of A, token of B): bytes they share
    links: Rows  # (token of A, token of B) that end together

    @classmethod
    def of(cls, sizes_a: np.ndarray, sizes_b: np.ndarray) -> Alignment:
        """From the byte counts of the tokens; both sides add up to the same."""
        ends_a, ends_b = np.cumsum(sizes_a), np.cumsum(sizes_b)
        width = int(ends_a[-1]) if len(ends_a) else 0
        overlaps = ranges(ends_a - sizes_a, ends_a, width) @ ranges(ends_b - sizes_b, ends_b, width).transposed()
        links = members(ends_a - 1, width) @ members(ends_b - 1, width).transposed()
        cuts = ends_a[np.repeat(np.arange(links.height), np.diff(links.starts))]
        return cls(ends_a, ends_b, np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b), overlaps, links)

    def linked(self) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the tokens of A and of B of every link."""
        return np.repeat(np.arange(self.links.height), np.diff(self.links.starts)), self.links.columns

    def shared(self) -> np.ndarray:
        """Tokens of B in the group of each token of A: row sums of the group product."""
        groups = 1 + int(max(self.group_a[-1:].max(initial=-1), self.group_b[-1:].max(initial=-1)))
        in_group = members(self.group_b, groups).transposed().times(np.ones(len(self.group_b), np.int64))
        return members(self.group_a, groups).times(in_group)


_DIGITS = 10


@lru_cache(maxsize=4)
def _decimals(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of 0 ... n - 1, left-aligned with room for a separator, and how many each has."""
    text = [str(i).encode() for i in range(n)]
    table = np.array([t.ljust(_DIGITS + 1) for t in text], f"S{_DIGITS + 1}").view(np.uint8).reshape(n, -1)
    return table[:, : len(text[-1]) + 1].copy(), np.fromiter(map(len, text), np.int64, n)


def group_text(ids_a: np.ndarray, ids_b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, known: int) -> bytes:
    """``a1,a2|b1;a3|b2,b3``: the ids of each group (numbered in order) of both sides; ids are below ``known``."""
    if not len(ids_a):
        return b""
    side = np.concatenate([2 * group_a, 2 * group_b + 1])
    order = np.argsort(side, kind="stable")
    side, ids = side[order], np.concatenate([ids_a, ids_b])[order]
    digits, sizes = _decimals(known)
    out, sizes = digits[ids], sizes[ids]
    separator = np.where(side[1:] == side[:-1], ord(","), np.where(side[:-1] % 2, ord(";"), ord("|")))
    out[np.arange(len(ids) - 1), sizes[:-1]] = separator
    sizes = sizes + 1
    sizes[-1] -= 1
    return out[np.arange(out.shape[1]) < sizes[:, None]].tobytes()


def _figures(texts: list[str], both: Tokenizers) -> Iterator[tuple]:
    """Per text: the figures, the digest, its linked pairs (a << 32 | b) and how often each occurs."""
    ids_a, ids_b = both.encode(texts)
    for i, text in enumerate(texts):
        raw = (" " + text).encode("utf-8", "surrogatepass")
        if not text or both.bytes_a.joined(ids_a[i]) != raw or both.bytes_b.joined(ids_b[i]) != raw:
            ids_a[i] = ids_b[i] = ids_a[i][:0]
    all_a, all_b = np.concatenate(ids_a), np.concatenate(ids_b)
    found = Alignment.of(both.bytes_a.sizes[all_a], both.bytes_b.sizes[all_b])
    at_a = np.concatenate(([0], np.cumsum([len(x) for x in ids_a])))
    at_b = np.concatenate(([0], np.cumsum([len(x) for x in ids_b])))
    left, right = found.linked()
    pair = (all_a[left] << _SHIFT) | all_b[right]
    links_at = found.links.starts[at_a]
    shared = np.concatenate(([0], np.cumsum(found.shared())))[at_a]
    overlaps = found.overlaps.starts[at_a]
    known = max(len(both.bytes_a.sizes), len(both.bytes_b.sizes))
    for i in range(len(texts)):
        a, b = slice(at_a[i], at_a[i + 1]), slice(at_b[i], at_b[i + 1])
        if a.start == a.stop:
            yield (*[0] * len(_FIGURES), "", [], [])
            continue
        text = group_text(all_a[a], all_b[b], found.group_a[a], found.group_b[b], known)
        pairs, times = np.unique(pair[links_at[i] : links_at[i + 1]], return_counts=True)
        groups = int(found.group_a[a.stop - 1] - found.group_a[a.start]) + 1
        yield (
            a.stop - a.start, b.stop - b.start, groups, int(links_at[i + 1] - links_at[i]), int(overlaps[i + 1] - overlaps[i]),
            int(shared[i + 1] - shared[i]), hashlib.sha256(text).hexdigest(), pairs, times,
        )


ALIGNED = f"row long, {', '.join(f + ' long' for f in _FIGURES)}, groups_sha256 string, pairs array<long>, times array<int>"


def align(docs: DataFrame, json_path: str, model_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, row (a number of its own), the figures, and its linked pairs with how often each occurs; saved."""
    kind = docs.schema[doc_id].dataType.simpleString()
    types = [pa.int64()] * (1 + len(_FIGURES)) + [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32())]
    names = [c.split()[0] for c in ALIGNED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, count = tokenizers_of(json_path, model_path), TaskContext.get().partitionId() << 33
        for batch in batches:
            texts = pd.Series([t or "" for t in batch["text"].to_pylist()], dtype=object)
            for a, b in pieces(texts, PIECE):
                rows = zip(*_figures(list(texts[a:b]), both))
                columns = [range(count, count + b - a), *rows]
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, b - a), *(pa.array(c, t) for c, t in zip(columns, types))], names=["doc_id", *names])
                count += b - a

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return saved(rows.mapInArrow(run, f"doc_id {kind}, {ALIGNED}"), "aligned")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n, best): links of each id pair in the corpus, and whether its B id has no more frequent pair; saved."""
    spot = F.explode(F.arrays_zip("pairs", "times")).alias("s")
    counts = saved(aligned.select(spot).groupBy(F.col("s.pairs").alias("pair")).agg(F.sum("s.times").cast("long").alias("n")), "pairs")
    other = F.col("pair").bitwiseAND(F.lit(2**32 - 1)).alias("b")
    most = counts.groupBy(other).agg(F.max("n").alias("most"))  # a row per id of B
    return saved(counts.withColumn("b", other).join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pair-counts")


def _frequent(counts: DataFrame, most: int) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], DataFrame | None]:
    """The ``most`` most frequent pairs as sorted arrays, and the others (None: there are none)."""
    rest = None
    if counts.count() > most:
        top = saved(counts.orderBy(F.desc("n"), "pair").limit(most), "frequent-pairs")
        rest, counts = counts.join(top.select("pair"), "pair", "left_anti"), top
    found = counts.toArrow()
    pair, n, best = (found[c].to_numpy() for c in ("pair", "n", "best"))
    order = np.argsort(pair)
    return (pair[order], n[order], best[order]), rest


_SUMS = "struct<count_sum:long,n_best:long,open:array<struct<pair:long,times:int>>>"


def with_counts(aligned: DataFrame, counts: DataFrame, most: int = TABLE) -> DataFrame:
    """The rows of ``align`` with count_sum (over links: the count of their pair) and n_best (links whose pair is best)."""
    table, rest = _frequent(counts, most)
    shared = aligned.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf(_SUMS)
    def sums(pairs: pd.Series, times: pd.Series) -> pd.DataFrame:
        known, n, best = shared.value
        sizes = np.fromiter(map(len, pairs), np.int64, len(pairs))
        owner = np.repeat(np.arange(len(pairs)), sizes)
        pair, often = (np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for x in (pairs, times))
        at = np.minimum(np.searchsorted(known, pair), max(0, len(known) - 1))
        hit = known[at] == pair if len(known) else np.zeros(len(pair), bool)
        weight, top = (n[at] * often * hit, best[at] * often * hit) if len(known) else (often * 0, often * 0)
        ends = np.cumsum(sizes)
        total = [np.concatenate(([0], np.cumsum(x)))[[*ends]] - np.concatenate(([0], np.cumsum(x)))[[*(ends - sizes)]] for x in (weight, top)]
        left = [[] for _ in range(len(pairs))]
        for i, p, k in zip(owner[~hit].tolist(), pair[~hit].tolist(), often[~hit].tolist()):
            left[i].append({"pair": p, "times": k})
        return pd.DataFrame({"count_sum": total[0], "n_best": total[1], "open": pd.Series(left, dtype=object)})

    rows = aligned.select("doc_id", "row", *_FIGURES, "groups_sha256", sums("pairs", "times").alias("s"))
    rows = rows.select("doc_id", "row", *_FIGURES, "groups_sha256", "s.*")
    if rest is not None:
        rows = saved(rows, "counted")
        wanted = rows.select("row", F.explode("open").alias("o")).select("row", "o.pair", "o.times").join(rest, "pair")
        more = wanted.groupBy("row").agg(F.sum(F.col("n") * F.col("times")).alias("more"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"))
        rows = rows.join(more, "row", "left").withColumns({"count_sum": F.col("count_sum") + F.coalesce("more", F.lit(0)), "n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0))})
    return rows.select("doc_id", *_FIGURES[:4], "n_best", "count_sum", "groups_sha256", "n_overlaps", "n_shared")


def report(docs: DataFrame, json_path: str, model_path: str, doc_id: str = "doc_id", text: str = "text", most: int = TABLE) -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_overlaps, n_shared."""
    aligned = align(docs, json_path, model_path, doc_id, text)
    return with_counts(aligned, pair_counts(aligned), most)
