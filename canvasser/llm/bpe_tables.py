"""BPE encoding and decoding through a table of distinct words.

1. Documents are split into words (``Vocabulary.units``) and counted; the count of a frequent
   word is combined on the map side, so a word of a third of the corpus is one row per task.
2. Every distinct word that occurs again is encoded once; the table (word, n, ids) is saved. A
   word that occurs once in the corpus is encoded where it stands, which is once as well, and
   takes no place in the table (two of three distinct words of the check tables).
3. Ids are joined back by position. If the whole table fits ``TABLE_BYTES`` it is broadcast and
   texts are not shuffled at all. Beyond that only the most frequent words are broadcast, as many
   as surely fit; the other words of a document travel as rows (document, word) to the table and
   back, keyed by a document key that is unique, so no key is hot.
4. Decoding looks each id up in the vocabulary (checked size), which is broadcast: a map-side join.

Defined results: a null text counts as empty: no ids, decoded to the empty text. Special strings
inside texts are their token. Unknown ids decode to nothing.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canvasser.llm import bpe
from canvasser.llm.common import saved, spans
from canvasser.llm.hashing import LONGEST as LONGEST_HASHED
from canvasser.llm.hashing import digest, prefix_sums, segments, slice_hashes

TABLE_BYTES = 48 * 1024 * 1024
PIECE = 500_000  # bytes of text encoded at once, about
SLICES = 8  # parts in which the broadcast table is fetched (a power of two)
LONGEST = 64  # bytes of a word in a table that holds only the frequent words
FLUSH = 200_000  # distinct words a task holds before it hands them on
PIECES = 4_000_000  # most entries of a vocabulary that is broadcast


def _hashes(words: list[str]) -> np.ndarray:
    """64-bit hashes of the words' bytes; long words are hashed one by one."""
    raw = [w.encode("utf-8", "surrogatepass") for w in words]
    short = [r if len(r) <= LONGEST_HASHED else b"" for r in raw]
    ends = np.cumsum(np.fromiter(map(len, short), np.int64, len(short)))
    starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    out = slice_hashes(prefix_sums(np.frombuffer(b"".join(short), np.uint8)), starts, ends)
    for i, r in enumerate(raw):
        if len(r) > LONGEST_HASHED:
            out[i] = digest(r)
    return out.view(np.int64)


def _source(docs: DataFrame, path: str):
    return docs.sparkSession.sparkContext.broadcast(Path(path).read_text(encoding="utf-8"))


def word_table(docs: DataFrame, path: str, text: str = "text", least: int = 2) -> DataFrame:
    """Every distinct word that occurs ``least`` times or more: word, n, hash, ids (32-bit integers as bytes)."""
    shared = _source(docs, path)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary, found = bpe.vocabulary(shared.value), Counter()
        for batch in batches:
            for body in batch["body"]:
                found.update(vocabulary.units(body))
                if len(found) > FLUSH:
                    yield pd.DataFrame({"word": list(found), "n": list(found.values())})
                    found = Counter()
        if found:
            yield pd.DataFrame({"word": list(found), "n": list(found.values())})

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = bpe.vocabulary(shared.value)
        for batch in batches:
            words = list(batch["word"])
            if not words:
                continue
            ids, counts = vocabulary.encode_units(words)
            ends = np.cumsum(counts) * 4
            raw = ids.astype("<i4").tobytes()
            cut = [raw[e - 4 * c : e] for e, c in zip(ends.tolist(), counts.tolist())]
            yield pd.DataFrame({"word": words, "n": batch["n"], "hash": _hashes(words), "ids": cut})

    found = docs.select(F.col(text).alias("body")).dropna().mapInPandas(count, "word string, n long")
    distinct = found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    return saved(distinct.mapInPandas(encode, "word string, n long, hash long, ids binary"), "words")


def _broadcast_table(words: DataFrame, table_bytes: int, wide: bool):
    """The words to broadcast as (hashes, bounds, ids), and the others (None: all are in).

    A word takes 12 bytes and 2 for each id, or 4 where ``wide`` says that ids need them.
    """
    each = 4 if wide else 2
    size = words.agg(F.coalesce(F.sum(F.length("ids") / 4 * each + 12), F.lit(0)), F.count("*") - F.count_distinct("hash")).first()
    rest = None
    if size[0] > table_bytes or size[1]:
        top = words.filter(F.octet_length("word") <= LONGEST).orderBy(F.desc("n"), "word").limit(table_bytes // (12 + each * LONGEST))
        top = saved(top, "frequent")
        rest = words.join(top, "word", "left_anti")
        words = top
    parts = []
    for k in range(-SLICES // 2, SLICES // 2):  # ranges of the hash in turn, so the driver holds little besides the table
        part = words.filter(F.shiftright("hash", 64 - SLICES.bit_length() + 1) == k).select("hash", F.length("ids").alias("size"), "ids").toArrow()
        hashes, counts = part["hash"].to_numpy(), part["size"].to_numpy().astype(np.int64) // 4
        raw = np.concatenate([np.zeros(0, np.int32 if wide else np.uint16), *(_plain_ids(c, wide) for c in part["ids"].chunks)])
        order = np.argsort(hashes)
        parts.append((hashes[order], counts[order].astype(np.int32), raw[_ragged((np.cumsum(counts) - counts)[order], counts[order])]))
    hashes, counts, ids = (np.concatenate(x) for x in zip(*parts))
    return (hashes, np.concatenate(([0], np.cumsum(counts, dtype=np.int64))).astype(np.int32 if len(ids) < 2**31 else np.int64), ids), rest


def _plain_ids(part: pa.Array, wide: bool) -> np.ndarray:
    """All ids of a chunk of the binary column, without an object per row."""
    bounds = np.frombuffer(part.buffers()[1], np.int32 if pa.types.is_binary(part.type) else np.int64)[part.offset : part.offset + len(part) + 1]
    values = np.frombuffer(part.buffers()[2], np.uint8)[bounds[0] : bounds[-1]] if len(part) and part.buffers()[2] else np.zeros(0, np.uint8)
    return values.copy().view("<i4").astype(np.int32 if wide else np.uint16)


def _ragged(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Places first[i] ... first[i] + counts[i] - 1, one after the other."""
    group, place = segments(counts)
    return first[group] + place


def _spelt(words: list[str], first: np.ndarray, n: np.ndarray, ids: np.ndarray, vocabulary: bpe.Vocabulary) -> np.ndarray:
    """Whether the pieces of ids[first : first + n] spell each word."""
    want = [vocabulary.text_of(w).encode("utf-8", "surrogatepass") for w in words]
    raw, starts, sizes = vocabulary.piece_bytes
    mine = ids[_ragged(first, n)].astype(np.int64)
    length = np.bincount(np.repeat(np.arange(len(n)), n), weights=sizes[mine], minlength=len(n)).astype(np.int64)
    fits = length == np.fromiter(map(len, want), np.int64, len(want))
    if not fits.all():
        some = np.flatnonzero(fits)
        fits[some] = _spelt([words[k] for k in some.tolist()], first[some], n[some], ids, vocabulary)
        return fits
    same = raw[_ragged(starts[mine], sizes[mine])] == np.frombuffer(b"".join(want), np.uint8)
    return np.bincount(np.repeat(np.arange(len(n)), length), weights=same, minlength=len(n)) == length


def _positions(texts: list, vocabulary: bpe.Vocabulary, table, whole: bool) -> tuple[np.ndarray, np.ndarray, list, list]:
    """All ids with the bounds of each text's, the tail words of each text (distinct), and where they go (place in ids, word).

    If the table is ``whole``, words it lacks occur once: they are encoded here, and there are no tails.
    """
    hashes, bounds, ids = table
    tokens = [vocabulary.units(t) for t in texts]
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    codes, distinct = pd.factorize(np.array([t for part in tokens for t in part], dtype=object))
    own = _hashes(list(distinct))
    at = np.minimum(np.searchsorted(hashes, own), max(0, len(hashes) - 1))
    known = hashes[at] == own if len(hashes) else np.zeros(len(own), bool)
    first = bounds[at].astype(np.int64)
    n = np.where(known, bounds[at + 1] - first, 0) if len(hashes) else np.zeros(len(own), np.int64)
    alike = np.flatnonzero(known)
    wrong = alike[~_spelt([distinct[k] for k in alike.tolist()], first[alike], n[alike], ids, vocabulary)]
    known[wrong], n[wrong] = False, 0  # another word of the same hash
    if whole and not known.all():
        new = np.flatnonzero(~known)
        more, counts = vocabulary.encode_units([distinct[k] for k in new.tolist()])
        first[new], n[new] = len(ids) + np.cumsum(counts) - counts, counts
        flat = np.empty(int(n[codes].sum()), np.int32)
        place = _ragged(first[codes], n[codes])
        late = place >= len(ids)
        flat[~late], flat[late] = ids[place[~late]], more[place[late] - len(ids)]
        known = np.ones(len(own), bool)
    else:
        flat = ids[_ragged(first[codes], n[codes])].astype(np.int32)
    places = np.concatenate(([0], np.cumsum(n[codes])))
    words_to = np.concatenate(([0], np.cumsum(sizes)))
    ends = places[words_to]
    tails, gaps = [], []
    missing = np.flatnonzero(~known[codes])
    cut = np.searchsorted(missing, words_to)
    for i in range(len(texts)):
        here = missing[cut[i] : cut[i + 1]]
        words, index = np.unique(codes[here], return_inverse=True)
        tails.append([distinct[w] for w in words])
        gaps.append(np.stack([places[here] - ends[i], index], axis=1).astype(np.int32).ravel())
    return flat, ends, tails, gaps


def _joined(ids: list[int], piece: list[bytes]) -> str:
    """The text of the pieces of the ids; unknown ids have none."""
    known = len(piece)
    return b"".join([piece[i] for i in ids if 0 <= i < known]).decode("utf-8", "replace")


def _pieces(path: str) -> list[bytes]:
    found = bpe.Vocabulary(Path(path).read_text(encoding="utf-8")).pieces
    if len(found) > PIECES:
        raise ValueError(f"the vocabulary has {len(found)} pieces, more than {PIECES}")
    return found


def encode(docs: DataFrame, path: str, text: str = "text", into: str = "ids", decoded: str | None = None, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """The documents with the ids of their text in ``into`` (array<int>) and, if wanted, the text decoded from them in ``decoded``."""
    wide = bpe.Vocabulary(Path(path).read_text(encoding="utf-8")).size > 2**16
    table, rest = _broadcast_table(word_table(docs, path, text), table_bytes, wide)
    shared, words = _source(docs, path), docs.sparkSession.sparkContext.broadcast(table)
    piece = docs.sparkSession.sparkContext.broadcast(_pieces(path) if decoded and rest is None else [])
    own = "_bpe"
    while any(c.startswith(own) for c in docs.columns):
        own += "_"
    added = T.StructType([T.StructField(own + n, t) for n, t in (("ids", T.ArrayType(T.IntegerType())), ("tail", T.ArrayType(T.StringType())), ("gaps", T.ArrayType(T.IntegerType())), ("text", T.StringType()))])
    whole = rest is None
    body, decodes = docs.columns.index(text), bool(decoded) and whole

    def lookup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = bpe.vocabulary(shared.value)
        for batch in batches:
            for a, b in spans(pc.binary_length(batch.column(body)).to_pylist(), PIECE):
                part = batch.slice(a, b - a)
                flat, ends, tails, gaps = _positions(part.column(body).to_pylist(), vocabulary, words.value, whole)
                texts = [_joined(flat[x:y].tolist(), piece.value) if decodes else None for x, y in zip(ends, ends[1:])]
                new = [
                    pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat)), pa.array(tails, pa.list_(pa.string())),
                    pa.array(gaps, pa.list_(pa.int32())), pa.array(texts, pa.string()),
                ]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*batch.schema.names, *added.names])

    rows = docs.mapInArrow(lookup, T.StructType([*docs.schema.fields, *added.fields]))
    if rest is not None:
        rows = _filled(rows, rest, own, shared)
    rows = rows.select(*docs.columns, F.col(own + "ids").alias(into), *([F.col(own + "text").alias(decoded)] if decodes else []))
    return decode(rows, path, into, decoded) if decoded and not decodes else rows


def _filled(rows: DataFrame, rest: DataFrame, own: str, source) -> DataFrame:
    """The rows with the ids of their tail words put in place; words that no table has are encoded here."""

    @F.pandas_udf("array<int>")
    def fill(ids: pd.Series, gaps: pd.Series, tail: pd.Series, known: pd.Series) -> pd.Series:
        out, vocabulary = [], bpe.vocabulary(source.value)
        for have, places, names, pairs in zip(ids, gaps, tail, known):
            if len(places):
                of = {p["word"]: np.frombuffer(p["ids"], "<i4") if p["ids"] is not None else None for p in pairs}
                parts, at = [], 0
                for place, k in zip(places[::2], places[1::2]):
                    if of[names[k]] is None:  # occurs once
                        of[names[k]] = vocabulary.encode_units([names[k]])[0]
                    parts += [have[at:place], of[names[k]]]
                    at = place
                have = np.concatenate([*parts, have[at:]])
            out.append(have)
        return pd.Series(out, dtype=object)

    key, known = own + "key", own + "known"
    rows = saved(rows.withColumn(key, F.expr("uuid()")), "positions")  # saved, so the keys are settled
    wanted = rows.select(key, F.explode(own + "tail").alias("word"))
    found = wanted.join(rest.select("word", "ids"), "word", "left").groupBy(key).agg(F.collect_list(F.struct("word", "ids")).alias(known))
    none = F.array().cast("array<struct<word:string,ids:binary>>")
    ids = fill(own + "ids", own + "gaps", own + "tail", F.coalesce(known, none))
    return rows.join(found, key, "left").withColumn(own + "ids", ids)


def decode(rows: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """The rows with the text of their ids in ``into``; the piece of each id comes from the vocabulary."""
    shared = rows.sparkSession.sparkContext.broadcast(_pieces(path))

    @F.pandas_udf("string")
    def join_pieces(lists: pd.Series) -> pd.Series:
        return pd.Series([_joined(x.tolist(), shared.value) if x is not None else "" for x in lists], dtype=object)

    return rows.withColumn(into, join_pieces(F.col(ids)))


def round_trip(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256."""
    rows = encode(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), path, decoded="decoded", **options)
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
