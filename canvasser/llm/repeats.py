"""Exact removal of byte strings that occur earlier, by prefix doubling on ranks of positions.

A byte goes if a string of ``length`` bytes that covers it also starts earlier (smaller doc_id, or
same document and smaller place). Ranks are hashes of the strings, so equal strings have equal
ranks wherever they are computed. A round sorts positions by pairs of ranks, drops what is
unique, and goes on to longer strings with the rest:

1. Rank of ``gram`` bytes. Every string of ``length`` bytes is represented by the gram of the least
   rank in it, so equal strings have the same representative at the same place. Only these
   positions (one in 35 at 100 bytes) are rows; one row per byte would shuffle 25 times the input.
2. Pair of that rank and the rank of all the strings the gram represents side by side (a run,
   100 to 172 bytes). Later equal pairs are past the threshold: their whole run is removed. If the
   gram is unique, or all its runs are equal, the first run needs no further round.
3. Runs that are left share the gram but not the run (edges of repeats). Their bytes are dealt by
   gram, and every string in them is compared by the pair of ranks of its two halves.

Hot strings: within a batch all but the first of equal runs are settled at once, and further runs
of a shared gram are dealt by run, so a passage of a third of all documents is one or two rows per
batch. In round 3 a gram with more than ``HOT`` runs hands its strings on to be dealt one by one.
The text of a document is shuffled once and used twice.

Defined results: a null text is empty; nothing is removed from texts shorter than ``length``. A
null doc_id ranks last. Rows that repeat id and text are the same document and get the same
result; texts that share an id are ordered by a hash of the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canvasser.llm.common import LAST, pieces, rank_id, saved
from canvasser.llm.hashing import PIECE, mix, prefix_sums, slice_hashes

LENGTH = 100
HOT = 20_000
_PLACE = np.uint64((1 << 22) - 1)
UNIQUE, SHARED, SETTLED = 0, 1, 2
_LOW = 2**32 - 1


def gram_size(length: int) -> int:
    return max(1, length * 28 // 100)


def least_in_windows(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, from block-wise running minima."""
    n = len(values) - width + 1
    padded = np.concatenate((values, np.full(-len(values) % width, np.iinfo(values.dtype).max, values.dtype))).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def _parts(bodies: list[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (document, place, bytes) of about PIECE bytes; longer documents are cut with an overlap."""
    held, size = [], 0
    for d, body in enumerate(bodies):
        for at in range(0, max(0, len(body) - length + 1), PIECE):
            part = body[at : at + PIECE + length - 1]
            if held and size + len(part) > PIECE:
                yield held
                held, size = [], 0
            held.append((d, at, part))
            size += len(part)
    if held:
        yield held


def runs(bodies: list[bytes], length: int) -> dict[str, np.ndarray]:
    """Runs of strings with one representative: doc, start, n (strings), gram and run (ranks)."""
    gram = gram_size(length)
    found: list[tuple] = []
    for part in _parts(bodies, length):
        raw = np.frombuffer(b"".join(p[2] for p in part), np.uint8)
        sizes = np.array([len(p[2]) for p in part])
        sums = prefix_sums(raw)
        at = np.arange(len(raw) - gram + 1)
        rank = slice_hashes(sums, at, at + gram)
        place = (least_in_windows((rank & ~_PLACE) | at.astype(np.uint64), length - gram + 1) & _PLACE).astype(np.int64)
        owner = np.repeat(np.arange(len(part)), sizes)
        first = np.flatnonzero(owner[: len(place)] == owner[length - 1 :])
        cut = np.flatnonzero((np.diff(place[first]) != 0) | (np.diff(first) != 1)) + 1
        a, z = first[np.concatenate(([0], cut))], first[np.concatenate((cut - 1, [len(first) - 1]))]
        begins = np.cumsum(sizes) - sizes
        whose = owner[a]
        found.append((
            np.array([p[0] for p in part])[whose], np.array([p[1] for p in part])[whose] + a - begins[whose],
            z - a + 1, rank[place[a]], slice_hashes(sums, a, z + length),
        ))
    columns = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64)]
    return dict(zip(("doc", "start", "n", "gram", "run"), columns))


def _first_of(keys: np.ndarray) -> np.ndarray:
    """Marks the first of equal keys."""
    out = np.zeros(len(keys), bool)
    out[np.unique(keys, return_index=True)[1]] = True
    return out


def _joined(doc: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Number of the stretch of adjacent runs each run (in order) belongs to."""
    apart = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + n[:-1])
    return np.concatenate(([0], np.cumsum(apart))) if len(doc) else np.zeros(0, np.int64)


def _batch_rows(batch: pd.DataFrame, length: int) -> pd.DataFrame:
    """Rows of rounds 1 and 2 of one batch of documents: key, run, id, at, n, kind."""
    batch = batch.drop_duplicates(["id", "tag"]).sort_values(["id", "tag"])
    found: list[dict] = []
    for a, b in pieces(batch["body"]):
        part = runs([t.encode("utf-8", "surrogatepass") for t in batch["body"].iloc[a:b]], length)
        part["doc"] = part["doc"] + a
        found.append(part)
    r = {k: np.concatenate([p[k] for p in found]) for k in found[0]} if found else runs([], length)
    ids = batch["id"].to_numpy(np.int64)
    tags = batch["tag"].to_numpy(np.int64) & _LOW
    at = ((tags[r["doc"]].astype(np.uint64) << np.uint64(32)) | r["start"].astype(np.uint64)).view(np.int64)
    with np.errstate(over="ignore"):
        own = mix(r["gram"] ^ (r["run"] * np.uint64(0x9E3779B97F4A7C15)))
    leads = _first_of(own)
    grams, index, uses = np.unique(r["gram"][leads], return_inverse=True, return_counts=True)
    shared = uses[index] > 1
    key = np.where(shared & ~_first_of(r["gram"][leads]), own[leads], r["gram"][leads]) if len(grams) else own[leads]
    out = [pd.DataFrame({
        "key": key.view(np.int64), "run": r["run"][leads].view(np.int64), "id": ids[r["doc"][leads]], "at": at[leads],
        "n": r["n"][leads], "kind": np.where(shared, SHARED, UNIQUE),
    })]
    late = np.flatnonzero(~leads)
    if len(late):
        stretch = _joined(r["doc"][late], r["start"][late], r["n"][late])
        begin = late[np.flatnonzero(np.diff(stretch, prepend=-1))]
        total = np.bincount(stretch, weights=r["n"][late]).astype(np.int64)
        spread = mix(at[begin].view(np.uint64) ^ mix(ids[r["doc"][begin]].view(np.uint64)), 5).view(np.int64)
        out.append(pd.DataFrame({"key": spread, "run": 0, "id": ids[r["doc"][begin]], "at": at[begin], "n": total, "kind": SETTLED}))
    return pd.concat(out)


def _not_first(partition: list[str]):
    """True for rows behind the first position of their partition."""
    first = F.first(F.struct("id", "at")).over(Window.partitionBy(*partition).orderBy("id", "at"))
    return F.struct("id", "at") != first


def settle_runs(texts: DataFrame, length: int) -> DataFrame:
    """Rounds 1 and 2: (id, at, n, open) of runs to remove and of runs that stay open."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield _batch_rows(batch, length)

    rows = texts.select("id", "tag", F.col("text").alias("body")).mapInPandas(run, "key long, run long, id long, at long, n long, kind int")
    rows = rows.withColumn("n", F.col("n").cast("int")).withColumn("kind", F.col("kind").cast("byte"))
    by_key = Window.partitionBy("key")
    rows = rows.select(
        "id", "at", "n", ((F.col("kind") == SETTLED) | _not_first(["key", "run"])).alias("gone"),
        ((F.max("kind").over(by_key) == SHARED) | (F.min("run").over(by_key) != F.max("run").over(by_key))).alias("open"),
    )
    return rows.filter("gone OR open").select("id", "at", "n", (~F.col("gone")).alias("open"))


def _per_text(rows: DataFrame) -> DataFrame:
    """Spans of each text as two arrays in order: (id, tag, starts, sizes)."""
    tag = F.shiftright("at", 32).cast("int")
    start = F.col("at").bitwiseAND(F.lit(_LOW))
    lists = rows.groupBy("id", tag.alias("tag")).agg(F.sort_array(F.collect_list(F.struct(start.alias("start"), F.col("n")))).alias("spans"))
    return lists.select("id", "tag", F.col("spans.start").alias("starts"), F.col("spans.n").alias("sizes")).hint("shuffle_hash")


def _open_bytes(texts: DataFrame, open_runs: DataFrame, length: int) -> DataFrame:
    """Bytes of the open runs with their gram: (gram, id, at, body)."""
    gram = gram_size(length)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for id_, tag, text, starts, sizes in batch.itertuples(index=False, name=None):
                raw = text.encode("utf-8", "surrogatepass")
                for s, n in zip(starts.tolist(), sizes.tolist()):
                    body = raw[s : s + n + length - 1]
                    # The representative is in all strings of the run, so in their common part.
                    sums = prefix_sums(np.frombuffer(body, np.uint8)[n - 1 : length])
                    at = np.arange(len(sums) - gram)
                    rank = slice_hashes(sums, at, at + gram)
                    key = rank[int(np.argmin(rank & ~_PLACE))]
                    rows.append((int(key.astype(np.int64)), id_, ((tag & _LOW) << 32 | s) - (2**64 if tag < 0 else 0), body))
            yield pd.DataFrame(rows, columns=["gram", "id", "at", "body"])

    joined = texts.join(_per_text(open_runs), ["id", "tag"]).select("id", "tag", "text", "starts", "sizes")
    return joined.mapInPandas(run, "gram long, id long, at long, body binary")


def _strings(rows: pd.DataFrame, length: int) -> tuple[np.ndarray, ...]:
    """Row, place and the ranks of the halves of every string in the rows."""
    sizes = rows["body"].map(len).to_numpy(np.int64)
    sums = prefix_sums(np.frombuffer(b"".join(rows["body"]), np.uint8))
    n = sizes - length + 1
    row = np.repeat(np.arange(len(rows)), n)
    place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    at = (np.cumsum(sizes) - sizes)[row] + place
    half = length // 2
    return row, place, slice_hashes(sums, at, at + half), slice_hashes(sums, at + half, at + length)


def _settled_strings(rows: pd.DataFrame, length: int) -> pd.DataFrame:
    """Strings of whole grams that are not the first of their kind, as stretches (left, right, id, at, n, kind)."""
    rows = rows.drop_duplicates(["gram", "id", "at"]).sort_values(["id", "at"])
    row, place, left, right = _strings(rows, length)
    ids, ats = rows["id"].to_numpy(np.int64)[row], rows["at"].to_numpy(np.int64)[row] + place
    order = np.argsort(mix(left ^ mix(right, 3)), kind="stable")
    same = (left[order][1:] == left[order][:-1]) & (right[order][1:] == right[order][:-1])
    pair = (ids[order][1:] != ids[order][:-1]) | (ats[order][1:] != ats[order][:-1])
    late = np.zeros(len(row), bool)
    late[order[1:][same & pair]] = True
    late = np.flatnonzero(late)
    stretch = _joined(row[late], place[late], np.ones(len(late), np.int64))
    begin = late[np.flatnonzero(np.diff(stretch, prepend=-1))] if len(late) else late
    spread = mix(ats[begin].view(np.uint64) ^ mix(ids[begin].view(np.uint64)), 6).view(np.int64)
    return pd.DataFrame({"left": spread, "right": 0, "id": ids[begin], "at": ats[begin], "n": np.bincount(stretch, minlength=len(begin)).astype(np.int64), "kind": SETTLED})


def _open_strings(rows: pd.DataFrame, length: int) -> pd.DataFrame:
    row, place, left, right = _strings(rows, length)
    return pd.DataFrame({
        "left": left.view(np.int64), "right": right.view(np.int64), "id": rows["id"].to_numpy(np.int64)[row],
        "at": rows["at"].to_numpy(np.int64)[row] + place, "n": 1, "kind": UNIQUE,
    })


def settle_strings(bodies: DataFrame, length: int, hot: int) -> DataFrame:
    """Round 3: stretches (id, at, n) of strings that start earlier elsewhere."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest, current_hot = [], None  # rows of the last gram; the gram that is handed on
        for batch in batches:
            if not len(batch):
                continue
            grams = batch["gram"].to_numpy()
            if current_hot is not None:
                k = int(np.argmin(grams == current_hot)) if not (grams == current_hot).all() else len(grams)
                if k:
                    yield _open_strings(batch.iloc[:k], length)
                batch, grams = batch.iloc[k:], grams[k:]
                if not len(batch):
                    continue
                current_hot = None
            k = int(np.searchsorted(grams, grams[-1]))  # sorted by gram
            whole = [*rest, batch.iloc[:k]] if not rest or k or rest[-1]["gram"].iloc[-1] != grams[0] else []
            if whole and sum(map(len, whole)):
                yield from _by_size(pd.concat(whole, ignore_index=True), length, hot)
                rest = []
            rest.append(batch.iloc[k:])
            if sum(map(len, rest)) > hot:
                current_hot = grams[-1]
                for part in rest:
                    yield _open_strings(part, length)
                rest = []
        if rest:
            yield from _by_size(pd.concat(rest, ignore_index=True), length, hot)

    rows = bodies.repartition("gram").sortWithinPartitions("gram").mapInPandas(run, "left long, right long, id long, at long, n long, kind int")
    gone = (F.col("kind") == SETTLED) | _not_first(["left", "right"])
    return rows.select("id", "at", "n", gone.alias("gone")).filter("gone").select("id", "at", F.col("n").cast("int").alias("n"))


def _by_size(rows: pd.DataFrame, length: int, hot: int) -> Iterator[pd.DataFrame]:
    """Whole grams: some rows at a time; a gram above the limit is handed on."""
    grams = rows["gram"].to_numpy()
    bounds = np.concatenate(([0], np.flatnonzero(grams[1:] != grams[:-1]) + 1, [len(rows)]))
    begin = 0
    while begin < len(bounds) - 1:
        end = begin + 1
        while end < len(bounds) - 1 and bounds[end + 1] - bounds[begin] <= 10_000:
            end += 1
        part = rows.iloc[bounds[begin] : bounds[end]]
        yield _open_strings(part, length) if len(part) > hot else _settled_strings(part, length)
        begin = end


def find_repeats(docs: DataFrame, length: int = LENGTH, hot: int = HOT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, tag, text, starts, sizes): the strings of each text that start earlier, as stretches of starts.

    A stretch of n starts covers n + length - 1 bytes.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    texts = docs.select(rank_id(doc_id).alias("id"), F.hash(body).alias("tag"), body.alias("text"))
    settled = saved(settle_runs(texts, length), "runs")
    bodies = _open_bytes(texts, settled.filter("open"), length)
    gone = settled.filter("NOT open").select("id", "at", "n").unionByName(settle_strings(bodies, length, hot))
    return texts.join(_per_text(gone), ["id", "tag"], "left")


def _spans(starts, sizes, length: int) -> list[tuple[int, int]]:
    """Maximal removed byte runs."""
    out: list[list[int]] = []
    for s, n in zip(starts.tolist(), sizes.tolist()) if starts is not None else ():
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s + n + length - 1)
        else:
            out.append([s, s + n + length - 1])
    return [tuple(x) for x in out]


def _kept(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    ends = [0, *(z for _, z in spans)]
    return b"".join([raw[a:b] for a, b in zip(ends, [*(a for a, _ in spans), len(raw)])])


def remove_repeats(docs: DataFrame, length: int = LENGTH, hot: int = HOT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, spans, kept): removed byte spans (start and end in turn) and the bytes left."""
    found = find_repeats(docs, length, hot, doc_id, text)

    @F.pandas_udf("n_bytes long, spans array<int>, kept binary")
    def cut(bodies: pd.Series, starts: pd.Series, sizes: pd.Series) -> pd.DataFrame:
        rows = []
        for body, s, n in zip(bodies, starts, sizes):
            raw, spans = body.encode("utf-8", "surrogatepass"), _spans(s, n, length)
            rows.append((len(raw), [x for span in spans for x in span], _kept(raw, spans)))
        return pd.DataFrame(rows, columns=["n_bytes", "spans", "kept"])

    rows = found.select(F.when(F.col("id") != LAST, F.col("id")).alias("doc_id"), cut("text", "starts", "sizes").alias("cut"))
    return rows.select("doc_id", "cut.*")


def report(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    rows = remove_repeats(docs, **options)
    return rows.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        (F.size("spans") / 2).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )
