"""Quality by random-indexing word vectors, pooled per document, and a small network.

Random indexing: every word has a fixed sparse vector of +1 and -1, drawn from its hash. The
vector of a word is the sum of the fixed vectors of its neighbours (two on each side) over all
documents, scaled to length one. Words share ``ROWS`` rows by hash, so the table has the same size
for any corpus: each task sums its part and Spark adds up the parts.

A document is pooled over its words (mean vector, and mean product of neighbours, which tells
repetition), and over its runs of punctuation and of capitals (mean fixed vectors and rates). A
network of two layers, written in numpy, is trained on a bounded sample of ``SAMPLE`` labelled
rows, none of them held out; one fold sets the temperature of its probabilities.

Defined results: null and empty texts are pooled to zeros and scored like any other. Without
labelled rows of both classes every score is the smoothed share of good rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvasser.llm.common import pieces
from canvasser.llm.hashing import WORD_BYTES, join_texts, mix, words
from canvasser.llm.samples import TUNING, fold, labelled

SAMPLE = 20_000
ROWS = 1 << 13
SIZE = 32
MARKS = 16  # size of the fixed vectors of punctuation and capitals
HIDDEN = 32
ACCEPT = 0.3

# Bytes of punctuation runs, and of runs of capitals (the letter is left out, the length counts).
PUNCTUATION = np.where((WORD_BYTES == 0) & (np.arange(256) > 32) & (np.arange(256) < 127), np.arange(256), 0).astype(np.uint8)
CAPITALS = np.where((np.arange(256) >= 0x41) & (np.arange(256) <= 0x5A), 1, 0).astype(np.uint8)


def _owner(begins: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.searchsorted(begins, starts, "right") - 1


def fixed_vectors(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sparse vectors drawn from the hashes: two entries of +1 and two of -1 (they may meet)."""
    out = np.zeros((len(hashes), size), np.float32)
    at = np.arange(len(hashes))
    for k in range(4):
        place = (mix(hashes, k + 1) % np.uint64(size)).astype(np.int64)
        np.add.at(out, (at, place), 1.0 if k % 2 == 0 else -1.0)
    return out


def row_vectors() -> np.ndarray:
    """Fixed vectors of all rows."""
    return fixed_vectors(np.arange(ROWS, dtype=np.uint64), SIZE)


def _row(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(ROWS - 1)).astype(np.int64)


def neighbour_sums(texts: list) -> np.ndarray:
    """How often each row stands by each place of the fixed vectors: sums of neighbours' vectors."""
    data, begins = join_texts(texts)
    starts, _, hashes = words(data)
    row, text = _row(hashes), _owner(begins, starts)
    places = np.stack([(mix(np.arange(ROWS, dtype=np.uint64), k + 1) % np.uint64(SIZE)).astype(np.int64) for k in range(4)])
    out = np.zeros(ROWS * SIZE, np.int64)
    for step in (1, 2):
        near = np.flatnonzero(text[step:] == text[:-step]) if len(text) > step else np.zeros(0, np.int64)
        left, right = row[near], row[near + step]
        for k in range(4):
            sign = 1 if k % 2 == 0 else -1
            for a, b in ((left, right), (right, left)):
                out += sign * np.bincount(a * SIZE + places[k][b], minlength=ROWS * SIZE)
    return out.reshape(ROWS, SIZE)


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Vector of each row, from all documents."""
    names = [f"v{i}" for i in range(SIZE)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((ROWS, SIZE), np.int64)
        for batch in batches:
            for a, b in pieces(batch["text"], 8_000_000):
                total += neighbour_sums(list(batch["text"][a:b]))
        used = np.flatnonzero(total.any(axis=1))
        yield pd.DataFrame(total[used], columns=names).assign(row=used)

    parts = docs.select(F.col(text).alias("text")).dropna().mapInPandas(run, ", ".join([*(f"{n} long" for n in names), "row int"]))
    rows = parts.groupBy("row").agg(*[F.sum(n).alias(n) for n in names]).toPandas()
    out = np.zeros((ROWS, SIZE), np.float32)
    values = rows[names].to_numpy(np.float64).reshape(len(rows), SIZE)
    out[rows["row"].to_numpy(np.int64)] = values / np.maximum(np.linalg.norm(values, axis=1, keepdims=True), 1e-9)
    return out


def _mean(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Means of the rows of ``values`` by owner (ascending); zeros for owners without rows."""
    counts = np.bincount(owner, minlength=n)
    out = np.zeros((n, values.shape[1]), np.float32)
    have = np.flatnonzero(counts)
    if len(have):
        out[have] = np.add.reduceat(values, (np.cumsum(counts) - counts)[have], axis=0) / counts[have, None]
    return out


def pool(texts: list, vectors: np.ndarray) -> np.ndarray:
    """One row of numbers per text."""
    data, begins = join_texts(texts)
    n = len(texts)
    starts, _, hashes = words(data)
    text, row = _owner(begins, starts), _row(hashes)
    own = vectors[row]
    fixed = row_vectors()
    near = np.flatnonzero(text[1:] == text[:-1])
    same = (hashes[near] == hashes[near + 1]).astype(np.float32)[:, None]
    count = np.bincount(text, minlength=n)
    mean_fixed = _mean(fixed[row], text, n)
    parts = [
        _mean(own, text, n), _mean(own[near] * own[near + 1], text[near], n), _mean(same, text[near], n),
        np.linalg.norm(mean_fixed, axis=1, keepdims=True), np.log1p(count)[:, None],
    ]
    for table in (PUNCTUATION, CAPITALS):
        s, _, h = words(data, table)
        owner = _owner(begins, s)
        kinds, index = np.unique(h, return_inverse=True)
        parts += [_mean(fixed_vectors(kinds, MARKS)[index], owner, n), (np.bincount(owner, minlength=n) / np.maximum(count, 1))[:, None]]
    return np.concatenate(parts, axis=1).astype(np.float32)


WIDTH = 2 * SIZE + 3 + 2 * (MARKS + 1)


def train(x: np.ndarray, y: np.ndarray, epochs: int = 40, batch: int = 256, rate: float = 3e-3) -> list[np.ndarray]:
    """Weights of a two-layer network (tanh, one logit) by Adam on the logistic loss."""
    draw = np.random.default_rng(7)
    weights = [draw.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), draw.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    first, second, step = [0 * w for w in weights], [0 * w for w in weights], 0
    for _ in range(epochs):
        order = draw.permutation(len(x))
        for a in range(0, len(x), batch):
            part = order[a : a + batch]
            h = np.tanh(x[part] @ weights[0] + weights[1])
            error = (1 / (1 + np.exp(-np.clip(h @ weights[2] + weights[3], -60, 60))) - y[part]) / len(part)
            back = np.outer(error, weights[2]) * (1 - h * h)
            grads = [x[part].T @ back + 1e-4 * weights[0], back.sum(0), h.T @ error + 1e-4 * weights[2], np.array([error.sum()])]
            step += 1
            for i, g in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                weights[i] = weights[i] - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return weights


def logits(x: np.ndarray, weights: list[np.ndarray]) -> np.ndarray:
    return np.tanh(x @ weights[0] + weights[1]) @ weights[2] + weights[3][0]


def temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the least loss, out of a geometric grid."""
    grid = np.geomspace(0.25, 8, 121)
    loss = [np.mean(np.logaddexp(0, z / t) - y * z / t) for t in grid] if len(z) else [0.0]
    return float(grid[int(np.argmin(loss))]) if len(z) else 1.0


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """The model: word vectors, centre, scale, network, temperature (or a constant score)."""
    vectors = word_vectors(docs)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    @F.pandas_udf("binary")
    def pooled(bodies: pd.Series) -> pd.Series:
        parts = [pool(list(bodies[a:b]), shared.value) for a, b in pieces(bodies)]
        return pd.Series([row.tobytes() for part in parts for row in part], dtype=object)

    rows = labelled(docs, labels, "quality", sample).select("doc_id", "label", "fold", pooled("text").alias("x")).toPandas().sort_values("doc_id")
    x = np.frombuffer(b"".join(rows["x"]), np.float32).reshape(len(rows), WIDTH).astype(np.float64)
    y = rows["label"].to_numpy(float)
    tune = rows["fold"].to_numpy() == TUNING
    centre, scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(WIDTH), np.ones(WIDTH))
    if len(set(y[~tune])) < 2:
        share = (y.sum() + 0.5) / (len(y) + 1)
        return vectors, centre, scale, [np.zeros((WIDTH, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), np.array([np.log(share / (1 - share))])], 1.0
    z = np.clip((x - centre) / scale, -8, 8)
    weights = train(z[~tune], y[~tune])
    return vectors, centre, scale, weights, temperature(logits(z[tune], weights), y[tune])


def score(docs: DataFrame, model, text: str = "text", into: str = "score") -> DataFrame:
    """The documents with the probability that the text is good."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def rate(bodies: pd.Series) -> pd.Series:
        vectors, centre, scale, weights, heat = shared.value
        parts = [logits(np.clip((pool(list(bodies[a:b]), vectors) - centre) / scale, -8, 8), weights) for a, b in pieces(bodies)]
        return pd.Series(1 / (1 + np.exp(-np.clip((np.concatenate(parts) if parts else np.zeros(0)) / heat, -500, 500))))

    return docs.withColumn(into, rate(F.coalesce(F.col(text), F.lit(""))))


def report(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT, **options) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    rows = score(docs.select("doc_id", "text"), fit(docs, labels, **options))
    return rows.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= accept).cast("int").alias("predicted"))
