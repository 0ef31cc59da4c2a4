"""Toxicity by class-conditional Kneser-Ney models with a shared backoff.

For each class c the probability of a word w is that of an interpolated Kneser-Ney model:

    P_c(w) = max(N_c(w) - D, 0) / N_c  +  D * types_c / N_c * P_c(b) * n(w) / n(b)
    P_c(b) = max(N_c(b) - D, 0) / N_c  +  D * begins_c / N_c * n(b) / n

b is the beginning of w, its first ``BEGIN`` characters (letter case is folded). N_c(w) counts the
distinct words seen before w in texts of class c, N_c(b) those before all words of this beginning;
n are the frequencies in all documents, shared by both classes, so a rare word costs both the same.
A word whose class counts are both at most D, such as a new form of a known one, takes the ratio of
its beginning; if that is as rare, its ratio is that of the backoff weights and says nothing.

A text is scored by the log ratio of the toxic and the ordinary model, normalised by length:
over the whole text and over its strongest passage of 1, 3, 10 and 30 words. Logistic weights,
fitted on a fold the counts have not seen, turn these into a probability.

Counted over everything: the shared frequencies (all documents). Fitted on a bounded sample: the
class counts and the weights (``SAMPLE`` labelled rows at most, none of them held out). The
broadcast model has one number for each word and each beginning with more than D class contexts,
``WORDS`` of either at most; beyond that those with the most contexts are kept and the others back off.

Defined results: null and empty texts have ratio 0 everywhere and get the score of that. Without
labelled rows of both classes every score is the smoothed share of toxic rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvasser.llm.common import pieces, saved
from canvasser.llm.hashing import beginnings, join_texts, words
from canvasser.llm.samples import TUNING, fold, labelled

SAMPLE = 50_000
WORDS = 2_000_000
DISCOUNT = 2.5
BEGIN = 4
CLASSES = ("ordinary", "toxic")
PASSAGES = (1, 3, 10, 30)


def _words(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all texts, the text of each, and the hashes of their beginnings."""
    data, begins = join_texts([t.lower() if t else t for t in texts])
    starts, ends, hashes = words(data)
    begin = beginnings(data, starts, ends, BEGIN)
    return hashes.view(np.int64), np.searchsorted(begins, starts, "right") - 1, begin.view(np.int64)


def shared_counts(docs: DataFrame) -> DataFrame:
    """Occurrences of every word, and of every beginning, in all documents: word (hash), n."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a, b in pieces(batch["text"], 8_000_000):
                word, _, begin = _words(list(batch["text"][a:b]))
                for found in (word, begin):
                    key, n = np.unique(found, return_counts=True)
                    yield pd.DataFrame({"word": key, "n": n})

    return docs.select("text").dropna().mapInPandas(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def class_counts(sample: DataFrame) -> DataFrame:
    """Distinct left neighbours of each word by class: word, begin, ordinary, toxic."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a, b in pieces(batch["text"]):
                word, text, begin = _words(list(batch["text"][a:b]))
                before = np.zeros_like(word)
                before[1:] = np.where(text[1:] == text[:-1], word[:-1], 0)
                label = batch["label"].to_numpy()[a:b].astype(np.int32)[text]
                yield pd.DataFrame({"word": word, "begin": begin, "before": before, "label": label}).drop_duplicates()

    pairs = sample.select("text", "label").mapInPandas(run, "word long, begin long, before long, label int").distinct()
    each = [F.count(F.when(F.col("label") == k, 1)).alias(name) for k, name in enumerate(CLASSES)]
    return pairs.groupBy("word").agg(F.min("begin").alias("begin"), *each)


def _weights(counts: DataFrame, discount: float) -> tuple[list[int], list[float]]:
    """Contexts in all and the weight of the backoff, by class."""
    sums = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in CLASSES], *[F.count(F.when(F.col(c) > 0, 1)) for c in CLASSES]).first()
    return [sums[0], sums[1]], [min(1.0, discount * sums[2 + k] / max(sums[k], 1)) for k in (0, 1)]


def _kept(counts: DataFrame, key: str, shared: DataFrame, discount: float, most: int) -> pd.DataFrame:
    """Counts and shared frequency n of the keys with more than ``discount`` contexts, ``most`` at most."""
    weight = F.greatest(*CLASSES)
    top = counts.filter(weight > discount).orderBy(F.desc(weight), key).limit(most)
    return shared.select(F.col("word").alias(key), "n").join(top, key).toPandas()


def ratios(counts: DataFrame, shared: DataFrame, discount: float, most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Words and beginnings (sorted hashes), their log ratio, and the ratio of all other words."""
    total, back = _weights(counts, discount)
    if not total[0] or not total[1]:
        return np.zeros(0, np.int64), np.zeros(0), 0.0
    begins = counts.groupBy("begin").agg(*[F.sum(c).alias(c) for c in CLASSES])
    spread = _weights(begins, discount)[1]
    all_words = shared.agg(F.sum("n")).first()[0] / 2  # every word has one beginning

    def own(rows: pd.DataFrame, k: int) -> pd.Series:
        return np.maximum(rows[CLASSES[k]] - discount, 0) / total[k]

    low = _kept(begins, "begin", shared, discount, most)
    p = [own(low, k) + spread[k] * low["n"] / all_words for k in (0, 1)]
    low = pd.DataFrame({"begin": low["begin"], "ordinary_each": p[0] / low["n"], "toxic_each": p[1] / low["n"]})
    top = _kept(counts, "word", shared, discount, most).merge(low, on="begin")
    q = [own(top, k) + back[k] * top["n"] * top[f"{c}_each"] for k, c in enumerate(CLASSES)]
    none = np.log(back[1] / back[0])
    known = np.concatenate([top["word"].to_numpy(np.int64), low["begin"].to_numpy(np.int64)])
    ratio = np.concatenate([np.log(q[1] / q[0]), none + np.log(p[1] / p[0])])
    order = np.argsort(known)
    return known[order], ratio[order], float(none + np.log(spread[1] / spread[0]))


def features(texts: list, model: tuple[np.ndarray, np.ndarray, float]) -> np.ndarray:
    """Length-normalised log ratios of each text: whole, then its strongest passage of each length."""
    known, ratio, other = model
    word, text, begin = _words(texts)
    values = np.full(len(word), other)
    for key in (begin, word) if len(known) else ():  # what is known of a word goes before its beginning
        at = np.minimum(np.searchsorted(known, key), len(known) - 1)
        hit = known[at] == key
        values[hit] = ratio[at[hit]]
    sums = np.concatenate(([0.0], np.cumsum(values)))
    n = np.bincount(text, minlength=len(texts))
    first = np.cumsum(n) - n
    out = np.zeros((len(texts), 1 + len(PASSAGES)))
    out[:, 0] = (sums[first + n] - sums[first]) / np.maximum(n, 1)
    for k, size in enumerate(PASSAGES, 1):
        long = np.flatnonzero(n >= size)
        out[:, k] = out[:, 0]  # a text shorter than the passage is one passage
        if len(long):
            passage = np.append((sums[size:] - sums[:-size]) / size, -np.inf)
            bounds = np.stack([first[long], first[long] + n[long] - size + 1], axis=1).ravel()
            out[long, k] = np.maximum.reduceat(passage, bounds)[::2]
    return out


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centre, scale and weights (the first is the constant) of a ridge logistic regression."""
    centre, scale = (x.mean(0), x.std(0) + 1e-9) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    z = np.concatenate([np.ones((len(x), 1)), (x - centre) / scale], axis=1)
    w = np.zeros(z.shape[1])
    share = (y.sum() + 0.5) / (len(y) + 1)
    w[0] = np.log(share / (1 - share))
    if 0 < y.sum() < len(y):
        penalty = np.diag([1e-6] + [1.0] * x.shape[1])
        for _ in range(rounds):
            p = probability(z @ w)
            w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (p - y) + penalty @ w)
    return centre, scale, w


def probability(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, discount: float = DISCOUNT, most: int = WORDS):
    """The model as (ratios, logistic weights)."""
    chosen = saved(labelled(docs, labels, "toxic", sample), "toxic-sample")
    counts = saved(class_counts(chosen.filter(F.col("fold") != TUNING)), "toxic-counts")
    model = ratios(counts, saved(shared_counts(docs), "word-counts"), discount, most)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<double>")
    def measure(bodies: pd.Series) -> pd.Series:
        parts = [features(list(bodies[a:b]), shared.value) for a, b in pieces(bodies)]
        return pd.Series([row for part in parts for row in part], dtype=object)

    rows = chosen.filter(F.col("fold") == TUNING).select("label", measure("text").alias("x")).toPandas()
    x = np.array([list(v) for v in rows["x"]]).reshape(len(rows), 1 + len(PASSAGES))
    return model, logistic(x, rows["label"].to_numpy(float))


def score(docs: DataFrame, model, text: str = "text", into: str = "score") -> DataFrame:
    """The documents with the probability that the text is toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def rate(bodies: pd.Series) -> pd.Series:
        words_of, (centre, scale, w) = shared.value
        parts = [features(list(bodies[a:b]), words_of) for a, b in pieces(bodies)]
        x = np.concatenate(parts) if parts else np.zeros((0, 1 + len(PASSAGES)))
        return pd.Series(probability(w[0] + ((x - centre) / scale) @ w[1:]))

    return docs.withColumn(into, rate(F.coalesce(F.col(text), F.lit(""))))


def report(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    rows = score(docs.select("doc_id", "text"), fit(docs, labels, **options))
    return rows.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
