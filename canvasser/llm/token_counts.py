"""Token counts of documents by rank-synchronous merging of ragged numpy arrays.

Texts are only scanned: nothing is shuffled and each row needs nothing but its text. A task
splits a piece of its batch into pre-tokens, merges the distinct ones it does not remember
(``bpe.merge``) and adds up the symbols left per document. What it remembers is bounded by
``REMEMBERED`` pre-tokens.

Defined results: a null text counts as empty and has no tokens. The string of a special token
inside a text is that token. Nothing is truncated or padded.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvasser.llm import bpe
from canvasser.llm.common import pieces

REMEMBERED = 200_000
LIMIT = 1024


def _counts(texts: list, vocabulary: bpe.Vocabulary, seen: dict[str, int]) -> np.ndarray:
    tokens = [vocabulary.split(t) for t in texts]
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    codes, distinct = pd.factorize(np.array([t for part in tokens for t in part], dtype=object))
    fresh = [t for t in distinct if t not in seen]
    if len(seen) + len(fresh) > REMEMBERED:
        seen.clear()
        fresh = list(distinct)
    lengths = dict(zip(fresh, vocabulary.encode(fresh)[1].tolist()))
    per_token = np.array([lengths[t] if t in lengths else seen[t] for t in distinct], np.int64)
    if len(fresh) <= REMEMBERED:
        seen.update(lengths)
    owner = np.repeat(np.arange(len(tokens)), sizes)
    return np.bincount(owner, weights=per_token[codes] if len(codes) else None, minlength=len(tokens)).astype(np.int64)


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_bytes (UTF-8), n_tokens by the vocabulary file ``path``, over_limit."""
    shared = docs.sparkSession.sparkContext.broadcast(Path(path).read_text(encoding="utf-8"))

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vocabulary, seen = bpe.vocabulary(shared.value), {}
        for bodies in batches:
            parts = [_counts(list(bodies[a:b]), vocabulary, seen) for a, b in pieces(bodies)]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0, np.int64))

    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.octet_length(body).cast("long").alias("n_bytes"), count(body).alias("n_tokens"))
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
