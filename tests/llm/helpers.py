"""Rows that every operator has to take, and small helpers of the tests."""

from __future__ import annotations

import re

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Columns whose names the operators use inside.
CLASHING = ["found", "ids", "id", "tag", "item", "key", "mark", "body", "at", "score", "late", "n", "licenses", "hits", "decoded", "_lines", "own"]


def prose(seed: int, n: int) -> str:
    """Words drawn by a small linear congruence; equal seeds give equal texts."""
    out, x = [], seed * 7919 + 1
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(WORDS[(x >> 8) % len(WORDS)] + str((x >> 16) % 50))
    return " ".join(out)


def rows(texts: list) -> list[tuple]:
    return [(k, t, "en", "s", len(t) if t else 0) for k, t in enumerate(texts)]


def odd_rows() -> list[tuple]:
    """Nulls in every column, empty and very long texts, ties, repeated rows, one id for two texts."""
    long = prose(3, 60_000)
    return [
        (None, None, None, None, None), (None, prose(9, 30), None, "s", 0), (1, None, "en", "s", 0), (2, "", "en", "s", 0),
        (3, "  \n\n ", "en", None, 5), (4, "one", "en", "s", 3), (5, "one", "en", "s", 3), (6, prose(1, 80), "en", "s", 0),
        (6, prose(1, 80), "en", "s", 0), (7, prose(1, 80), "en", "s", 0), (8, long, "en", "s", 0), (9, "x" * 200_000, "en", "s", 0),
        (10, prose(4, 50), "en", "s", 0), (10, prose(5, 50), "en", "s", 0), (11, "naïve Ünïcode 漢字 \U0001f600 <|endoftext|> 's", "fr", "s", 0),
    ]


def clashing(docs):
    """The documents with further columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    return docs.withColumns({c: F.lit("own") for c in CLASHING if c not in docs.columns})


def plain_words(text: str | None) -> list[str]:
    folded = (text or "").translate({i: i + 32 for i in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)
