"""Similarity of names and the best matching link of a school."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from canvasser import schema as M


def _common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, one bit per character of ``a``."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    open_bits = full
    for ch in b:
        hit = open_bits & where.get(ch, 0)
        open_bits = ((open_bits + hit) | (open_bits - hit)) & full
    return len(a) - open_bits.bit_count()


@lru_cache(maxsize=100_000)
def ratio(a: str | None, b: str | None) -> float | None:
    """200 * LCS / (len a + len b) on trimmed lower-case text; 100 for two empty texts."""
    if a is None or b is None:
        return None
    a, b = a.strip().lower(), b.strip().lower()
    total = len(a) + len(b)
    return 200.0 * _common_length(a, b) / total if total else 100.0


@pandas_udf(DoubleType())
def indel_ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for left, right in pairs:
        yield pd.Series([ratio(a, b) for a, b in zip(left, right)], dtype="float64")


def _grams(c: F.Column, size: int) -> F.Column:
    """All substrings of a given size, as an array (a look-ahead finds overlapping ones)."""
    return F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1))


def _needed_grams(token: F.Column) -> F.Column:
    """Grams each label containing ``token`` must contain: trigrams, or the short token itself."""
    return F.when(F.length(token) >= 3, _grams(token, 3)).otherwise(F.array(token))


# Classes of letters whose counts are compared; every other character is the last class.
_CLASSES = ("a", "e", "i", "o", "u", "nm", "r", "l", "st")
_WIDTH = 6
_MOST = 2**_WIDTH - 1


def _letter_counts(text: F.Column) -> F.Column:
    """Counts of the letter classes in one long, ``_WIDTH`` bits each; null for texts too long for that."""
    counts = [F.length(text) - F.length(F.regexp_replace(text, f"[{letters}]", "")) for letters in _CLASSES]
    counts.append(F.length(text) - sum(counts[1:], counts[0]))
    packed = [F.shiftleft(n.cast("bigint"), _WIDTH * i) for i, n in enumerate(counts)]
    return F.when(F.length(text) <= _MOST, sum(packed[1:], packed[0]))


def _most_common(a: F.Column, b: F.Column) -> F.Column:
    """The longest common subsequence two texts can have by their letter counts."""
    shared = [F.least(*[F.shiftright(x, _WIDTH * i).bitwiseAND(F.lit(_MOST)) for x in (a, b)]) for i in range(len(_CLASSES) + 1)]
    return sum(shared[1:], shared[0])


def fuzzy_best_match(left: DataFrame, right: DataFrame, threshold: float = 70.0, on: Sequence[str] = ()) -> DataFrame:
    """Best label per school name: highest ratio strictly above the threshold, first on ties.

    ``left`` (on..., school_name), ``right`` (on..., label, pos); ``on`` names the scope, as
    the site whose links are compared with the names of its schools. A label qualifies if it
    has at most seven words and contains the second and the last word of the name (some short
    words stand for "high" and "school").

    Equal names and labels are compared once per scope. A label equal to the name is found by
    an equi join, and as nothing beats it, such names need no comparison. For the others, each
    qualifying label contains every three-letter piece of both words: the join runs on the
    piece that the fewest labels of the scope have, and its condition checks the words and the
    best ratio that the two lengths and the counts of their letters allow. So no pair is lost
    and no cap is needed.
    """
    on = list(on)
    same, pairs = candidate_pairs(left, right, threshold, on)
    # Scoring is the expensive step: spread the pairs evenly, whatever block they come from,
    # with equal pairs of different scopes side by side for the cache.
    pairs = pairs.hint("rebalance", "_text", "label")
    # The threshold is applied inside the aggregate: a filter would run the ratio twice.
    scored = pairs.select(*on, "school_name", "label", "pos", indel_ratio("_text", "label").alias("score"))
    rank = F.struct("score", (-F.col("pos")).alias("back"), "label")
    best = scored.groupBy(*on, "school_name").agg(F.max(F.when(F.col("score") > threshold, rank)).alias("b"))
    best = best.filter("b is not null").select(*on, "school_name", "b.label", "b.score")
    return same.unionByName(best)


def candidate_pairs(left: DataFrame, right: DataFrame, threshold: float, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """Names that equal a label, as results; and for the others the pairs that have to be scored."""
    words = F.split(F.lower(F.trim("school_name")), r"\s+")
    short = lambda w, long: F.when(w.isin(M.SCHOOL_ABBREVIATIONS), long).otherwise(w)
    names = left.select(*on, "school_name").distinct().withColumn("_w", words).filter(F.size("_w") >= 2)
    names = names.select(
        *on,
        "school_name",
        F.lower(F.trim("school_name")).alias("_text"),
        short(F.element_at("_w", 2), "high").alias("_first"),
        short(F.element_at("_w", -1), "school").alias("_last"),
    ).withColumn("_name_letters", _letter_counts(F.col("_text")))
    labels = right.select(*on, F.lower(F.trim("label")).alias("label"), "pos").filter(
        (F.col("label") != "") & (F.size(F.split("label", r"\s+")) <= 7)
    )
    labels = labels.groupBy(*on, "label").agg(F.min("pos").alias("pos")).withColumn("_label_letters", _letter_counts(F.col("label")))
    has_words = F.contains("label", "_first") & F.contains("label", "_last")

    same = names.join(labels.withColumn("_text", F.col("label")), [*on, "_text"]).filter(has_words)
    same = same.select(*on, "school_name", "label", F.lit(100.0).alias("score"))
    names = names.join(same.select(*on, "school_name"), [*on, "school_name"], "left_anti")

    grams = F.array_distinct(F.flatten(F.array(*[_grams(F.col("label"), n) for n in (1, 2, 3)])))
    gram_rows = labels.select(*on, "label", "pos", "_label_letters", F.explode(grams).alias("gram"))
    spread = gram_rows.groupBy(*on, "gram").agg(F.count("*").alias("_n"))
    needed = F.array_distinct(F.concat(_needed_grams(F.col("_first")), _needed_grams(F.col("_last"))))
    # A needed piece that no label has rules the name out; the left join keeps it as count 0.
    needs = names.withColumn("gram", F.explode(needed)).join(spread, [*on, "gram"], "left")
    rarest = needs.groupBy(*on, "school_name", "_text", "_first", "_last", "_name_letters").agg(
        F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "gram"))["gram"].alias("gram")
    )
    name_len, label_len = F.length("_text"), F.length("label")
    # 200 * min / (sum) is the highest ratio two lengths allow.
    reachable = 200.0 * F.least(name_len, label_len) > F.lit(threshold) * (name_len + label_len)
    common = _most_common(F.col("_name_letters"), F.col("_label_letters"))
    spelt = F.coalesce(200.0 * common > F.lit(threshold) * (name_len + label_len), F.lit(True))
    pairs = rarest.join(gram_rows, [*on, "gram"]).filter(has_words & reachable & spelt)
    return same, pairs.select(*on, "school_name", "_text", "label", "pos")
