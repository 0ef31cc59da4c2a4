"""First / last row per key, ordered folds and neighbours, without whole groups in one task.

``row_number() <= n`` keeps at most n rows per key on each map task before the shuffle
(Spark's window group limit), so a hot key never reaches one task as a whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from canvasser.functions.text import strip
from canvasser.session import fresh_path

_LOWEST = -(2**63) + 1


def top_n_per_key(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column], n: int, rank: str | None = None) -> DataFrame:
    """The n first rows of each key in the given total order; ``rank`` names a rank column."""
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    out = out.filter(F.col(name) <= n)
    return out if rank else out.drop(name)


def slice_of_order(df: DataFrame, order: Sequence[str | Column], start: int, size: int, deep: int = 100_000) -> DataFrame:
    """Rows start ... start + size of a totally ordered table.

    Up to ``deep`` rows the front of the order is taken as it is. Beyond that the rows are sorted
    in ranges once (written to the shared folder) and counted per range; the wanted positions are
    then intervals of a row number that grows with the order, so only those rows are read again
    and no task handles the rows before them.
    """
    if start + size <= deep:
        return df.orderBy(*order).offset(start).limit(size)
    path = fresh_path(df.sparkSession, "ordered")
    # A number per row: its range in the high bits, its place in the range in the low 33.
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    ranged.write.parquet(path)
    rows = df.sparkSession.read.schema(ranged.schema).parquet(path)
    counts = rows.groupBy(F.shiftright("_at", 33).alias("r")).count().orderBy("r").collect()  # one row per range
    wanted, before = F.lit(False), 0
    for r, n in counts:
        low, high = max(start - before, 0), min(start + size - before, n)
        if low < high:
            wanted = wanted | F.col("_at").between((r << 33) + low, (r << 33) + high - 1)
        before += n
    return rows.filter(wanted).orderBy("_at").drop("_at")


def latest_per_key(df: DataFrame, keys: Sequence[str], *seq: str) -> DataFrame:
    """Last row per key wins; ``seq`` must order rows of a key totally."""
    return top_n_per_key(df, list(keys), [F.desc(s) for s in seq], 1)


def first_per_key(df: DataFrame, keys: Sequence[str], *seq: str) -> DataFrame:
    """First row per key wins."""
    return top_n_per_key(df, list(keys), [F.asc(s) for s in seq], 1)


def next_in_key(
    df: DataFrame, keys: Sequence[str], seq: str, out: str, marked: Column | None = None, span: int = 65_536
) -> DataFrame:
    """Add the next larger ``seq`` of the same key as ``out`` (null at the end).

    With ``marked`` only rows meeting that condition count as next. ``seq`` is a whole number
    unique per key. A key is cut into stretches of ``span`` numbers: neighbours are found
    inside a stretch, and for the rest the first marked number of the stretches behind it is
    taken from a table that is up to ``span`` times smaller.
    """
    point = F.col(seq) if marked is None else F.when(marked, F.col(seq))
    cut = df.withColumns({"_cut": F.floor(F.col(seq) / span), "_point": point})
    # Running minimum from the end of the stretch: linear, unlike a frame that looks ahead.
    behind = W.partitionBy(*keys, "_cut").orderBy(F.desc(seq)).rowsBetween(W.unboundedPreceding, -1)
    inner = cut.withColumn(out, F.min("_point").over(behind))
    starts = cut.groupBy(*keys, "_cut").agg(F.min("_point").alias("_start"))
    later = W.partitionBy(*keys).orderBy(F.desc("_cut")).rowsBetween(W.unboundedPreceding, -1)
    starts = starts.withColumn("_follow", F.min("_start").over(later)).drop("_start")
    joined = inner.join(starts, [*keys, "_cut"], "left")
    return joined.withColumn(out, F.coalesce(out, "_follow")).drop("_cut", "_follow", "_point")


def fold_preferred_website(df: DataFrame, keys: Sequence[str], seq: str, site: str, out: str) -> DataFrame:
    """Per key, the address left by folding ``preferred_website`` over rows in ``seq`` order.

    The fold depends on the order and is not associative, yet its result has a closed form:

    * a secure address survives when no longer plain address follows it; of the survivors
      the longest wins, and of equals the first;
    * without a survivor it is the longest plain address behind the last secure one, again
      the first of equals.

    So per key only one row per address length is gathered (addresses are short), and the
    rows themselves are never collected: one pass finds the winning kind, length and start,
    a second one the first row that fits.
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(seq).cast("bigint").alias("_seq"), strip(site).alias("_url"))
    rows = rows.filter("_url <> ''").withColumns(
        {"_secure": F.col("_url").startswith("https://"), "_len": F.length("_url")}
    )
    by_length = rows.groupBy(*keys, "_len").agg(
        F.max(F.when(F.col("_secure"), F.col("_seq"))).alias("_last_secure"),
        F.max(F.when(~F.col("_secure"), F.col("_seq"))).alias("_last_plain"),
    )
    longer = W.partitionBy(*keys).orderBy(F.desc("_len")).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*keys).orderBy(F.desc("_len")).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    lowest = F.lit(_LOWEST)
    by_length = by_length.withColumns(
        {
            "_bar": F.coalesce(F.max("_last_plain").over(longer), lowest),
            "_end": F.coalesce(F.max("_last_secure").over(whole), lowest),
        }
    )
    survives = F.col("_last_secure") > F.col("_bar")
    trails = F.col("_last_plain") > F.col("_end")
    verdict = by_length.groupBy(*keys).agg(
        F.max(F.when(survives, F.struct("_len", F.col("_bar").alias("_after")))).alias("_s"),
        F.max(F.when(trails, F.struct("_len", F.col("_end").alias("_after")))).alias("_p"),
    )
    verdict = verdict.select(
        *keys,
        F.col("_s").isNotNull().alias("_w_secure"),
        F.coalesce("_s", "_p").alias("_w"),
    )
    fits = (
        (F.col("_secure") == F.col("_w_secure"))
        & (F.col("_len") == F.col("_w._len"))
        & (F.col("_seq") > F.col("_w._after"))
    )
    return (
        rows.join(verdict, keys)
        .filter(fits)
        .groupBy(*keys)
        .agg(F.min_by("_url", "_seq").alias(out))
    )
