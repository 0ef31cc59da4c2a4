"""Incremental runs: new files in, tables out, progress kept in checkpoints.

Two kinds of result:

* Spark's state store holds the running value of each key, and every micro-batch writes the rows
  that changed to a folder named by its number (``write_changes``). The current table is a view:
  the newest row of each key (``newest``). Nothing is read back to write, and a batch that comes
  again replaces its own folder.
* ``upsert_sink`` merges a batch into a stored table whose rows must be read to be merged. The
  merged table goes to the folder of the batch, and one pointer says which folder is live.

Folders of former batches stay; what removes old files of the storage may remove them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from canvasser.functions.ordering import first_per_key, slice_of_order
from canvasser.operators.merge import merge_upsert
from canvasser.streaming.cursor import CursorSource

BATCH = "at_batch"


def read_parquet_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_run: int = 50, pattern: str | None = None) -> DataFrame:
    """File stream of Parquet data; at most ``files_per_run`` new files per micro-batch.

    The path may be a folder or one file. A plain path is turned into a glob, as the file
    source takes a plain path for a folder.
    """
    if not any(ch in path for ch in "*?[{"):
        path = f"{path[:-1]}[{path[-1]}]"
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_run)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(path)


def _start(stream: DataFrame, step, checkpoint: str, mode: str = "append", every: str | None = None) -> StreamingQuery:
    """Run over everything new and stop, or with ``every`` keep running on a timer."""
    trigger = {"processingTime": every} if every else {"availableNow": True}
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    return writer.foreachBatch(step).trigger(**trigger).start()


def _found(read) -> DataFrame | None:
    """What ``read`` gives, or None if there is no such path yet."""
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


# Changed rows, and views over them


def write_changes(rows: DataFrame, batch_id: int, path: str) -> None:
    """The rows of a micro-batch in the folder of its number; again gives the same folder."""
    rows.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")


def read_changes(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All rows written so far with the number of their batch."""
    full = T.StructType([*schema.fields, T.StructField(BATCH, T.LongType())])
    rows = _found(lambda: spark.read.schema(full).option("basePath", path).parquet(f"{path}/{BATCH}=*"))
    return rows if rows is not None else spark.createDataFrame([], full)


def newest(spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str]) -> DataFrame:
    """The row of each key from the last batch that wrote it (one a batch): one aggregate with a map-side part."""
    rows = read_changes(spark, path, schema)
    columns = schema.fieldNames()
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), BATCH).alias("_row"))
    return last.select(*[F.col("_row")[c].alias(c) for c in columns])


def activity_counts(stream: DataFrame) -> DataFrame:
    """Count and latest date per school; state grows with the number of schools only."""
    return stream.groupBy("school_id").agg(F.count("*").alias("activities"), F.max("date").alias("latest"))


def streaming_school_activity(stream: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Write the schools whose running count or latest date changed, batch by batch."""
    return _start(activity_counts(stream), lambda rows, k: write_changes(rows, k, path), checkpoint, "update", every)


def school_activity(stream: DataFrame, path: str) -> DataFrame:
    """The table that ``streaming_school_activity`` keeps."""
    return newest(stream.sparkSession, path, activity_counts(stream).schema, ["school_id"])


# First rows


def progress_dedupe(rows: DataFrame, progress: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """First new row per key that is not in the progress table yet."""
    new = rows.join(progress.select(*keys).distinct(), list(keys), "left_anti")
    return first_per_key(new, keys, seq)


def first_rows(stream: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """The first row of each key that was never seen before, for update mode; the state holds a row per key.

    Of the rows of one micro-batch the one of least ``seq`` counts (null last, then by content).
    One aggregate with a map-side part, so a hot key is one row a task. A key is new if all its
    rows came with this run (its mark, drawn at the start) and this micro-batch (its time, which
    the checkpoint keeps, so a batch that comes again has the same).
    """
    run = uuid.uuid4().hex
    now = F.struct(F.current_timestamp().alias("time"), F.lit(run).alias("run"))
    order = F.struct(F.col(seq).isNull(), F.col(seq), F.to_json(F.struct(*stream.columns), {"ignoreNullFields": "false"}))
    rows = stream.select(*[F.col(k).alias(f"_key{n}") for n, k in enumerate(keys)], F.struct(*stream.columns).alias("_row"), order.alias("_order"), now.alias("_now"))
    names = [f"_key{n}" for n in range(len(keys))]
    found = rows.groupBy(*names).agg(F.min_by("_row", "_order").alias("_row"), F.min("_now").alias("_from"), F.max("_now").alias("_to"))
    return found.filter((F.col("_from") == now) & (F.col("_to") == now)).select("_row.*")


def progress_stream(stream: DataFrame, path: str, keys: Sequence[str], checkpoint: str, seq: str, every: str | None = None) -> StreamingQuery:
    """Write the first row ever seen of each key, across runs; nothing written is touched again."""
    return _start(first_rows(stream, keys, seq), lambda rows, k: write_changes(rows, k, path), checkpoint, "update", every)


def progress_rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows that ``progress_stream`` has written."""
    return read_changes(spark, path, schema).drop(BATCH)


# Action log


def logged_state(log: DataFrame, key: str) -> DataFrame:
    """What the actions of each key come to, as far as a later action can matter.

    Last number of each kind, last payload and last time of verification: maxima, so neither the
    order in which actions arrive nor their repetition matters, and a hot key is combined before
    the shuffle. A reset (SET) has no key; its last number is the state of the null key.
    """

    def last(*ops: str) -> Column:
        return F.max(F.when(F.col("op").isin(*ops), F.col("seq")))

    content, verified = F.col("op").isin("ADD", "UPDATE"), F.col("op") == "VERIFY"
    own = F.when(F.col("op") != "SET", F.col(key)).alias(key)
    return log.groupBy(own).agg(
        last("SET").alias("_set"),
        last("ADD").alias("_add"),
        last("DELETE").alias("_del"),
        last("ADD", "UPDATE").alias("_content"),
        last("VERIFY").alias("_verify"),
        F.max_by("payload", F.when(content, F.col("seq"))).alias("_row"),
        F.max_by("at", F.when(verified, F.col("seq"))).alias("_at"),
    )


def stream_changes(log: DataFrame, path: str, key: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Keep the state of a live action log (see ``merge.apply_changes``) in Spark's state store."""
    return _start(logged_state(log, key), lambda rows, k: write_changes(rows, k, path), checkpoint, "update", every)


def changed_rows(base: DataFrame, log: DataFrame, path: str, key: str) -> DataFrame:
    """The table after the actions that ``stream_changes`` has seen, from the rows it began with.

    The last reset is a version number: what a key did up to it does not count, and stored rows
    count only without one.
    """
    state = newest(base.sparkSession, path, logged_state(log, key).schema, [key])
    others = [c for c in base.columns if c != key]
    cleared = state.agg(F.max("_set")).scalar()

    def since(number: str, value: Column | str) -> Column:
        return F.when(cleared.isNull() | (F.col(number) > cleared), value if isinstance(value, Column) else F.col(value))

    live = state.filter(F.col(key).isNotNull()).select(
        key, *[since(c, c).alias(c) for c in ("_add", "_del", "_content", "_verify")], since("_content", "_row").alias("_row"), since("_verify", "_at").alias("_at")
    )
    before = base.filter(cleared.isNull()).select(key, F.struct(*others).alias("_base"))
    none = F.lit(-1)
    add, gone = F.coalesce("_add", none), F.coalesce("_del", none)
    there = F.when((add < 0) & (gone < 0), F.col("_base").isNotNull()).otherwise(add > gone)
    row = F.when(F.col("_content").isNotNull(), F.col("_row")).otherwise(F.col("_base"))
    kept = before.join(live, key, "full_outer").filter(there).select(key, *[row[c].alias(c) for c in others], "_content", "_verify", "_at")
    if "is_verified" in others:
        marked = F.coalesce(F.col("_verify") > F.coalesce("_content", none), F.lit(False))
        stamps = {c: F.when(marked, F.col("_at")).otherwise(F.col(c)) for c in ("last_verified_at", "updated_at") if c in others}
        kept = kept.withColumns({"is_verified": marked | F.col("is_verified"), **stamps})
    return kept.select(*base.columns)


# Merged tables


def _pointer(spark: SparkSession, path: str):
    """The live pointer: (slot, batch, schema), or None.

    Two slots take turns, so the former pointer stands while the next one is written.
    """
    rows = _found(lambda: spark.read.schema("slot int, batch long, version long, schema string").json(f"{path}/live-[01]"))
    return rows.orderBy(F.desc("version")).first() if rows is not None else None


def read_live(spark: SparkSession, path: str) -> DataFrame | None:
    """The table that ``upsert_sink`` keeps; None before the first batch."""
    live = _pointer(spark, path)
    if live is None:
        return None
    schema = T.StructType.fromJson(json.loads(live.schema))
    full = T.StructType([*schema.fields, T.StructField("_bucket", T.IntegerType())])
    rows = _found(lambda: spark.read.schema(full).parquet(f"{path}/{BATCH}={live.batch}"))
    return rows.drop("_bucket") if rows is not None else spark.createDataFrame([], schema)


def upsert_sink(rows: DataFrame, batch_id: int, path: str, keys: Sequence[str], seq: str, buckets: int = 64) -> bool:
    """Keyed upsert of a batch into the table at ``path``; the last row per key wins.

    The merged table is written to the folder of the batch, in hash buckets of the key, and then
    one pointer of a line is written: until then readers see the former table, and a batch that
    fails may come again. A batch that is live already changes nothing (False). The driver reads
    one pointer, however many batches there were. One writer at a time.
    """
    spark = rows.sparkSession
    live = _pointer(spark, path)
    if live is not None and live.batch == batch_id:
        return False
    current = read_live(spark, path)
    merged = merge_upsert(current if current is not None else rows.limit(0), rows, keys, seq=seq).drop("_action")
    dealt = merged.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    # Rebalancing splits large buckets over several tasks and files and joins small ones.
    dealt.hint("rebalance", "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/{BATCH}={batch_id}")
    _publish(spark, path, batch_id, merged.schema, live)
    return True


def _publish(spark: SparkSession, path: str, batch_id: int, schema: T.StructType, live) -> None:
    slot, version = (1 - live.slot, live.version + 1) if live is not None else (0, 0)
    row = spark.createDataFrame([(slot, batch_id, version, schema.json())], "slot int, batch long, version long, schema string")
    row.coalesce(1).write.mode("overwrite").json(f"{path}/live-{slot}")


def incremental_ingest(stream: DataFrame, path: str, keys: Sequence[str], checkpoint: str, seq: str, every: str | None = None, buckets: int = 64) -> StreamingQuery:
    """Upsert each micro-batch into the table at ``path``; the last row per key wins."""
    return _start(stream, lambda rows, k: upsert_sink(rows, k, path, keys, seq, buckets), checkpoint, every=every)


# Cursors


def cursor_batch(df: DataFrame, key: str, size: int, start: int = 0) -> DataFrame:
    """Slice [start, start + size) in key order; a start behind the end begins again.

    A deep start reads only its own range of the order (``slice_of_order``); long runs should
    keep a key instead (``cursor_after``).
    """
    page = slice_of_order(df, [key], start, size)
    again = df.orderBy(key).limit(size).filter(F.lit(start) >= df.agg(F.count("*")).scalar())
    return page.unionByName(again)


def cursor_stream(df: DataFrame, key: str, size: int, path: str, checkpoint: str) -> StreamingQuery:
    """One run: the next ``size`` rows of ``df`` in key order, written as one batch.

    The position is the offset of a stream (``CursorSource``), so it is stored with the batch in
    the checkpoint, and a run that fails takes the same rows again. Behind the last row the next
    run begins at the front. Only the position passes through the source; the rows are a slice
    that Spark takes.
    """
    spark = df.sparkSession
    spark.dataSource.register(CursorSource)
    total = df.count()
    spans = spark.readStream.format(CursorSource.name()).option("size", size).option("total", total).load()

    def step(span: DataFrame, batch_id: int) -> None:
        found = span.first()  # one row
        if found is not None:
            write_changes(slice_of_order(df, [key], found.start, found.end - found.start), batch_id, path)

    return _start(spans, step, checkpoint)


def cursor_span(df: DataFrame, size: int, start: int) -> DataFrame:
    """One row (start, end, next) of a cursor run: where it began, where it ended, what to store.

    A start behind the end begins again, as in ``cursor_batch``; the stored position is the end.
    """
    total = df.agg(F.count("*").alias("n"))
    begin = F.when(F.lit(start) >= F.col("n"), F.lit(0)).otherwise(F.lit(start)).cast("bigint")
    end = F.least(begin + size, F.col("n"))
    return total.select(begin.alias("start"), end.alias("end"), end.alias("next"))


def save_position(span: DataFrame, path: str) -> None:
    """Store the next position of a run (one row)."""
    span.select("next").coalesce(1).write.mode("overwrite").json(path)


def load_position(spark: SparkSession, path: str) -> int:
    """The stored position, 0 before the first run."""
    rows = _found(lambda: spark.read.schema("next long").json(path))
    found = rows.first() if rows is not None else None
    return int(found[0]) if found else 0


def cursor_after(df: DataFrame, key: str, size: int, after=None) -> DataFrame:
    """The next ``size`` keys behind the last one handled, from the front when none is left.

    The position is a key, so nothing before it is read or sorted again.
    """
    if after is None:
        return df.orderBy(key).limit(size)
    rest = df.filter(F.col(key) > after)
    page = rest.orderBy(key).limit(size)
    again = df.orderBy(key).limit(size).filter(rest.limit(1).agg(F.count("*")).scalar() == 0)
    return page.unionByName(again)
