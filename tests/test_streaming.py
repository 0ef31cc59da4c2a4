"""Incremental jobs against their batch results, run in several steps."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from frames import rows
from pyspark.sql import functions as F

from canvasser.operators import merge
from canvasser.streaming import incremental
from canvasser.streaming.cursor import CursorReader

SCHEMA = "id int, v string, seq bigint"


@pytest.fixture
def feed(spark, tmp_path):
    """A folder that receives one more file per call."""

    class Feed:
        path = str(tmp_path / "feed")
        n = 0

        def add(self, data, schema):
            df = spark.createDataFrame(data, schema)
            df.coalesce(1).write.mode("append").parquet(self.path)
            return df

    return Feed()


def test_ingest_in_two_runs(spark, feed, tmp_path):
    path, progress = str(tmp_path / "t"), str(tmp_path / "p")

    def run():
        stream = incremental.read_parquet_stream(spark, feed.path, spark.read.parquet(feed.path).schema, files_per_run=1)
        incremental.incremental_ingest(stream, path, ["id"], progress, "seq", buckets=3).awaitTermination()

    feed.add([(1, "a", 1), (2, "b", 2), (1, "c", 3)], SCHEMA)
    run()
    assert rows(incremental.read_live(spark, path), "id", "v") == [(1, "c"), (2, "b")]
    feed.add([(2, "d", 4), (3, "e", 5)], SCHEMA)
    feed.add([(3, "f", 6)], SCHEMA)
    run()
    run()  # nothing new
    assert rows(incremental.read_live(spark, path), "id", "v") == [(1, "c"), (2, "d"), (3, "f")]


def test_ingest_takes_up_a_failed_batch(spark, feed, tmp_path, monkeypatch):
    path, progress = str(tmp_path / "t"), str(tmp_path / "p")

    def run():
        stream = incremental.read_parquet_stream(spark, feed.path, spark.read.parquet(feed.path).schema, files_per_run=1)
        incremental.incremental_ingest(stream, path, ["id"], progress, "seq", buckets=3).awaitTermination()

    feed.add([(1, "a", 1)], SCHEMA)
    run()
    feed.add([(1, "b", 2), (2, "c", 3)], SCHEMA)
    with monkeypatch.context() as broken:
        broken.setattr(incremental, "_publish", lambda *_: (_ for _ in ()).throw(OSError("lost between write and pointer")))
        with pytest.raises(Exception, match="lost between"):
            run()
    assert rows(incremental.read_live(spark, path), "id", "v") == [(1, "a")]
    run()
    assert rows(incremental.read_live(spark, path), "id", "v") == [(1, "b"), (2, "c")]


def test_first_rows_over_runs(spark, feed, tmp_path):
    """The first run that has a key keeps its row, of one run the one of least number."""
    path, progress = str(tmp_path / "t"), str(tmp_path / "p")
    schema = "id bigint, kind string, v string, seq bigint, at timestamp_ntz, d decimal(20,3)"
    at, d = dt.datetime(2024, 1, 2, 3, 4, 5, 678901), Decimal("12345678901234567.891")
    parts = [
        [(2**60 + 1, None, "a", 5, at, d), (2**60 + 1, None, "b", 4, None, None), (None, "x", "n", 1, at, d)],
        [(2**60 + 1, None, "c", 1, at, d), (2**60 + 1, "k", "d", 2, at, d), (None, "x", "m", 0, None, d), (7, "k", "late", None, at, d), (7, "k", "first", 9, at, d)],
    ]
    written = []
    for part in [*parts, []]:
        if part:
            feed.add(part, schema)
        stream = incremental.read_parquet_stream(spark, feed.path, spark.read.parquet(feed.path).schema)
        incremental.progress_stream(stream, path, ["id", "kind"], progress, "seq").awaitTermination()
        written.append({p for p in (tmp_path / "t").glob("*/*.parquet")})
    assert written[0] <= written[1] == written[2]  # nothing written is touched again
    got = incremental.progress_rows(spark, path, stream.schema)
    assert got.schema == stream.schema
    want = [parts[0][1], parts[0][2], parts[1][1], parts[1][4]]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_first_rows_of_a_hot_key_are_reduced_before_the_shuffle(spark, feed, tmp_path):
    path, progress = str(tmp_path / "t"), str(tmp_path / "p")
    feed.add([(1 if k % 3 else k, str(k), k) for k in range(1, 3000)], SCHEMA)
    stream = incremental.read_parquet_stream(spark, feed.path, spark.read.parquet(feed.path).schema)
    incremental.progress_stream(stream, path, ["id"], progress, "seq").awaitTermination()
    got = incremental.progress_rows(spark, path, stream.schema)
    assert got.count() == 1000 and got.filter("id = 1").collect() == [(1, "1", 1)]


def test_first_rows_compare_large_numbers_exactly(spark, feed, tmp_path):
    """Numbers that a double cannot tell apart, beside a missing one; many batches see each key again."""
    path, progress = str(tmp_path / "t"), str(tmp_path / "p")
    big = 2**60
    feed.add([(1, "a", big + 1), (1, "b", big), (1, "c", None), (2, "d", None)], SCHEMA)
    feed.add([(1, "e", 0), (2, "f", 0), (3, "g", 5)], SCHEMA)
    feed.add([(3, "h", 1), (1, "i", 0)], SCHEMA)
    stream = incremental.read_parquet_stream(spark, feed.path, spark.read.parquet(feed.path).schema, files_per_run=1)
    incremental.progress_stream(stream, path, ["id"], progress, "seq").awaitTermination()
    assert rows(incremental.progress_rows(spark, path, stream.schema)) == [(1, "b", big), (2, "d", None), (3, "g", 5)]


def test_counts_over_runs(spark, feed, tmp_path):
    path, progress = str(tmp_path / "t"), str(tmp_path / "p")
    schema = "school_id int, date timestamp_ntz"
    day = lambda n: dt.datetime(2024, 1, n)
    for part in ([(1, day(2)), (1, day(1)), (2, day(5))], [(1, day(3)), (3, day(4)), (None, day(1))]):
        feed.add(part, schema)
        stream = incremental.read_parquet_stream(spark, feed.path, spark.read.parquet(feed.path).schema)
        incremental.streaming_school_activity(stream, path, progress).awaitTermination()
    assert rows(incremental.school_activity(stream, path)) == [(None, 1, day(1)), (1, 3, day(3)), (2, 1, day(5)), (3, 1, day(4))]
    changed = incremental.read_changes(spark, path, incremental.activity_counts(stream).schema)
    assert rows(changed.filter("at_batch = 1"), "school_id") == [(None,), (1,), (3,)]  # school 2 did not change


def test_a_batch_that_comes_again_replaces_its_folder(spark, tmp_path):
    path = str(tmp_path / "t")
    frame = spark.createDataFrame([(1, "a", 1)], SCHEMA)
    assert incremental.newest(spark, path, frame.schema, ["id"]).count() == 0
    for batch, value in ((0, "a"), (1, "b"), (1, "c")):
        incremental.write_changes(frame.withColumn("v", F.lit(value)), batch, path)
    assert rows(incremental.read_changes(spark, path, frame.schema), "v") == [("a",), ("c",)]
    assert rows(incremental.newest(spark, path, frame.schema, ["id"])) == [(1, "c", 1)]


LOG = "seq bigint, op string, id int, payload struct<v:string,is_verified:boolean>, at timestamp_ntz"
NOW = dt.datetime(2024, 1, 1)
ACTIONS = [
    [(1, "UPDATE", 1, ("a1", False), NOW), (2, "DELETE", 2, None, NOW), (3, "UPDATE", 9, ("no", False), NOW)],
    [(4, "ADD", 2, ("b2", False), NOW), (5, "VERIFY", 1, None, NOW), (6, "ADD", 3, ("c", False), NOW)],
    [(7, "SET", None, None, NOW), (8, "ADD", 5, ("only", True), NOW)],
]


def run_log(spark, feed, path, progress):
    stream = incremental.read_parquet_stream(spark, feed.path, spark.read.parquet(feed.path).schema, files_per_run=1)
    incremental.stream_changes(stream, path, "id", progress).awaitTermination()
    return stream


def test_change_stream(spark, feed, tmp_path):
    base = spark.createDataFrame([(1, "a", False), (2, "b", False)], "id int, v string, is_verified boolean")
    path, progress = str(tmp_path / "t"), str(tmp_path / "p")
    want = [[(1, "a1", False)], [(1, "a1", True), (2, "b2", False), (3, "c", False)], [(5, "only", True)]]
    for part, state in zip(ACTIONS, want):
        feed.add(part, LOG)
        stream = run_log(spark, feed, path, progress)  # a restart from the checkpoint each time
        assert rows(incremental.changed_rows(base, stream, path, "id")) == state
    feed.add(ACTIONS[2], LOG)  # actions that come again change nothing
    run_log(spark, feed, path, progress)
    assert rows(incremental.changed_rows(base, stream, path, "id")) == want[2]


@pytest.mark.parametrize("seed", range(3))
def test_change_stream_in_any_order(spark, feed, tmp_path, seed):
    """Shuffled micro-batches, with one restart, equal the batch form."""
    rnd = random.Random(seed)
    base = spark.createDataFrame([(k, f"b{k}", k % 2 == 0) for k in range(6)], "id int, v string, is_verified boolean")
    log = [(s, rnd.choice(["ADD", "UPDATE", "DELETE", "VERIFY"]), rnd.randrange(9), (f"v{s}", rnd.random() < 0.3), NOW) for s in range(60)]
    if seed:
        log[20 * seed] = (20 * seed, "SET", None, None, NOW)
    want = rows(merge.apply_changes(base, spark.createDataFrame(log, LOG), "id"))
    rnd.shuffle(log)
    path, progress = str(tmp_path / "t"), str(tmp_path / "p")
    for part in (log[:17], log[17:31], log[31:]):
        feed.add(part, LOG)
        if part is not log[17:31]:
            stream = run_log(spark, feed, path, progress)
    assert rows(incremental.changed_rows(base, stream, path, "id")) == want


def test_cursor(spark):
    df = spark.createDataFrame([(k,) for k in (5, 1, 9, 3)], "k int")
    keys = lambda out: [r[0] for r in rows(out)]
    assert keys(incremental.cursor_batch(df, "k", 3)) == [1, 3, 5]
    assert keys(incremental.cursor_batch(df, "k", 3, start=3)) == [9]
    assert keys(incremental.cursor_batch(df, "k", 3, start=4)) == [1, 3, 5]
    assert keys(incremental.cursor_after(df, "k", 2, after=3)) == [5, 9]
    assert keys(incremental.cursor_after(df, "k", 2, after=9)) == [1, 3]


def test_shared_folder_is_the_cluster_setting(spark):
    from canvasser.session import fresh_path, shared_dir

    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert shared_dir(spark) == named.rstrip("/")
    assert shared_dir(spark) == shared_dir(spark)
    assert fresh_path(spark, "x") != fresh_path(spark, "x") and fresh_path(spark, "x").startswith(shared_dir(spark))


def test_failed_publish_leaves_the_table_as_it_was(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    first = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], SCHEMA)
    second = spark.createDataFrame([(2, "c", 3), (3, "d", 4)], SCHEMA)
    assert incremental.read_live(spark, path) is None
    assert incremental.upsert_sink(first, 0, path, ["id"], "seq", 3)

    def fail(*_):
        raise OSError("lost between write and pointer")

    with monkeypatch.context() as broken:
        broken.setattr(incremental, "_publish", fail)
        with pytest.raises(OSError):
            incremental.upsert_sink(second, 1, path, ["id"], "seq", 3)
    assert rows(incremental.read_live(spark, path), "id", "v") == [(1, "a"), (2, "b")]
    assert incremental.upsert_sink(second, 1, path, ["id"], "seq", 3)
    before = sorted(tmp_path.glob("t/*/*/*"))
    assert not incremental.upsert_sink(second, 1, path, ["id"], "seq", 3)  # live already
    assert sorted(tmp_path.glob("t/*/*/*")) == before
    assert rows(incremental.read_live(spark, path), "id", "v") == [(1, "a"), (2, "c"), (3, "d")]
    # A pointer lost while it was written leaves the former one.
    slot = incremental._pointer(spark, path).slot
    for part in (tmp_path / "t" / f"live-{slot}").glob("part-*"):
        part.write_text("")
    assert rows(incremental.read_live(spark, path), "id", "v") == [(1, "a"), (2, "b")]


def test_driver_reads_one_pointer_whatever_the_history(spark, tmp_path):
    path = str(tmp_path / "t")
    for k in range(5):
        incremental.upsert_sink(spark.createDataFrame([(i, f"v{k}", k) for i in range(20)], SCHEMA), 3 * k, path, ["id"], "seq", 2)
    assert sorted(p.name for p in (tmp_path / "t").glob("live-*")) == ["live-0", "live-1"]
    assert sum(1 for _ in (tmp_path / "t").glob("live-*/part-*")) == 2
    assert rows(incremental.read_live(spark, path), "v") == [("v4",)] * 20


def test_empty_batches(spark, tmp_path):
    path, none = str(tmp_path / "t"), spark.createDataFrame([], SCHEMA)
    incremental.upsert_sink(none, 0, path, ["id"], "seq", 2)
    assert incremental.read_live(spark, path).count() == 0
    incremental.upsert_sink(spark.createDataFrame([(1, "a", 1), (None, "b", 2), (None, "b", 3)], SCHEMA), 1, path, ["id"], "seq", 2)
    assert incremental.read_live(spark, path).count() == 3


def test_cursor_stream_keeps_its_position(spark, tmp_path):
    path, progress = str(tmp_path / "t"), str(tmp_path / "p")
    table = spark.range(250).select((F.lit(249) - F.col("id")).alias("k"))
    for _ in range(4):
        incremental.cursor_stream(table, "k", 100, path, progress).awaitTermination()
    got = incremental.read_changes(spark, path, table.schema)
    spans = got.groupBy("at_batch").agg(F.min("k"), F.max("k"), F.count("*"))
    assert rows(spans) == [(0, 0, 99, 100), (1, 100, 199, 100), (2, 200, 249, 50), (3, 0, 99, 100)]


def test_cursor_stream_takes_a_failed_run_again(spark, tmp_path, monkeypatch):
    path, progress = str(tmp_path / "t"), str(tmp_path / "p")
    table = spark.range(30).toDF("k")
    incremental.cursor_stream(table, "k", 10, path, progress).awaitTermination()
    with monkeypatch.context() as broken:
        broken.setattr(incremental, "write_changes", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(Exception, match="lost"):
            incremental.cursor_stream(table, "k", 10, path, progress).awaitTermination()
    for _ in range(2):
        incremental.cursor_stream(table, "k", 10, path, progress).awaitTermination()
    spans = incremental.read_changes(spark, path, table.schema).groupBy("at_batch").agg(F.min("k"), F.count("*"))
    assert rows(spans)[:2] == [(0, 0, 10), (1, 10, 10)]


def test_cursor_positions():
    reader = CursorReader(4, 9)
    at, seen = reader.initialOffset(), []
    for _ in range(4):
        span, at = reader.read(at)
        seen += span
    assert seen == [(1, 0, 4), (2, 4, 8), (3, 8, 9), (4, 0, 4)]
    span, at = CursorReader(4, 0).read({"run": 0, "end": 0})
    assert list(span) == [] and at["run"] == 1
    whole = CursorReader(20, 9)
    assert [list(whole.read({"run": k, "end": 9 * min(k, 1)})[0]) for k in range(2)] == [[(1, 0, 9)], [(2, 0, 9)]]


def test_cursor_position_is_stored(spark, tmp_path):
    df, path = spark.range(25), str(tmp_path / "position")
    seen = []
    for _ in range(4):
        span = incremental.cursor_span(df, 10, incremental.load_position(spark, path))
        incremental.save_position(span, path)
        seen.append(incremental.load_position(spark, path))
    assert seen == [10, 20, 25, 10]
