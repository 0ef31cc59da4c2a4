"""Hot keys, and the shape of plans once tables are too large to broadcast."""

import random

import pytest
from frames import rows
from pyspark.sql import functions as F

import __spark_entry__ as entry
from canvasser.functions.ordering import latest_per_key
from canvasser.operators import fuzzy, joins, merge, metrics
from canvasser.plans import lookup, merging
from canvasser.plans.bindings import AS_OF, views
from canvasser.sources import sinks

SF = "/root/testdata/sf0.001"
N = 150_000


@pytest.fixture(scope="module")
def hot(spark):
    """A third of all rows share key 0."""
    return spark.range(N).selectExpr("id as seq", "if(id % 3 = 0, 0, id % 5000) as k", "concat('v', id) as v").cache()


@pytest.fixture
def no_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, old)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_last_row_of_a_hot_key(hot):
    got = dict(latest_per_key(hot, ["k"], "seq").select("k", "seq").collect())
    want = {}
    for i in range(N):
        want[0 if i % 3 == 0 else i % 5000] = i
    assert got == want


def test_hot_key_is_cut_before_the_shuffle(hot):
    plan = plan_of(latest_per_key(hot, ["k"], "seq"))
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


def test_merge_with_a_hot_incoming_key(spark, hot):
    target = spark.range(6000).selectExpr("id as k", "'old' as v")
    out = merge.merge_upsert(target, hot, ["k"], seq="seq")
    assert {r["_action"]: r["count"] for r in out.groupBy("_action").count().collect()} == {"update": 5000, "keep": 1000}
    assert out.filter("k = 0").first().v == f"v{N - 3}"


def test_log_with_a_hot_key(spark, hot):
    base = spark.createDataFrame([(0, "base")], "k bigint, v string")
    op = F.when(F.col("seq") % 7 == 0, "DELETE").when(F.col("seq") % 2 == 0, "ADD").otherwise("UPDATE")
    log = hot.select("seq", op.alias("op"), "k", F.struct("v").alias("payload"), F.lit(None).cast("timestamp_ntz").alias("at"))
    got = {r.k: r.v for r in merge.apply_changes(base, log, "k").collect()}
    want = {0: "base"}
    for i in range(N):
        k = 0 if i % 3 == 0 else i % 5000
        if i % 7 == 0:
            want.pop(k, None)
        elif i % 2 == 0 or k in want:
            want[k] = f"v{i}"
    assert got == want


def test_join_with_a_hot_key(spark, hot, no_broadcast):
    schools = spark.range(5000).selectExpr("id as school_id", *[f"cast(id as string) as {c}" for c in ("name", "county", "address", "city", "state", "zip_code")])
    out = joins.contacts_with_school(hot.withColumnRenamed("k", "school_id"), schools)
    assert out.count() == N and out.filter("school_name = '0'").count() == hot.filter("k = 0").count()


WRITES = {"incremental_ingest", "progress_stream", "streaming_school_activity", "stream_changes", "upsert_sink", "append_records", "export_snapshot", "import_snapshot", "read_csv_records", "read_json_records", "read_keyed_json", "cursor_stream", "load_summary", "site_contacts"}


def test_no_pairwise_joins_and_no_row_python(spark, no_broadcast):
    found = {}
    for name, build in entry.queries().items():
        if name in WRITES:
            continue
        plan = plan_of(build(spark, SF))
        bad = [w for w in ("CartesianProduct", "BroadcastNestedLoop", "BatchEvalPython") if w in plan]
        if bad:
            found[name] = bad
    assert not found


def test_scans_are_pruned(spark, no_broadcast):
    plan = plan_of(entry.queries()["engagement_score"](spark, SF))
    scans = [x for x in plan.splitlines() if "FileScan" in x]
    line = next(x for x in scans if "l_orderkey" in x)
    assert "l_extendedprice" not in line and "PushedFilters: [" in line and "EqualTo(l_returnflag,R)" in line
    assert any("EqualTo(o_orderpriority,5-LOW)" in x for x in scans)
    # Four children are joined on the school: one exchange each and one for the schools.
    assert plan.count("Exchange hashpartitioning(school_id") == 5


def test_tables_saved_by_school_need_no_exchange(spark, no_broadcast, tmp_path):
    v = views(spark, SF)
    names = ["schools", "contacts", "activities", "participation", "programs"]
    for name in names:
        sinks.save_by_key(getattr(v, name), f"by_school_{name}", "school_id", 4, str(tmp_path / name))
    try:
        saved = [spark.table(f"by_school_{name}") for name in names]
        out = metrics.engagement_score(*saved, AS_OF)
        assert "Exchange" not in plan_of(out)
        direct = metrics.engagement_score(*[getattr(v, name) for name in names], AS_OF)
        assert rows(out) == rows(direct)
    finally:
        for name in names:
            spark.sql(f"DROP TABLE by_school_{name}")


def test_scored_pairs_grow_with_the_rows(spark):
    """Distinct texts to score, per row, at ten times the data (equal ones come side by side, for the cache)."""
    per_row = []
    for sf in ("sf0.01", "sf0.1"):
        v = views(spark, f"/root/testdata/{sf}")
        names, labels = lookup.fuzzy_inputs(v)
        pairs = fuzzy.candidate_pairs(names, labels, 70.0, ["p_brand"])[1]
        per_row.append(pairs.select("_text", "label").distinct().count() / v.part.count())
    assert 0 < per_row[1] <= 2 * per_row[0], per_row


def test_letter_counts_lose_no_pair(spark):
    """Every pair above the threshold passes the bound, long and odd texts too."""
    rnd = random.Random(5)
    texts = ["".join(rnd.choices("aeiounmrlst xyz-É", k=rnd.randrange(1, 30))) for _ in range(120)] + ["long " * 20 + "end", "long " * 21 + "end"]
    df = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")
    common = fuzzy._most_common(fuzzy._letter_counts(F.col("a")), fuzzy._letter_counts(F.col("b")))
    bound = df.select("a", "b", (200.0 * common / (F.length("a") + F.length("b"))).alias("bound")).collect()
    assert all(r.bound is None or r.bound >= 200.0 * fuzzy._common_length(r.a, r.b) / (len(r.a) + len(r.b)) - 1e-9 for r in bound)
    assert any(r.bound is None for r in bound) and sum(r.bound is not None and r.bound < 70 for r in bound) > 1000


def test_rows_helper(table):
    assert rows(table([(2,), (1,), (None,)], "a int")) == [(None,), (1,), (2,)]


def test_a_load_makes_its_inputs_once(spark, monkeypatch):
    """No merge reads the customers' one file again, and its rows are dealt out before texts are cleaned."""
    plans, files = {}, {}
    made = merging._made

    def noted(df, label):
        out = made(df, label)
        files[label] = len(out.inputFiles())
        return out

    monkeypatch.setattr(merging, "_made", noted)
    monkeypatch.setattr(merge, "write_counted", lambda merged, path, table: plans.setdefault(table, plan_of(merged)) and [])
    entry.queries()["load_summary"](spark, SF)
    assert set(plans) == {"county", "schools", "staff", "city_schools", "city_staff"}
    assert not [t for t, p in plans.items() if "customer.parquet" in p]
    assert files["customers"] > 1 and files["directory"] > 1
