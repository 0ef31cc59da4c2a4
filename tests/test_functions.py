"""Column expressions on hand-written values."""

import datetime as dt
import random

import pytest
from frames import rows
from pyspark.sql import functions as F

from canvasser.functions import dates as D
from canvasser.functions import text as X
from canvasser.functions.ordering import (
    slice_of_order,
    first_per_key,
    fold_preferred_website,
    latest_per_key,
    next_in_key,
    top_n_per_key,
)


@pytest.fixture(scope="module")
def apply(spark):
    def run(expr, values, kind="string"):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
        return [r[0] for r in df.orderBy("i").select(expr(F.col("x"))).collect()]

    return run


def test_blank_handling(apply):
    assert apply(X.clean_text, ["  a b ", " \t", None, " x "]) == ["a b", None, None, "x"]
    assert apply(X.normalize_text, [" A  \tB ", None, "  "]) == ["a b", "", ""]
    odd = "\u00a0\u2003 a\u00a0\u3000b\u2028"
    assert apply(X.clean_text, [odd]) == ["a\u00a0\u3000b"] and apply(X.normalize_text, [odd]) == ["a b"]
    assert apply(X.has_text, ["x", " ", None]) == [True, False, False]


def test_safe_int(apply):
    given = ["4.9", "-4.9", " 7 ", "", "None", "(Pending)", "pending", "junk", None, "inf", "1e3", "NaN"]
    assert apply(X.safe_int, given) == [4, -4, 7, None, None, None, None, None, None, None, 1000, None]


def test_names(apply):
    got = apply(X.split_name, ["Ann Lee Roy", "Solo", "  ", None, " Ann Lee "])
    assert [tuple(r) for r in got] == [("Ann", "Lee Roy"), ("Solo", ""), ("", ""), ("", ""), ("Ann", "Lee")]
    assert apply(X.letter_title, ["o'brien", "dekalb", "st. clair 2nd", "MCLEAN-x"]) == ["O'Brien", "Dekalb", "St. Clair 2Nd", "Mclean-X"]
    assert apply(X.word_title, [" o'brien  McLEAN ", None]) == ["O'brien Mclean", ""]
    assert apply(X.activity_label, ["site_visit", "a__bC d"]) == ["Site Visit", "A  BC D"]
    assert apply(lambda c: X.truncate_label(c, 22, 20), ["x" * 22, "y" * 23]) == ["x" * 22, "y" * 20 + "…"]


def test_roles(apply):
    titles = ["Assistant Principal", "Guidance", "Computer Science Chair", "Mathematics", "Life Science", "cs_teacher", None, "Superintendent of math"]
    assert apply(X.classify_role, titles) == [
        "principal", "counselor", "cs_teacher", "math_teacher", "science_teacher", "principal", "principal", "superintendent"
    ]
    assert apply(X.resolve_role, [" CS Teacher ", "cs_teacher", "nobody", None, "supt"]) == [
        "cs_teacher", "cs_teacher", "counselor", "counselor", "superintendent"
    ]
    assert apply(X.school_type, ["Junior High", "MIDDLE", "High", None]) == ["middle_school", "middle_school", "high_school", "high_school"]


def test_keys(spark, apply):
    df = spark.createDataFrame(
        [
            (" own ", "Cook", "A", "B", "1", None),
            (None, None, " Alpha  HS ", "Chicago", " 60601 ", "12"),
            (None, "Cook", None, "Chicago", "1", " 77 "),
            (None, "Cook", "Alpha", " ", "1", "(Pending)"),
        ],
        "FacilityKey string, County string, FacilityName string, City string, Zip string, NCES_ID string",
    )
    key = X.facility_key(*[F.col(c) for c in df.columns])
    assert [r[0] for r in df.select(key).collect()] == ["own", "|Alpha  HS|Chicago|60601", "nces|77", None]
    assert apply(X.normalize_facility_key, [" Cook | Alpha\t HS|X", "a||b "]) == ["cook|alpha hs|x", "a||b"]
    odd = [None, "", " | ", "a |  | b", "\u2003A\u3000b |\n|ΣΑΣ|ΟΔΟΣ ", "|| x  y ||", "||"]
    assert apply(X.normalize_facility_key, odd) == [None, "", "|", "a||b", "a b||σας|οδος", "||x y||", "||"]
    assert apply(X.slug, [" Lane -- Tech! HS "]) == ["lane-tech-hs"]
    assert apply(X.city_school_key, ["Lane Tech"]) == ["cps|lane-tech"]
    assert apply(X.normalize_facility_name, ["St. X & Co Sch, IL", "Sr Jr St illinois", None]) == ["saint x and co school", "senior junior saint", ""]


def test_urls(spark, apply):
    assert apply(X.normalize_urls, [[" b ", "a", "", "b", None]], "array<string>") == [["b", "a"]]
    assert apply(lambda c: X.build_urls(c, ["/staff", "/x", "/staff"]), ["https://a.org//"]) == [["https://a.org/staff", "https://a.org/x"]]
    assert apply(X.is_valid_email, ["a@b.c", "a b@c.d", "a@b", "", None]) == [True, False, False, False, False]
    df = spark.createDataFrame([("", "http://x"), ("http://aa", "https://b"), ("https://b", "http://cccccc"), ("https://b", "http://c"), (None, None)], "a string, b string")
    assert [r[0] for r in df.select(X.preferred_website(F.col("a"), F.col("b"))).collect()] == ["http://x", "https://b", "http://cccccc", "https://b", ""]


def test_events(apply):
    assert apply(X.parse_event_id, ["e_12", "se_3", "s_4", "x5", None, "12abc"]) == [12, 3, 4, None, None, 12]
    assert apply(X.participants_split, ["a, b,,a ", "", None]) == [["a", "b", "a"], [], []]
    assert apply(X.participants_join, [["a", "b"], []], "array<string>") == ["a,b", None]


def test_numbers(spark):
    df = spark.createDataFrame([(1, 8), (5, 1000), (1, 0), (29, 20)], "a int, b int")
    assert rows(df.select(X.pct_round("a", "b").alias("p"))) == [(0,), (1,), (13,), (145,)]
    assert [r[0] for r in df.select(X.one_decimal("a", "b")).collect()] == [0.1, 0.0, 0.0, 1.5]


def test_dates(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    assert get(D.months_before("2001-08-31 10:00:00", 6)) == dt.datetime(2001, 2, 28, 10)
    assert get(D.days_between(D.at("2001-08-02 00:00:00"), D.at("2001-08-01 00:00:01"))) == 0
    assert get(D.days_between(D.at("2001-08-01"), D.at("2001-08-03 12:00:00"))) == -2
    assert get(D.format_day(D.at("2001-08-01"))) == "Aug 1, 2001"
    assert get(D.format_day(F.lit(None).cast("timestamp"))) == "Never"
    assert get(D.to_db_date(F.lit("04/23/2026"))) == "2026-04-23"
    assert get(D.to_db_date(F.lit("23.04.2026"))) is None
    assert [get(D.to_db_time(F.lit(t))) for t in ("1:05 PM", "13:05", "noon", "12:00 am")] == ["13:05:00", "13:05:00", None, "00:00:00"]


def test_first_last_top(table):
    df = table([("a", 1, "x"), ("a", 3, "y"), ("a", 2, "z"), ("b", 5, None)], "k string, seq int, v string")
    assert rows(latest_per_key(df, ["k"], "seq")) == [("a", 3, "y"), ("b", 5, None)]
    assert rows(first_per_key(df, ["k"], "seq")) == [("a", 1, "x"), ("b", 5, None)]
    assert rows(top_n_per_key(df, ["k"], [F.desc("seq")], 2, rank="r"), "k", "seq", "r") == [("a", 2, 2), ("a", 3, 1), ("b", 5, 1)]


def fold(urls):
    cur = ""
    for u in (u.strip() for u in urls):
        if (u.startswith("https://") and not cur.startswith("https://")) or len(u) > len(cur):
            cur = u
    return cur


def test_website_fold_is_the_ordered_fold(spark):
    """The closed form against a literal fold, on many short random lists and one hot key."""
    rng = random.Random(7)
    lists = {k: [rng.choice(["http://", "https://"]) + "x" * rng.randint(0, 4) + rng.choice("ab") for _ in range(rng.randint(1, 9))] for k in range(600)}
    lists[600] = ["http://aa", "https://b", "http://cccccc"]
    lists[601] = ["", " http://aa "]
    lists[602] = [rng.choice(["http://", "https://"]) + "x" * rng.randint(0, 30) for _ in range(2000)]
    data = [(k, i, u) for k, us in lists.items() for i, u in enumerate(us)]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "k int, seq int, u string")
    got = dict(fold_preferred_website(df, ["k"], "seq", "u", "site").collect())
    assert got == {k: fold(us) for k, us in lists.items()}


def test_next_in_key_over_stretches(spark):
    rng = random.Random(3)
    seqs = {k: sorted(rng.sample(range(500), 60)) for k in "abc"}
    data = [(k, s, s % 3 == 0) for k, ss in seqs.items() for s in ss]
    df = spark.createDataFrame(data, "k string, seq bigint, m boolean")
    got = {(r.k, r.seq): r.n for r in next_in_key(df, ["k"], "seq", "n", span=7).collect()}
    want = {(k, s): next((t for t in ss if t > s), None) for k, ss in seqs.items() for s in ss}
    assert got == want
    got = {(r.k, r.seq): r.n for r in next_in_key(df, ["k"], "seq", "n", marked=F.col("m"), span=7).collect()}
    assert got == {(k, s): next((t for t in ss if t > s and t % 3 == 0), None) for k, ss in seqs.items() for s in ss}


def test_deep_slices_of_an_order(spark):
    data = [(k * 7919 % 1000, f"v{k}") for k in range(1000)]
    df = spark.createDataFrame(data, "k int, v string").repartition(5)
    whole = sorted(data)
    for start, size in ((0, 10), (333, 40), (990, 30), (2000, 5)):
        for deep in (0, 10**6):
            got = slice_of_order(df, ["k"], start, size, deep).collect()
            assert [tuple(r) for r in got] == whole[start : start + size]
    down = slice_of_order(df, [F.desc("k")], 5, 3, 0).collect()
    assert [tuple(r) for r in down] == whole[::-1][5:8]
    assert slice_of_order(df.limit(0), ["k"], 3, 3, 0).count() == 0
