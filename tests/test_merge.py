"""Set operations, merges, edits and the action log on hand-written tables."""

import datetime as dt
import random

import pytest
from frames import rows
from pyspark.sql import functions as F

from canvasser.operators import catalog, merge

LIST = "seq int, FacilityKey string, County string, FacilityName string, City string, Zip string, Telephone string, Administrator string, Website string, NCES_ID string"


@pytest.fixture(scope="module")
def listed(spark):
    return spark.createDataFrame(
        [
            (1, None, " Cook ", "Alpha  HS", "Chicago", "60601", "1", None, None, None),
            (2, None, "COOK", " alpha hs", "CHICAGO ", "60601", "2", "Ann", None, None),
            (3, None, "o'brien", "Beta", None, None, "", None, None, "77"),
            (4, None, " ", "Gamma", None, None, None, None, None, "(pending)"),
            (5, None, None, None, None, None, None, None, None, "88"),
        ],
        LIST,
    )


def test_list_operations_prefer_a_and_maps_prefer_b(spark):
    a = spark.createDataFrame([(1, " X", "a1"), (2, "x", "a2"), (3, "y", "a3"), (4, " ", "blank")], "seq int, id string, v string")
    b = spark.createDataFrame([(1, "X ", "b1"), (2, "z", "b2")], "seq int, id string, v string")
    assert rows(catalog.keyed_union(a, b, "id"), "_src", "_pos", "v") == [(0, 1, "a2"), (0, 3, "a3"), (1, 2, "b2")]
    assert rows(catalog.keyed_intersect(a, b, "id"), "v") == [("a2",)]
    assert rows(catalog.keyed_difference(a, b, "id"), "v") == [("a3",)]
    m, n = (spark.createDataFrame(x, "key string, v string") for x in ([("k", "a"), ("l", "a")], [("k", "b"), ("m", "b")]))
    assert rows(catalog.map_union(m, n)) == [("k", "b"), ("l", "a"), ("m", "b")]
    assert rows(catalog.map_intersect(m, n)) == [("k", "a")]
    assert rows(catalog.map_difference(m, n)) == [("l", "a")]


def test_catalog(spark):
    rules = spark.createDataFrame([("Alpha", [" u1 ", "u2"]), ("Solo", [])], "school string, alt_urls array<string>")
    result = "school_name string, base_url string, alt_url string, pages_with_contacts array<string>, contacts array<string>, error string"
    still = spark.createDataFrame([(" alpha ", "b0", "", ["/p"], ["c"], "late"), ("New", None, None, [], [], None)], result)
    done = spark.createDataFrame([("ALPHA", "b1", None, [], [], " "), ("Beta", None, None, ["/q"], ["c", "d"], "missing website")], result)
    merged = {r.school_name: r for r in catalog.merge_catalog(rules, still, done).collect()}
    assert list(merged) == ["Alpha", "Beta", "New", "Solo"]
    alpha = merged["Alpha"]
    assert (alpha.base_url, alpha.alt_url, alpha.pages_with_contacts, alpha.n_contacts, alpha.error) == ("b1", "u1", ["/p"], 1, "late")
    combined = catalog.combine_results(still, done)
    assert catalog.scrape_coverage(combined).first().asDict() == dict(total=4, missing_website=1, no_contacts=2, with_contacts=1)
    lists = rows(catalog.export_lists(rules, still, done))
    assert ("schools_with_empty_alt_urls", "Solo", None, None, [], 0, None) in lists and sum(x[0] == "all_school_names" for x in lists) == 4
    assert ("all_school_names", "Alpha", "b1", "u1", ["/p"], 1, "late") in lists


def test_rule_edits(spark):
    rules = spark.createDataFrame([("A", ["1", "2"]), ("B", ["3"]), ("C", None), ("D", ["4"])], "school string, alt_urls array<string>")
    new = spark.createDataFrame([("A", ["2", " 5"]), ("E", ["6", "6"])], "school string, alt_urls array<string>")
    assert rows(catalog.bulk_add_rules(rules, new)) == [("A", ["1", "2", "5"]), ("B", ["3"]), ("C", None), ("D", ["4"]), ("E", ["6"])]
    edits = spark.createDataFrame(
        [("A", "remove", ["1"], None), ("B", "rename", None, "A"), ("C", "add", ["9", "9"], None), ("D", "rename", None, " N "), ("Z", "replace", ["0"], None)],
        "school string, action string, urls array<string>, new_name string",
    )
    assert rows(catalog.rename_or_edit_rules(rules, edits)) == [("A", ["2"]), ("B", ["3"]), ("C", ["9"]), ("N", ["4"])]
    names = spark.createDataFrame([("A",), ("a",)], "school string")
    assert rows(catalog.bulk_delete_by_names(rules, names), "school") == [("B",), ("C",), ("D",)]


def test_merge_upsert(spark):
    target = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (None, "n", "z")], "id int, v string, w string")
    new = spark.createDataFrame([(1, "old", 1), (1, "new", 2), (3, "c", 3), (None, "m", 4), (None, "m", 5)], "id int, v string, seq int")
    out = merge.merge_upsert(target, new, ["id"], seq="seq", defaults={"w": F.lit("d")})
    assert rows(out) == [
        (None, "m", "d", "insert"), (None, "m", "d", "insert"), (None, "n", "z", "keep"),
        (1, "new", "x", "update"), (2, "b", "y", "keep"), (3, "c", "d", "insert"),
    ]
    again = merge.merge_upsert(out.drop("_action").filter("id is not null"), new.filter("id is not null"), ["id"], seq="seq")
    assert again.filter("_action = 'insert'").isEmpty()


def test_facilities(spark, listed):
    got = {r.facility_key: r for r in merge.facility_rows(listed).collect()}
    assert set(got) == {"cook|alpha hs|chicago|60601", "nces|77", "nces|88"}
    assert (got["cook|alpha hs|chicago|60601"].phone_number, got["cook|alpha hs|chicago|60601"].admin) == ("2", "Ann")
    assert got["nces|77"].county_name == "O'Brien" and got["nces|77"].phone_number is None
    assert got["nces|88"].name == "Unknown School"
    assert rows(merge.county_rows(listed)) == [("Cook",), ("O'Brien",)]
    sheet = spark.createDataFrame([("Cook", "A", None, "1", "7.0", "x")], "CountyName string, FacilityName string, City string, Zip string, StRep string, StSen string")
    built = catalog.build_facilities(sheet, ("StRep", "StSen")).first()
    assert (built.FacilityKey, built.StRep, built.StSen) == ("Cook|A|None|1", 7, None)


def test_staff(spark):
    staff = spark.createDataFrame(
        [(42, "JANE Doe", "jane@a.edu", "Principal", "k", "111-OLD", True, dt.datetime(2026, 4, 1)), (None, "Bo", None, None, "k", None, True, None)],
        "staff_id int, name string, email string, job_name string, school_worked_at string, phone string, is_verified boolean, last_verified_at timestamp_ntz",
    )
    new = spark.createDataFrame(
        [("Jane  doe", "Jane@a.edu", "principal", "k", "1", 1), ("Jane Doe", "jane@a.edu", "Principal", "k", "999", 2), ("Bo", None, None, "k", "5", 3)],
        "name string, email string, job_name string, school_worked_at string, phone string, seq int",
    )
    out = merge.upsert_staff(staff, new, ["seq"])
    assert rows(out, "staff_id", "phone", "is_verified", "_action") == [
        (None, None, True, "keep"), (None, "5", None, "insert"), (42, "999", True, "update")
    ]
    reset = merge.upsert_staff(staff, new, ["seq"], reset_verification=True).filter("staff_id = 42").first()
    assert reset.is_verified is False and reset.last_verified_at is None


STAFF = "staff_id bigint, name string, email string, job_name string, school_worked_at string, phone string, is_verified boolean"


def test_staff_keys_with_many_rows(spark):
    """Many stored rows of one key (with ids, without, with repeated ids): only the highest id changes."""
    hot = [(k, "Ann Lee", "a@b.c", "Dean", "s1", str(k), True) for k in range(300)] + [(299, "Ann Lee", "a@b.c", "Dean", "s1", "again", True)]
    hot += [(None, "Ann Lee", "a@b.c", "Dean", "s1", "no id", True)] * 40 + [(900 + k, None, None, None, None, "x", False) for k in range(20)]
    staff = spark.createDataFrame([*hot, (7000, "Bo", None, None, "s2", "1", False)], STAFF)
    new = spark.createDataFrame(
        [(" ann  LEE", "A@B.C", "dean", "S1", "new", 1), ("Ann Lee", "a@b.c", "Dean", "s1", "newest", 2), ("Cy", None, None, "s3", "3", 3), ("Bo", None, None, "s2", None, 4)],
        "name string, email string, job_name string, school_worked_at string, phone string, seq int",
    )
    out = merge.upsert_staff(staff, new, ["seq"])
    assert out.columns == [*staff.columns, "_action"] and out.count() == staff.count() + 1
    changed = rows(out.filter("_action <> 'keep'"), "staff_id", "name", "phone", "_action")
    assert changed == [(None, "Cy", "3", "insert"), (299, "Ann Lee", "newest", "update"), (299, "Ann Lee", "newest", "update"), (7000, "Bo", None, "update")]
    kept = rows(out.filter("_action = 'keep'").drop("_action"))
    assert kept == rows(staff.filter("staff_id is null or staff_id not in (299, 7000)"))


def test_staff_target_is_read_once(spark, tmp_path):
    spark.createDataFrame([(1, "Ann", "a", "Dean", "s", "1", True)], STAFF).write.parquet(str(tmp_path / "staff"))
    new = spark.createDataFrame([("Ann", "a", "Dean", "s", "2", 1)], "name string, email string, job_name string, school_worked_at string, phone string, seq int")
    out = merge.upsert_staff(spark.read.parquet(str(tmp_path / "staff")), new, ["seq"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and "Join" not in plan
    assert rows(out, "staff_id", "phone", "_action") == [(1, "2", "update")]


def test_merges_are_counted_while_written(spark, tmp_path):
    target = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "k string, v int")
    evaluated = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def seen(v):
        evaluated.add(1)
        return v

    incoming = spark.createDataFrame([("a", 9), ("d", 4)], "k string, v int").withColumn("v", seen("v"))
    merged = merge.merge_upsert(target, incoming, ["k"])
    found = merge.write_counted(merged, str(tmp_path / "out"), "t")
    assert found == [("t", "insert", 1), ("t", "update", 1), ("t", "keep", 2), ("t", "unique_incoming", 2)]
    assert evaluated.value == 2  # once per incoming row
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == [("a", 9), ("b", 2), ("c", 3), ("d", 4)]
    none = merge.merge_upsert(target.limit(0), incoming.limit(0), ["k"])
    assert merge.write_counted(none, str(tmp_path / "none"), "t") == []


def test_city_directory_contacts(spark):
    slots = lambda a, b: {"administrator": {"title": "P", "name": a}, "second": {"title": "AP", "name": b}}
    directory = spark.createDataFrame(
        [("Lane Tech", "1", "w", slots(" ", "Sue"), 1), ("Other", None, None, slots("Al", "Bo"), 2), (" ", None, None, slots("X", "Y"), 3)],
        "name string, phone string, website string, contacts map<string,struct<title:string,name:string>>, seq int",
    )
    assert rows(merge.contact_rank(directory), "facility_key", "contact_rank", "contact_name") == [
        ("cps|lane-tech", "1", "Sue"), ("cps|other", "1", "Al"), ("cps|other", "2", "Bo")
    ]
    assert rows(merge.city_school_rows(directory), "facility_key", "admin") == [("cps|lane-tech", "Sue"), ("cps|other", "Al")]


def test_optional_id(spark):
    target = spark.createDataFrame([(1, "a")], "id bigint, v string")
    new = spark.createDataFrame([("1", "b", 1), (" 1.0", "c", 2), ("none", "d", 3), ("9", "e", 4)], "id string, v string, seq int")
    assert rows(merge.upsert_by_optional_id(target, new, "id", "seq")) == [(None, "d", "insert"), (1, "c", "update"), (9, "e", "insert")]


def test_school_list(spark):
    schema = "seq int, FacilityName string, City string, Website string"
    old = spark.createDataFrame([(1, " Alpha ", "X", "w1"), (2, "alpha", "x", "w2"), (3, "Beta", "Y", "w3")], schema)
    new = spark.createDataFrame([(1, "ALPHA", "X", None), (2, "Gamma", "Z", "g1"), (3, "gamma", "Z", ""), (4, "alpha", "x", "w9")], schema)
    out = merge.merge_school_list(old, new, ["FacilityName", "City", "Website"])
    assert rows(out, "FacilityName", "City", "Website", "_action") == [
        ("Beta", "Y", "w3", "keep"), ("alpha", "x", "w9", "update"), ("gamma", "Z", "", "insert")
    ]
    assert merge.merge_school_list_counts(out).first().asDict() == dict(inserted=1, updated=3, total=3)


def test_dedupe(spark):
    data = spark.createDataFrame(
        [(1, "St. X & Co", "Chicago", "http://aa"), (2, "saint x and co, IL", "chicago", "https://b"), (3, "St X & CO", "Chicago ", "http://cccccc"), (4, "Y", None, None)],
        "seq int, FacilityName string, City string, Website string",
    )
    assert rows(merge.dedupe_facilities(data), "seq", "FacilityName", "Website") == [(1, "St. X & Co", "http://cccccc"), (4, "Y", "")]
    urls = spark.createDataFrame(
        [(1, " A  b", "C", "http://x"), (2, "a B", " c ", "https://x"), (3, " ", "", None), (4, "a b", "c", "http://longer.example")],
        "seq int, `School Name` string, City string, Homepage string",
    )
    assert rows(merge.dedupe_url_rows(urls), "seq", "school_name", "homepage") == [(1, "A  b", "http://longer.example")]
    contacts = spark.createDataFrame(
        [(1, "s", "Ann", "Dean", "", "1", "A@x"), (2, "s", " ann", "DEAN", None, "1 ", "a@x"), (3, "s", "Ann", "Dean", "", "2", "a@x")],
        "ord int, site string, name string, title string, dept string, phone string, email string",
    )
    assert rows(merge.dedupe_contacts(contacts, ["site"], ["ord"]), "ord") == [(1,), (3,)]


def test_imports(spark):
    target = spark.createDataFrame(
        [("k1", "Alpha", "Old", "a", "c", "z", "t", "manual", True, True, "high")],
        "facility_key string, name string, county_name string, address string, city string, zipcode string, type_of_school string, data_source string, is_active boolean, is_verified boolean, priority_tier string",
    )
    new = spark.createDataFrame(
        [("ALPHA", "Cook", "a2", "c2", "z2", "middle_school", 1), ("New", "Lake", "", "", "", "high_school", 2), ("new", "Will", "", "", "", "high_school", 3)],
        "name string, county string, address string, city string, zip_code string, school_type string, seq int",
    )
    out = {r._action: r for r in merge.import_schools(target, new).collect()}
    u, i = out["update"], out["insert"]
    assert (u.facility_key, u.name, u.county_name, u.type_of_school, u.is_verified, u.priority_tier) == ("k1", "Alpha", "Cook", "Middle School", True, "high")
    assert i.name == "New" and i.facility_key and i.is_verified is False and i.priority_tier == "standard"
    assert out["duplicate_in_batch"].name == "new"

    staff = spark.createDataFrame(
        [(5, "Old Name", "9", "a@x", "principal", "k0", False, "manual", True)],
        "staff_id bigint, name string, phone string, email string, job_name string, school_worked_at string, is_active boolean, data_source string, is_verified boolean",
    )
    links = spark.createDataFrame([("k1", 5)], "school_id string, staff_id bigint")
    batch = spark.createDataFrame(
        [("Ann", "Lee", "A@X", None, "counselor", "k1", 1), ("Bo", "", "b@x", "1", "principal", "k2", 2), ("Cy", "D", "", "", "principal", "", 3)],
        "first_name string, last_name string, email string, phone string, role string, school_id string, seq bigint",
    )
    done = merge.import_contacts(staff, links, batch)
    assert rows(done.staff, "staff_id", "name", "phone", "is_active", "is_verified", "_action") == [
        (5, "Ann Lee", None, True, True, "update"), (8, "Bo", "1", True, False, "insert"), (9, "Cy D", "", True, False, "insert")
    ]
    assert rows(done.junction) == [("k1", 5), ("k2", 8)]


def test_edits(spark):
    schools = spark.createDataFrame([("s1",), ("s2",)], "facility_key string")
    staff = spark.createDataFrame([(1, "A B", "a@x", "s1"), (2, "C", "c@x", "s2"), (3, "D", None, None)], "staff_id int, name string, email string, school_worked_at string")
    links = spark.createDataFrame([("s2", 1), ("s1", 2), ("s2", 3)], "school_id string, staff_id int")
    t = merge.cascade_delete_school(schools, staff, links, spark.createDataFrame([("s1",)], "school_id string"))
    assert rows(t.schools) == [("s2",)] and rows(t.staff, "staff_id") == [(2,), (3,)] and rows(t.junction) == [("s2", 3)]
    assert rows(t.deleted_staff) == [(1,)]
    left, linked = merge.delete_contacts(staff, links, spark.createDataFrame([(1,), (1,), (9,), (None,)], "staff_id int"))
    assert rows(left, "staff_id") == [(2,), (3,)] and rows(linked) == [("s1", 2), ("s2", 3)]
    assert left.columns == staff.columns and linked.columns == links.columns
    patches = spark.createDataFrame(
        [(1, 1, None, "Zed", None, None, ["last_name"]), (1, 2, None, None, None, None, ["email"]), (2, 3, None, None, None, "s9", ["school_id"])],
        "staff_id int, seq int, first_name string, last_name string, email string, school_id string, provided array<string>",
    )
    out, moved = merge.patch_contacts(staff, links, patches)
    assert rows(out) == [(1, "A Zed", None, "s1"), (2, "C", "c@x", "s9"), (3, "D", None, None)]
    assert rows(moved) == [("s2", 1), ("s2", 3), ("s9", 2)]
    marked = merge.mark_verified(
        spark.createDataFrame([(1, None, None), (2, False, None)], "id int, is_verified boolean, last_verified_at timestamp_ntz"),
        spark.createDataFrame([(1,), (1,), (7,)], "id int"), "id", "2024-01-01",
    )
    assert rows(marked) == [(1, True, dt.datetime(2024, 1, 1)), (2, False, None)]


def test_calendar(spark):
    records = spark.createDataFrame(
        [("k1", "Fair", "X", ("04/23/2026", "1:00 PM", ("3:30 PM",)), "n", 1), ("k1", "Fair 2", "X", ("04/24/2026", "13:00", (None,)), None, 2)],
        "id string, field_2 string, field_3 string, field_1_raw struct<date:string,time_formatted:string,to:struct<time_formatted:string>>, field_38 string, seq int",
    )
    target = merge.calendar_events(records.limit(0))
    assert rows(merge.upsert_calendar_events(target, records), "external_id", "name", "date", "start_time", "end_time", "_action") == [
        ("k1", "Fair 2", "2026-04-24", "13:00:00", None, "insert")
    ]


def replay(base, log):
    """The action log one by one."""
    table = dict(base)
    for seq, op, key, value in log:
        if op == "SET":
            table = {}
        elif op == "ADD" or (op == "UPDATE" and key in table):
            table[key] = (value, False)
        elif op == "DELETE":
            table.pop(key, None)
        elif op == "VERIFY" and key in table:
            table[key] = (table[key][0], True)
    return table


@pytest.mark.parametrize("with_set", [False, True])
def test_action_log_equals_replay(spark, with_set):
    rng = random.Random(11)
    base = {k: (f"base{k}", False) for k in range(0, 80, 2)}
    log = [(i, rng.choice(["ADD", "UPDATE", "DELETE", "VERIFY"]), rng.randrange(100), f"v{i}") for i in range(400)]
    if with_set:
        log[150] = (150, "SET", None, None)
    b = spark.createDataFrame([(k, *v) for k, v in base.items()], "id int, v string, is_verified boolean")
    c = spark.createDataFrame(
        [(s, op, k, (v, False), dt.datetime(2024, 1, 1)) for s, op, k, v in log],
        "seq int, op string, id int, payload struct<v:string,is_verified:boolean>, at timestamp_ntz",
    )
    got = {r.id: (r.v, r.is_verified) for r in merge.apply_changes(b, c, "id").collect()}
    assert got == replay(base, log)


def test_cascade_equals_replay(spark):
    rng = random.Random(5)
    base = {k: k % 5 for k in range(40)}
    log, cuts = [], []
    for seq in range(300):
        if rng.random() < 0.15:
            cuts.append((seq, rng.randrange(5)))
        else:
            log.append((seq, rng.choice(["ADD", "UPDATE", "DELETE"]), rng.randrange(50), rng.randrange(5)))
    parent, want = dict(base), set()
    for seq, kind, a, b in sorted([(s, "cut", p, None) for s, p in cuts] + [(s, op, k, p) for s, op, k, p in log]):
        if kind == "cut":
            for k in [k for k, p in parent.items() if p == a]:
                want.add((k, seq))
                del parent[k]
        elif kind == "DELETE":
            parent.pop(a, None)
        else:
            parent[a] = b
    b = spark.createDataFrame(list(base.items()), "id int, school int")
    c = spark.createDataFrame([(s, op, k, (p,)) for s, op, k, p in log], "seq bigint, op string, id int, payload struct<school:int>")
    d = spark.createDataFrame([(p, s) for s, p in cuts], "school int, seq bigint")
    assert {tuple(r) for r in merge.cascade_changes(b, c, "id", "school", d).collect()} == want


def test_school_and_contact_logs_equal_replay(spark):
    rng = random.Random(21)
    schools, contacts = {s: "s" for s in range(6)}, {c: c % 6 for c in range(30)}
    school_log, contact_log = [], []
    for seq in range(400):
        if rng.random() < 0.2:
            school_log.append((seq, rng.choice(["ADD", "DELETE", "UPDATE"]), rng.randrange(8), (f"n{seq}",)))
        else:
            contact_log.append((seq, rng.choice(["ADD", "UPDATE", "UPDATE", "DELETE"]), rng.randrange(40), (rng.randrange(8),)))
    want_s, want_c = dict(schools), dict(contacts)
    for seq, op, key, payload, kind in sorted([(*x, "s") for x in school_log] + [(*x, "c") for x in contact_log]):
        table = want_s if kind == "s" else want_c
        if op == "DELETE":
            table.pop(key, None)
            if kind == "s":
                want_c = {c: s for c, s in want_c.items() if s != key}
        elif op == "ADD" or key in table:
            table[key] = payload[0]
    now = dt.datetime(2024, 1, 1)
    make = spark.createDataFrame
    got_s, got_c = merge.apply_school_changes(
        make(list(schools.items()), "school_id int, name string"),
        make(list(contacts.items()), "contact_id int, school_id int"),
        make([(*x, now) for x in school_log], "seq bigint, op string, school_id int, payload struct<name:string>, at timestamp_ntz"),
        make([(*x, now) for x in contact_log], "seq bigint, op string, contact_id int, payload struct<school_id:int>, at timestamp_ntz"),
    )
    assert dict(got_s.collect()) == want_s and dict(got_c.collect()) == want_c
