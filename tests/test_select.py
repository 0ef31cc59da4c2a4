"""Loaders, filters, searches, joins and the fuzzy match."""

import datetime as dt
import random

from frames import rows
from pyspark.sql import functions as F

from canvasser.operators import filters, fuzzy, joins
from canvasser.sources import tables

SCHOOL = "facility_key string, name string, district_id int, county_name string, address string, city string, zipcode string, type_of_school string, is_active boolean, is_verified boolean, data_source string, priority_tier string"


def test_load_schools_defaults(spark):
    raw = spark.createDataFrame(
        [("b", "Zed", 3, None, None, None, None, "Junior High", None, None, None, None), ("a", "Abe", None, "Cook", "x", "y", "z", None, False, True, "scraped", "high")], SCHOOL
    )
    got = tables.load_schools(raw).collect()
    assert [tuple(r) for r in got] == [
        ("a", "Abe", None, "Cook", "x", "y", "IL", "z", "high_school", False, True, "scraped", "high"),
        ("b", "Zed", "3", "", "", "", "IL", "", "middle_school", True, False, "manual", "standard"),
    ]


def test_contacts_and_events(spark):
    staff = spark.createDataFrame(
        [(1, "Ann Lee", None, None, "s0", None, None, None, None), (2, None, "e", "Dean of Math", None, "p", False, "imported", True), (3, "X", None, None, "s3", None, None, None, None)],
        "staff_id bigint, name string, email string, job_name string, school_worked_at string, phone string, is_active boolean, data_source string, is_verified boolean",
    )
    links = spark.createDataFrame([("s1", 1, 2), ("s9", 1, 1), ("s5", None, 3)], "school_id string, staff_id bigint, seq bigint")
    assert rows(tables.load_contacts(staff, links), "contact_id", "last_name", "role", "school_id", "is_active", "is_verified") == [
        ("1", "Lee", "principal", "s1", True, False), ("2", "", "math_teacher", "", False, True), ("3", "", "principal", "s3", True, False)
    ]
    raw = spark.createDataFrame(
        [(1, " a, b,,a", "Hall", None, None, True, None), (2, None, None, dt.datetime(2020, 1, 1), 5, None, None), (3, "", "L", None, None, False, "Fair")],
        "event_id bigint, schools_involved string, location string, date timestamp_ntz, attendance int, is_scraped boolean, fair_name string",
    )
    events = tables.load_events(raw, "2024-01-01")
    assert rows(events, "event_id", "name", "type", "date") == [
        ("e_1", "Hall", "outreach_fair", dt.datetime(2024, 1, 1)), ("e_2", "Untitled Event", "other", dt.datetime(2020, 1, 1)), ("e_3", "Fair", "other", dt.datetime(2024, 1, 1))
    ]
    assert rows(tables.explode_participants(events)) == [("e_1", "a"), ("e_1", "a"), ("e_1", "b")]
    assert rows(joins.events_for_school(events, "a"), "event_id") == [("e_1",)]


def test_city_directory(spark):
    head = spark.createDataFrame([(1, 10, "A HS", True), (2, 11, "B", False), (3, 12, "A HS", True)], "seq int, school_id int, school_name string, is_high_school boolean")
    profiles = spark.createDataFrame(
        [(1, 10, "A HS", "1", "w1"), (2, 11, "B", "2", "w2"), (3, 12, "A HS", "3", "w3")], "seq int, school_id int, school_name string, phone string, website string"
    )
    for slot in ["administrator", "second", "third", "fourth", "fifth", "sixth", "seventh"]:
        profiles = profiles.withColumns({f"{slot}_title": F.lit(slot), f"{slot}_name": F.lit(None).cast("string")})
    got = tables.build_city_directory(head, profiles).collect()
    assert [(r.name, r.phone, r.website, len(r.contacts), r.contacts["third"].title) for r in got] == [("A HS", "3", "w3", 7, "third")]


def test_high_school_sheet(spark):
    cols = [f"c{i}" for i in range(14)]
    cols[1], cols[5], cols[12] = "token", "Mailing Address", "Grades"
    make = lambda token, grades: tuple(token if i == 1 else grades if i == 12 else "x" for i in range(14))
    sheet = spark.createDataFrame([make("Pub SCH", "9-12"), make("sch", "112"), make("school", "12"), make("sch", "K-8"), make("sch", None), make("sch", "12")], cols)
    out = filters.filter_high_school_facilities(sheet)
    assert out.count() == 2 and "MailingAddress" in out.columns and "Affiliation" in out.columns
    assert filters.filter_high_school_facilities(sheet.select(cols[:12])).columns == []


def test_filters_and_pages(spark):
    contacts = spark.createDataFrame([(i, i % 3, f"N{i}", i % 2 == 0, None if i == 4 else i % 4 == 0) for i in range(10)], "contact_id int, school_id int, name string, is_active boolean, is_verified boolean")
    schools = spark.createDataFrame([(0, "Cook", "high_school"), (1, "Lake", "high_school")], "school_id int, county string, school_type string")
    part = spark.createDataFrame([("e1", 1), ("e1", 1)], "event_id string, school_id int")
    events = spark.createDataFrame([("e1",)], "event_id string")
    ids = lambda df: [r[0] for r in rows(df, "contact_id")]
    assert ids(filters.filter_contacts(contacts, verified=False, active=True)) == [2, 4, 6]
    assert ids(filters.target_list(contacts, schools, events, part)) == [0, 8]
    assert ids(filters.target_list(contacts, schools, events, part, include_unverified=True, county="Cook")) == [0, 6]
    assert ids(filters.target_list(contacts, schools, events, part, active_only=False, include_unverified=True, event_id="e1")) == [1, 4, 7]
    assert ids(filters.target_list(contacts, schools, events, part, event_id="nope")) == [0, 8]
    assert [r.contact_id for r in filters.paginate(contacts, [F.desc("contact_id")], 1, 4).collect()] == [5, 4, 3, 2]
    assert [r.contact_id for r in filters.keyset_page(contacts, "contact_id", 6, 2).collect()] == [7, 8]
    assert [r.contact_id for r in filters.table_view(contacts, "n1", ["name"], F.asc("name"), "contact_id").collect()] == [1]


def test_search(spark):
    schools = spark.createDataFrame([(i, f"School {i}", "Cook", "X", None) for i in range(7)], "school_id int, name string, county string, city string, district string")
    contacts = spark.createDataFrame([(1, "Sch", "ool", ""), (2, "a", "b", "me@SCHOOL.org")], "contact_id int, first_name string, last_name string, email string")
    events = spark.createDataFrame([("e", "x", "At school")], "event_id string, name string, location string")
    hits = rows(filters.global_search(schools, contacts, events, " School "), "entity", "id")
    assert hits == [("contact", "2"), ("event", "e")] + [("school", str(i)) for i in range(5)]
    assert filters.global_search(schools, contacts, events, "  ").isEmpty()
    assert filters.global_search(schools, contacts, events, "100%").isEmpty()


def test_name_lookup_and_progress(spark):
    schools = spark.createDataFrame([(1, "Alpha"), (2, "ALPHA"), (3, "Beta")], "school_id int, name string")
    extra = spark.createDataFrame([(9, "beta")], "school_id int, name string")
    asked = spark.createDataFrame([(1, "alpha"), (2, "BETA"), (3, "none"), (4, None)], "row int, school_name string")
    assert rows(joins.resolve_school_name(asked, schools, extra), "row", "school_id") == [(1, "2"), (2, "9"), (3, ""), (4, "")]
    todo = spark.createDataFrame([("St. A", "X"), ("B", "Y")], "FacilityName string, City string")
    done = spark.createDataFrame([("saint a", " x, IL"), ("c", "z")], "FacilityName string, City string")
    assert rows(joins.resume_pending(todo, done)) == [("B", "Y")]
    rules = spark.createDataFrame([("Alpha HS", ["u"]), ("Beta", [])], "school string, alt_urls array<string>")
    listed = spark.createDataFrame([("Alpha HS ", 0), ("Alpha HS", 4), ("Zed", 1)], "name string, pos int")
    assert rows(filters.catalog_search(rules, listed, " ALPHA")) == [("Alpha HS", 1, 0), ("Alpha HS", 1, 4)]


def naive_ratio(a, b):
    a, b = a.strip().lower(), b.strip().lower()
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return 200.0 * table[-1][-1] / (len(a) + len(b)) if a or b else 100.0


def test_ratio():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("ab c") for _ in range(rng.randint(0, 12))) for _ in range(2))
        assert abs(fuzzy.ratio(a, b) - naive_ratio(a, b)) < 1e-9
    assert fuzzy.ratio("Alpha", "alpha ") == 100.0 and fuzzy.ratio(None, "a") is None


def test_fuzzy_equals_all_pairs(spark):
    rng = random.Random(2)
    words = ["north", "south", "high", "school", "jr", "hs", "lincoln", "s", "central", "academy", "x"]
    names = sorted({" ".join(rng.choice(words).title() for _ in range(rng.randint(1, 5))) for _ in range(120)})
    labels = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 9))) for _ in range(200)]
    short = {"sr", "jr", "jr/sr", "sch", "chd", "int", "s", "hs"}
    want = {}
    for name in names:
        parts = name.lower().split()
        if len(parts) < 2:
            continue
        first = "high" if parts[1] in short else parts[1]
        last = "school" if parts[-1] in short else parts[-1]
        best = None
        for label in labels:
            if len(label.split()) <= 7 and first in label and last in label:
                score = naive_ratio(label, name)
                if score > 70 and (best is None or score > best[1]):
                    best = (label, score)
        if best:
            want[name] = (best[0], round(best[1], 6))
    left = spark.createDataFrame([(n,) for n in names], "school_name string")
    right = spark.createDataFrame([(x.upper() if i % 2 else x, i) for i, x in enumerate(labels)], "label string, pos int")
    got = {r.school_name: (r.label, round(r.score, 6)) for r in fuzzy.fuzzy_best_match(left, right).collect()}
    assert len(want) > 20 and got == want
    # A scope keeps names and labels of other sites apart.
    two = left.withColumn("site", F.lit(1)).unionByName(left.withColumn("site", F.lit(2)))
    scoped = fuzzy.fuzzy_best_match(two, right.withColumn("site", F.lit(1)), on=["site"])
    assert {r.school_name: (r.label, round(r.score, 6)) for r in scoped.collect()} == want
    assert scoped.filter("site = 2").isEmpty()
