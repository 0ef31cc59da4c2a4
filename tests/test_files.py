"""Readers, writers and report shapes."""

import json

import pytest
from frames import rows
from pyspark.sql import functions as F

from canvasser import schema as M
from canvasser.sources import files, sinks


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿Name,City\nA, x\n\n\"B, \"\"q\"\"\",007\n".encode())
    assert rows(files.read_csv_records(spark, str(tmp_path / "a.csv"))) == [("A", " x"), ('B, "q"', "007")]


def test_json_lists(spark, tmp_path):
    items = [
        {"FacilityName": " Alpha ", "City": "X", "Website": ""}, {"SchoolName": "B", "city": "Y", "website": "w"},
        {"School Name": "C", "Homepage": "h"}, {"FacilityName": "", "base_url": "b"}, "text", 5,
        {"FacilityName": "D", "school_urls": {"base_url": "", "alt_url": "alt"}},
    ]
    (tmp_path / "l.json").write_text(json.dumps(items))
    assert rows(files.read_school_list(spark, str(tmp_path / "l.json"), keyed=False)) == [
        ("", "", "b"), ("Alpha", "X", ""), ("B", "Y", "w"), ("C", "", "h"), ("D", "", "alt")
    ]
    (tmp_path / "k.json").write_text(json.dumps({"Key A": {"City": "X"}, "Key B": {"FacilityName": "B"}}))
    assert rows(files.read_school_list(spark, str(tmp_path / "k.json"), keyed=True)) == [("B", "", ""), ("Key A", "X", "")]
    blobs = files.read_keyed_json(spark, str(tmp_path / "k.json"), M.LOOSE_OBJECT)
    assert rows(blobs, "key") == [("Key A",), ("Key B",)]
    (tmp_path / "bad.json").write_text('{"a": 1}')
    with pytest.raises(Exception, match="JSON array is expected"):
        files.read_school_list(spark, str(tmp_path / "bad.json"), keyed=False).collect()


def test_keyed_entries_of_any_type(spark, tmp_path):
    (tmp_path / "a.json").write_text('\n {"n": 1.5, "t": "x", "l": [1, {"a": 2}], "o": {"City": "X"}, "z": null, "b": true, "n": 7, "é \\" k": ""}')
    (tmp_path / "b.json").write_text('{"n": "other file"}')
    path = str(tmp_path / "*.json")
    got = files.read_keyed_json(spark, path)
    assert rows(got.select("key", F.to_json("value"))) == [
        ("b", "true"), ("l", '[1,{"a":2}]'), ("n", '"other file"'), ("n", "7"), ("o", '{"City":"X"}'), ("t", '"x"'), ("z", "null"), ('é " k', '""'),
    ]
    typed = files.read_keyed_json(spark, path, M.LOOSE_OBJECT)
    assert [(r.key, r.value) for r in typed.collect() if r.value is not None] == [("o", {"City": "X"})]
    (tmp_path / "bad.json").write_text("[1]")
    with pytest.raises(Exception, match="JSON object is expected"):
        files.read_keyed_json(spark, str(tmp_path / "bad.json")).collect()
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "e.json").write_text("{}")
    assert files.read_keyed_json(spark, str(tmp_path / "none")).count() == 0


def test_result_map(spark, tmp_path):
    blob = {"A": {"school_urls": {"base_url": "b", "pages_with_contacts": ["p"]}, "contacts": [{"name": "N", "title": "T"}], "error": None}}
    (tmp_path / "c.json").write_text(json.dumps(blob))
    out = files.read_keyed_json(spark, str(tmp_path / "c.json"), M.RESULT_BLOB).select("key", "value.school_urls.base_url", F.col("value.contacts")[0]["title"])
    assert [tuple(r) for r in out.collect()] == [("A", "b", "T")]


def test_sheets(spark):
    cols = [f"c{i}" for i in range(13)]
    row = lambda name: tuple(name if i == 0 else "sch" if i == 1 else "12" if i == 12 else "" for i in range(13))
    sheets = {0: spark.createDataFrame([row("skip")], cols), 1: spark.createDataFrame([row("a")], cols), 5: spark.createDataFrame([row("b")], cols).withColumn("extra", F.lit("e"))}
    assert rows(files.union_sheets(sheets), "c0", "extra") == [("a", None), ("b", "e")]
    assert files.pick_sheet(["Intro", "My Schools"], "school", 0) == 1 and files.pick_sheet(["x"], "contact", 1) == 1


def test_csv_out(spark, tmp_path):
    df = spark.createDataFrame([("a,b", 'say "x"', None), (" s ", "", "plain")], "p string, q string, r string")
    assert [r[0] for r in sinks.csv_lines(df, ["p", "q", "r"]).collect()] == ['"a,b","say ""x""",', " s ,,plain"]
    sinks.write_contact_csv(df, ["p", "q"], str(tmp_path / "o"))
    assert rows(files.read_csv_records(spark, str(tmp_path / "o"))) == [(" s ", None), ("a,b", 'say "x"')]
    sinks.append_records(df, str(tmp_path / "runs"), "r1")
    sinks.append_records(df, str(tmp_path / "runs"), "r2")
    sinks.append_records(df, str(tmp_path / "runs"), "r2")
    assert spark.read.csv(str(tmp_path / "runs"), header=True).count() == 4


def test_labels_and_mails(spark, tmp_path):
    contacts = spark.createDataFrame(
        [(1, 7, "Ann", "Lee", "a@x", None, "principal"), (2, 9, "Bo", "", "", "1", "odd"), (1001, 7, "C", "D", "c@x", "", "counselor")],
        "contact_id int, school_id int, first_name string, last_name string, email string, phone string, role string",
    )
    schools = spark.createDataFrame(
        [(7, "Alpha", "Cook", "1 Main", "X", "IL", "60601")], "school_id int, name string, county string, address string, city string, state string, zip_code string"
    )
    labels = rows(sinks.mailing_labels(contacts, schools))
    assert labels[0] == (1, "Ann Lee\nAlpha\n1 Main\nX, IL 60601") and labels[2] == (2, "Bo \n\n\n,  ")
    table = sinks.contact_csv_columns(contacts, schools)
    assert table.columns[0] == "firstName" and rows(table, "role", "zipCode")[0] == (None, "")
    assert rows(sinks.email_list(contacts, "school_id", "contact_id")) == [(7, 0, 1, "a@x"), (7, 1, 1, "c@x"), (9, 0, 1, "")]
    sinks.write_email_list(contacts.coalesce(1), "contact_id", str(tmp_path / "m"))
    parts = sorted(p.read_text() for p in (tmp_path / "m").glob("part-*"))
    assert "".join(parts).count(", ") == 3
    sinks.write_mailing_labels(sinks.mailing_labels(contacts, schools), str(tmp_path / "labels"))
    assert sum(p.read_text().count("\n\n---\n\n") for p in (tmp_path / "labels").glob("part-*")) == 3


def test_snapshot(spark, tmp_path):
    a = spark.createDataFrame([(1, None, ["x"])], "id int, v string, l array<string>")
    sinks.export_snapshot({"a": a}, str(tmp_path / "s"))
    assert sinks.import_snapshot(spark, str(tmp_path / "s"), {"a": a.schema})["a"].collect() == a.collect()
    lists = spark.createDataFrame([("t", "A"), ("u", "B")], "list_type string, school_name string")
    sinks.write_lists(lists, str(tmp_path / "l"))
    assert sorted(p.name for p in (tmp_path / "l").glob("list_type=*")) == ["list_type=t", "list_type=u"]
