"""Queries over the loaders, readers and writers."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvasser import schema as M
from canvasser.functions import text as X
from canvasser.operators import catalog, filters, metrics
from canvasser.plans.bindings import AS_OF, RESULT_CONTACT, Views
from canvasser.plans.registry import query
from canvasser.session import fresh_path
from canvasser.sources import files, sinks, tables
from canvasser.streaming.incremental import read_live, upsert_sink

# White space as the library trims it, for the checking engine's regular expressions.
WS = r"[\t-\r \x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def strip_sql(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def norm_sql(c: str) -> str:
    return f"coalesce(trim(regexp_replace(lower({c}), '{WS}+', ' ', 'g')), '')"


def clean_sql(c: str) -> str:
    return f"nullif({strip_sql(c)}, '')"


ROLE_SQL = """CASE WHEN lower(job_name) LIKE '%superintendent%' THEN 'superintendent'
  WHEN lower(job_name) LIKE '%principal%' THEN 'principal'
  WHEN lower(job_name) LIKE '%counselor%' OR lower(job_name) LIKE '%guidance%' THEN 'counselor'
  WHEN lower(job_name) LIKE '%computer science%' OR lower(job_name) LIKE '%computing%' THEN 'cs_teacher'
  WHEN lower(job_name) LIKE '%engineering%' THEN 'engineering_teacher'
  WHEN lower(job_name) LIKE '%math%' THEN 'math_teacher'
  WHEN lower(job_name) LIKE '%science%' THEN 'science_teacher' ELSE 'principal' END"""
LAST_LINK_SQL = "SELECT staff_id, arg_max(school_id, (seq, school_id)) AS linked FROM junction_rows GROUP BY staff_id"


@query("load_schools", "SELECT * FROM schools")
def load_schools(v: Views) -> DataFrame:
    return tables.load_schools(v.school_rows, key="school_id")


@query(
    "load_contacts",
    f"""WITH j AS ({LAST_LINK_SQL}), s AS (SELECT s.*, trim(coalesce(name, '')) AS n, linked FROM staff_rows s LEFT JOIN j USING (staff_id))
    SELECT cast(staff_id AS varchar) AS contact_id,
      CASE WHEN strpos(n, ' ') > 0 THEN substr(n, 1, strpos(n, ' ') - 1) ELSE n END AS first_name,
      CASE WHEN strpos(n, ' ') > 0 THEN substr(n, strpos(n, ' ') + 1) ELSE '' END AS last_name,
      coalesce(email, '') AS email, phone, {ROLE_SQL} AS role, coalesce(linked, school_worked_at, '') AS school_id,
      coalesce(is_active, true) AS is_active, coalesce(data_source, 'manual') AS data_source,
      coalesce(is_verified, false) AS is_verified FROM s""",
)
def load_contacts(v: Views) -> DataFrame:
    return tables.load_contacts(v.staff_rows, v.junction_rows)


LOAD_EVENTS_SQL = """SELECT 'e_' || event_id AS event_id, coalesce(fair_name, location, 'Untitled Event') AS name,
      CASE WHEN is_scraped THEN 'outreach_fair' ELSE 'other' END AS type,
      coalesce(date, timestamp '2001-08-01 00:00:00') AS date, coalesce(location, '') AS location,
      array_to_string(list_filter(list_transform(string_split(coalesce(schools_involved, ''), ','), lambda x: trim(x)),
        lambda x: x <> ''), '|') AS participants, cast(attendance AS bigint) AS attendees
    FROM event_rows"""


@query("load_events", LOAD_EVENTS_SQL)
def load_events(v: Views) -> DataFrame:
    out = tables.load_events(v.event_rows, AS_OF)
    return out.withColumn("participants", F.array_join("participants", "|"))


@query("load_activities", "SELECT * FROM activities")
def load_activities(v: Views) -> DataFrame:
    return tables.load_activities(v.activities)


@query("load_programs", "SELECT * FROM programs")
def load_programs(v: Views) -> DataFrame:
    return tables.load_programs(v.program_rows)


@query("load_pages", "SELECT page_id, url, html FROM pages")
def load_pages(v: Views) -> DataFrame:
    return tables.load_pages(v.table("pages"))


@query(
    "read_csv_records",
    """SELECT cast(school_id AS varchar) AS school_id, name, nullif(county, '') AS county, nullif(address, '') AS address,
      cast(is_active AS varchar) AS is_active FROM schools""",
)
def read_csv_records(v: Views) -> DataFrame:
    path = fresh_path(v.spark, "csv")
    cols = ["school_id", "name", "county", "address", "is_active"]
    sinks.write_contact_csv(v.schools, cols, path)
    return files.read_csv_records(v.spark, path)


def _sheet(v: Views, part: int) -> DataFrame:
    """The facility list as a 14-column spreadsheet."""
    blank = lambda name: F.lit("").alias(name)
    rows = v.facility_sheet.filter(F.col("seq") % 2 == part)
    return rows.select(
        "CountyName", "SearchToken", "FacilityName", "City", "Zip", blank("Mailing Address"), blank("Delivery Address"),
        blank("NCES ID"), blank("Region-2\nCounty-3\nDistrict-4"), blank("Type"), blank("School"), "StRep", "GradesServed", "seq",
    )


HIGH_SCHOOL_SQL = r"regexp_matches(GradesServed, '(?:^|[^0-9])12(?:[^0-9]|$)') AND regexp_matches(SearchToken, '(?i)\bsch\b')"


@query("union_sheets", f"SELECT seq, CountyName, FacilityName, City, Zip FROM facility_sheet WHERE {HIGH_SCHOOL_SQL}")
def union_sheets(v: Views) -> DataFrame:
    out = files.union_sheets({0: _sheet(v, 0), 1: _sheet(v, 0), 5: _sheet(v, 1)})
    return out.select("seq", "CountyName", "FacilityName", "City", "Zip")


@query(
    "filter_high_school_facilities",
    f"SELECT seq, FacilityName, '' AS MailingAddress, cast(NULL AS varchar) AS Affiliation FROM facility_sheet WHERE {HIGH_SCHOOL_SQL}",
)
def filter_high_school_facilities(v: Views) -> DataFrame:
    both = _sheet(v, 0).unionByName(_sheet(v, 1))
    return filters.filter_high_school_facilities(both).select("seq", "FacilityName", "MailingAddress", "Affiliation")


def _write_documents(rows: DataFrame, document: F.Column, stretch: F.Column, path: str) -> str:
    """One JSON document per stretch of rows (bounded by the stretch), each in a file of its own."""
    texts = rows.groupBy(stretch.alias("stretch")).agg(document.alias("text"))
    texts.write.partitionBy("stretch").text(path)
    return path + "/stretch=*"


@query(
    "read_json_records",
    """SELECT 'lines' AS form, activity_id, school_id, activity_type, date, description FROM activities
    UNION ALL SELECT 'array', activity_id, school_id, activity_type, date, description FROM activities""",
)
def read_json_records(v: Views) -> DataFrame:
    """The activities written and read back as lines, and as arrays of 1,000 that also hold other things."""
    rows, lines = v.activities, fresh_path(v.spark, "json")
    rows.write.json(lines)
    items = F.collect_list(F.to_json(F.struct(*rows.columns)))
    document = F.concat(F.lit(' [5, "text", null, [{"activity_id": 1}], '), F.array_join(items, ",\n"), F.lit("]\n"))
    arrays = _write_documents(rows, document, F.floor(F.col("activity_id") / 1000), fresh_path(v.spark, "arrays"))
    both = [("lines", files.read_json_records(v.spark, lines, rows.schema, lines=True)), ("array", files.read_json_records(v.spark, arrays, rows.schema))]
    first, second = (df.select(F.lit(form).alias("form"), "activity_id", "school_id", "activity_type", "date", "description") for form, df in both)
    return first.unionByName(second)


@query(
    "read_keyed_json",
    """WITH e AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'number' WHEN 1 THEN 'text' WHEN 2 THEN 'array' WHEN 3 THEN 'null' ELSE 'object' END AS kind,
      regexp_extract(props, '([0-9]+)', 1) AS k FROM events)
    SELECT 'School ' || event_id AS key, kind, CASE kind WHEN 'number' THEN k WHEN 'text' THEN 'City ' || k WHEN 'array' THEN '[' || k || ']' END AS plain,
      CASE WHEN kind = 'object' THEN 'School ' || event_id END AS FacilityName, CASE WHEN kind = 'object' THEN k END AS City FROM e""",
)
def read_keyed_json(v: Views) -> DataFrame:
    """Objects of 1,000 entries of any type, keyed by school name; a repeated key counts once, the last time."""
    value, at = F.get_json_object("props", "$.k"), F.col("event_id") % 5
    entry = (
        F.when(at == 0, value).when(at == 1, F.concat(F.lit('"City '), value, F.lit('"'))).when(at == 2, F.concat(F.lit("["), value, F.lit("]")))
        .when(at == 3, "null").otherwise(F.concat(F.lit('{"city": '), value, F.lit(', "Website": "", "school_urls": {"base_url": null}}')))
    )
    name = F.concat(F.lit('"School '), F.col("event_id").cast("string"), F.lit('": '))
    rows = v.table("events").select("event_id", F.concat(name, F.lit("0, "), name, entry).alias("entry"))
    document = F.concat(F.lit("{"), F.array_join(F.collect_list("entry"), ",\n"), F.lit("}"))
    path = _write_documents(rows, document, F.floor(F.col("event_id") / 1000), fresh_path(v.spark, "keyed"))
    entries = files.read_keyed_json(v.spark, path)
    kind = F.schema_of_variant("value")
    word = F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind == "VOID", "null").when(kind == "STRING", "text").otherwise("number")
    rows = entries.select("key", word.alias("kind"), F.col("value").cast("string").alias("plain"), F.from_json(F.to_json("value"), M.LOOSE_OBJECT).alias("value"))
    is_object = F.col("kind") == "object"
    facility, city, _ = files.school_list_fields()
    return rows.select("key", "kind", F.when(~is_object, F.col("plain")).alias("plain"), F.when(is_object, facility).alias("FacilityName"), F.when(is_object, city).alias("City"))


@query("read_table_partitioned", "SELECT cast(floor(o_orderkey / 1000) AS bigint) AS page, o_orderkey, o_custkey FROM orders")
def read_table_partitioned(v: Views) -> DataFrame:
    """Projected scan in pages of 1000 keys. The JDBC form of the scan is ``files.read_table_partitioned``."""
    return files.read_key_ranges(v.table("orders"), "o_orderkey", 1000, ["o_orderkey", "o_custkey"])


def city_directory(v: Views) -> DataFrame:
    rows = v.directory_rows
    typeahead = rows.select("seq", "school_id", "school_name", "is_high_school")
    missing = [f"{s}_{p}" for s in M.DIRECTORY_SLOTS[2:] for p in ("name", "title")]
    profiles = rows.select("*", *[F.lit(None).cast("string").alias(c) for c in missing])
    return tables.build_city_directory(typeahead, profiles.drop("is_high_school"))


@query(
    "build_city_directory",
    """SELECT school_name AS name, phone, website, administrator_name AS a_name, administrator_title AS a_title,
      second_name AS s_name, second_title AS s_title, cast(NULL AS varchar) AS t_name
    FROM directory_rows WHERE is_high_school""",
)
def build_city_directory(v: Views) -> DataFrame:
    c = F.col("contacts")
    return city_directory(v).select(
        "name", "phone", "website", c["administrator"]["name"].alias("a_name"), c["administrator"]["title"].alias("a_title"),
        c["second"]["name"].alias("s_name"), c["second"]["title"].alias("s_title"), c["third"]["name"].alias("t_name"),
    )


# --- writers ------------------------------------------------------------------------------

CSV_COLUMNS = ["firstName", "lastName", "email", "phone", "role", "school", "county", "address", "city", "state", "zipCode"]
ROLE_LABEL_SQL = "CASE role " + " ".join(f"WHEN '{k}' THEN '{x}'" for k, x in M.ROLE_LABELS.items()) + " END"


@query(
    "write_contact_csv",
    f"""WITH r AS (SELECT first_name AS "firstName", last_name AS "lastName", email, coalesce(phone, '') AS phone,
      {ROLE_LABEL_SQL} AS role, s.name AS school, s.county, s.address, s.city, s.state, s.zip_code AS "zipCode", c.contact_id
      FROM contacts c LEFT JOIN schools s USING (school_id))
    SELECT concat_ws(',', {", ".join(f'''CASE WHEN strpos(coalesce("{c}", ''), ',') > 0 OR strpos(coalesce("{c}", ''), '"') > 0
      THEN '"' || replace("{c}", '"', '""') || '"' ELSE coalesce("{c}", '') END''' for c in CSV_COLUMNS)}) AS line FROM r""",
)
def write_contact_csv(v: Views) -> DataFrame:
    return sinks.csv_lines(sinks.contact_csv_columns(v.contacts, v.schools), CSV_COLUMNS)


@query(
    "mailing_labels",
    """SELECT contact_id, first_name || ' ' || last_name || chr(10) || coalesce(s.name, '') || chr(10) || coalesce(s.address, '')
      || chr(10) || coalesce(s.city, '') || ', ' || coalesce(s.state, '') || ' ' || coalesce(s.zip_code, '') AS label
    FROM contacts c LEFT JOIN schools s USING (school_id)""",
)
def mailing_labels(v: Views) -> DataFrame:
    return sinks.mailing_labels(v.contacts, v.schools)


@query(
    "email_list",
    """SELECT s.county AS school_county, cast(floor(contact_id / 1000) AS bigint) AS piece, count(*) AS contacts,
      string_agg(c.email, ', ' ORDER BY contact_id) AS emails
    FROM contacts c JOIN schools s USING (school_id) WHERE c.is_active GROUP BY ALL""",
)
def email_list(v: Views) -> DataFrame:
    from canvasser.operators.joins import contacts_with_school

    rows = contacts_with_school(v.contacts.filter("is_active"), v.schools)
    return sinks.email_list(rows, "school_county", "contact_id")


@query(
    "engagement_report",
    """WITH a AS (SELECT school_id, count(*) n, max(date) latest FROM activities GROUP BY 1),
    c AS (SELECT school_id, count(*) total, count(*) FILTER (is_active) act FROM contacts GROUP BY 1),
    p AS (SELECT school_id, count(*) n FROM participation GROUP BY 1),
    f AS (SELECT s.school_id, s.name, s.county, coalesce(a.n, 0) acts, latest, coalesce(total, 0) total, coalesce(act, 0) act,
        coalesce(p.n, 0) app FROM schools s LEFT JOIN a USING (school_id) LEFT JOIN c USING (school_id) LEFT JOIN p USING (school_id)),
    m AS (SELECT 'Total Schools: ' || count(*) AS line, '000' AS k1 FROM schools
      UNION ALL SELECT 'Active Contacts: ' || count(*) FILTER (is_active), '001' FROM contacts
      UNION ALL SELECT 'Total Events: ' || count(*), '002' FROM outreach_events
      UNION ALL SELECT 'Schools Engaged (with activity): ' || count(*) FILTER (acts > 0), '003' FROM f
      UNION ALL SELECT 'Total Event Attendees: ' || sum(coalesce(attendees, 0)), '004' FROM outreach_events),
    t AS (SELECT *, 3 * acts + 2 * act + 4 * app AS score FROM f WHERE 3 * acts + 2 * act + 4 * app > 0
      ORDER BY score DESC, name, school_id LIMIT 10),
    g AS (SELECT *, list_filter([CASE WHEN total = 0 THEN 'No contacts' WHEN act = 0 THEN 'No active contacts' END,
        CASE WHEN latest IS NULL THEN 'No activity recorded' WHEN latest <= timestamp '2001-02-01' THEN 'No activity in 6+ months' END],
        lambda x: x IS NOT NULL) AS issues FROM f)
    SELECT '1 heading' AS section, '000' AS k1, '' AS k2, 'Outreach Report' AS line
    UNION ALL SELECT '1 heading', '001', '', 'Generated: August 1, 2001'
    UNION ALL SELECT '1 heading', '002', '', '' UNION ALL SELECT '1 heading', '003', '', '=== SUMMARY ==='
    UNION ALL SELECT '2 heading', '000', '', '' UNION ALL SELECT '2 heading', '001', '', '=== TOP ENGAGED SCHOOLS ==='
    UNION ALL SELECT '2 heading', '002', '', 'School,Score,Activities,Active Contacts,Events Appeared'
    UNION ALL SELECT '3 heading', '000', '', '' UNION ALL SELECT '3 heading', '001', '', '=== SCHOOLS NEEDING ATTENTION ==='
    UNION ALL SELECT '3 heading', '002', '', 'School,County,Contacts,Last Activity,Priority,Issues'
    UNION ALL SELECT '1 summary', k1, '', line FROM m
    UNION ALL SELECT '2 top engaged schools', lpad(cast(1000000000000 - score AS varchar), 13, '0'), name || '|' || school_id,
      '"' || name || '",' || score || ',' || acts || ',' || act || ',' || app FROM t
    UNION ALL SELECT '3 schools needing attention', name, cast(school_id AS varchar),
      '"' || name || '",' || county || ',' || total || ',' || coalesce(strftime(latest, '%b %-d, %Y'), 'Never') || ','
      || CASE WHEN len(issues) >= 2 THEN 'high' ELSE 'medium' END || ',"' || array_to_string(issues, '; ') || '"'
      FROM g WHERE len(issues) > 0""",
)
def engagement_report(v: Views) -> DataFrame:
    return sinks.engagement_report(
        metrics.summary_metrics(v.schools, v.contacts, v.outreach_events, v.activities, AS_OF),
        metrics.top_engaged_schools(v.schools, v.contacts, v.activities, v.participation),
        metrics.schools_needing_attention(v.schools, v.contacts, v.activities, AS_OF),
        AS_OF,
    )


@query(
    "export_snapshot",
    """SELECT 'activities' AS entity, count(*) AS n, cast(sum(activity_id) AS bigint) AS key_sum FROM activities
    UNION ALL SELECT 'contacts', count(*), cast(sum(contact_id) AS bigint) FROM contacts
    UNION ALL SELECT 'events', count(*), cast(sum(event_id) AS bigint) FROM outreach_events
    UNION ALL SELECT 'schools', count(*), cast(sum(school_id) AS bigint) FROM schools""",
)
def export_snapshot(v: Views) -> DataFrame:
    """Write the snapshot, read it back and count what came home."""
    path = fresh_path(v.spark, "snapshot")
    parts = {"schools": v.schools, "contacts": v.contacts, "events": v.outreach_events, "activities": v.activities}
    sinks.export_snapshot(parts, path)
    back = sinks.import_snapshot(v.spark, path, {n: d.schema for n, d in parts.items()})
    keys = {"schools": "school_id", "contacts": "contact_id", "events": "event_id", "activities": "activity_id"}
    out = None
    for name, df in back.items():
        row = df.agg(F.lit(name).alias("entity"), F.count("*").alias("n"), F.sum(keys[name]).alias("key_sum"))
        out = row if out is None else out.unionByName(row)
    return out


@query("import_snapshot", "SELECT * FROM schools")
def import_snapshot(v: Views) -> DataFrame:
    path = fresh_path(v.spark, "snapshot")
    sinks.export_snapshot({"schools": v.schools}, path)
    return sinks.import_snapshot(v.spark, path, {"schools": v.schools.schema})["schools"]


@query(
    "append_records",
    """SELECT 'run1' AS run_id, cast(seq AS varchar) AS seq, nullif(FacilityName, '') AS FacilityName FROM facility_list WHERE seq % 2 = 0
    UNION ALL SELECT 'run2', cast(seq AS varchar), nullif(FacilityName, '') FROM facility_list WHERE seq % 2 = 1""",
)
def append_records(v: Views) -> DataFrame:
    path = fresh_path(v.spark, "runs")
    raw = v.facility_list.select("seq", "FacilityName")
    for part, run in ((0, "run1"), (1, "run2"), (1, "run2")):
        sinks.append_records(raw.filter(F.col("seq") % 2 == part), path, run)
    back = files.read_csv_records(v.spark, path)
    return back.select("run_id", "seq", "FacilityName")


@query(
    "upsert_sink",
    """SELECT s_suppkey AS id, coalesce(n.name, 'old') AS name FROM supplier
      LEFT JOIN (SELECT p_partkey % 500 AS id, arg_max(p_name, p_partkey) AS name FROM part GROUP BY 1) n ON n.id = s_suppkey
    UNION ALL SELECT id, name FROM (SELECT p_partkey % 500 AS id, arg_max(p_name, p_partkey) AS name FROM part GROUP BY 1) n
      WHERE id NOT IN (SELECT s_suppkey FROM supplier)""",
)
def upsert_sink_query(v: Views) -> DataFrame:
    path = fresh_path(v.spark, "upsert")
    old = v.supplier.select(F.col("s_suppkey").alias("id"), F.lit("old").alias("name"), F.lit(-1).cast("bigint").alias("seq"))
    new = v.part.select((F.col("p_partkey") % 500).alias("id"), F.col("p_name").alias("name"), F.col("p_partkey").alias("seq"))
    for batch_id, rows in enumerate((old, new, new)):
        upsert_sink(rows, min(batch_id, 1), path, ["id"], "seq", buckets=8)
    return read_live(v.spark, path).select("id", "name")


def rules(v: Views) -> DataFrame:
    return v.rule_rows.select("seq", "school", X.normalize_urls(F.split("urls_csv", ",")).alias("alt_urls"))


def results(v: Views, source: str | None = None) -> DataFrame:
    """Result map rows with their arrays of pages and contacts, made within each row."""
    parts = [f.rsplit(" AS ", 1) for f in re.split(r",\n", RESULT_CONTACT)]
    fields = ", ".join(f"'{name.strip()}', {value}" for value, name in [("pos", "pos"), *parts])
    contacts = F.expr(
        f"transform(if(n_contacts > 0, sequence(1, n_contacts), array()), pos -> named_struct({fields}))"
    )
    pages = F.filter(F.split("pages_csv", ","), lambda p: p != "")
    rows = v.result_rows.withColumns({"pages_with_contacts": pages, "contacts": contacts}).drop("pages_csv", "n_contacts")
    return rows.filter(F.col("source") == source).drop("source") if source else rows


COMBINED_SQL = """combined AS (SELECT * FROM result_rows WHERE source = 'completed'
      UNION ALL SELECT * FROM result_rows WHERE source = 'still_working'
        AND school_name NOT IN (SELECT school_name FROM result_rows WHERE source = 'completed'))"""


URL_CLEAN = "list_filter(list_transform(string_split(urls_csv, ','), lambda x: trim(x)), lambda x: x <> '')"


@query(
    "export_lists",
    f"""WITH {COMBINED_SQL}, item AS (SELECT school_name, base_url, alt_url, trim(pages_csv, ',') AS pages, cast(n_contacts AS integer) AS n_contacts, error FROM combined),
    u AS (SELECT school AS name, cast(NULL AS varchar) AS base_url, ({URL_CLEAN})[1] AS alt_url, '' AS pages, 0 AS n, cast(NULL AS varchar) AS error, 0 AS prio FROM rule_rows
      UNION ALL SELECT school_name, base_url, alt_url, pages_csv, n_contacts, error, CASE WHEN source = 'completed' THEN 2 ELSE 1 END FROM result_rows)
    SELECT 'schools_with_no_results' AS list_type, * FROM item WHERE n_contacts = 0
    UNION ALL SELECT 'schools_with_results', * FROM item WHERE n_contacts > 0
    UNION ALL SELECT 'schools_with_no_staff_page', * FROM item WHERE pages = ''
    UNION ALL SELECT 'schools_with_empty_alt_urls', school, NULL, NULL, '', 0, NULL FROM rule_rows WHERE len({URL_CLEAN}) = 0
    UNION ALL SELECT 'all_school_names', arg_min(name, (prio, name)), arg_max(base_url, (prio, name)) FILTER (trim(base_url) <> ''),
      arg_max(alt_url, (prio, name)) FILTER (trim(alt_url) <> ''), coalesce(arg_max(pages, (prio, name)) FILTER (pages <> ''), ''),
      cast(coalesce(arg_max(n, (prio, name)) FILTER (n > 0), 0) AS integer), arg_max(error, (prio, name)) FILTER (trim(error) <> '') FROM u GROUP BY lower(trim(name))""",
)
def export_lists(v: Views) -> DataFrame:
    out = catalog.export_lists(rules(v), results(v, "still_working"), results(v, "completed"))
    return out.withColumnRenamed("pages_with_contacts", "pages").withColumn("pages", F.array_join("pages", ","))
