"""Queries over filters, searches and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvasser.functions.ordering import first_per_key, latest_per_key, top_n_per_key
from canvasser.operators import filters, fuzzy, joins, metrics
from canvasser.plans.bindings import AS_OF, Views
from canvasser.plans.load import LAST_LINK_SQL, norm_sql, results, rules, strip_sql
from canvasser.plans.registry import query
from canvasser.sources import tables

COUNTY = "NATION_4"
HAS_COUNTY = "length(trim(county)) > 0"


@query(
    "filter_schools",
    "SELECT * FROM schools WHERE is_verified AND school_type = 'high_school' AND school_id IN (SELECT school_id FROM contacts)",
)
def filter_schools(v: Views) -> DataFrame:
    return filters.filter_schools(v.schools, v.contacts, verified=True, school_type="high_school", has_contacts=True)


@query("filter_contacts", "SELECT * FROM contacts WHERE NOT is_verified AND role = 'principal' AND is_active")
def filter_contacts(v: Views) -> DataFrame:
    return filters.filter_contacts(v.contacts, verified=False, role="principal", active=True)


@query(
    "target_list",
    """SELECT * FROM contacts WHERE is_active AND is_verified
      AND school_id IN (SELECT school_id FROM schools WHERE school_type = 'middle_school')""",
)
def target_list(v: Views) -> DataFrame:
    return filters.target_list(
        v.contacts, v.schools, v.outreach_events, v.participation, school_type="middle_school", event_id=-1
    )


@query("filter_events", "SELECT * FROM outreach_events WHERE type = 'workshop'")
def filter_events(v: Views) -> DataFrame:
    return filters.filter_events(v.outreach_events, "workshop")


SEARCH_SQL = """s AS (SELECT 'school' AS entity, cast(school_id AS varchar) AS id, name AS label,
      row_number() OVER (ORDER BY name, school_id) AS rn FROM schools WHERE lower(name) LIKE '%{q}%' OR lower(county) LIKE '%{q}%'
        OR lower(city) LIKE '%{q}%' OR lower(coalesce(district, '')) LIKE '%{q}%'),
    c AS (SELECT 'contact' AS entity, cast(contact_id AS varchar) AS id, first_name || ' ' || last_name AS label,
      row_number() OVER (ORDER BY first_name || ' ' || last_name, contact_id) AS rn FROM contacts
      WHERE lower(first_name || ' ' || last_name) LIKE '%{q}%' OR lower(email) LIKE '%{q}%'),
    e AS (SELECT 'event' AS entity, cast(event_id AS varchar) AS id, name AS label,
      row_number() OVER (ORDER BY name, event_id) AS rn FROM outreach_events WHERE lower(name) LIKE '%{q}%' OR lower(location) LIKE '%{q}%')"""


@query(
    "global_search",
    f"""WITH {SEARCH_SQL.replace('{q}', '12')} SELECT entity, id, label FROM (FROM s UNION ALL FROM c UNION ALL FROM e) x WHERE rn <= 5""",
)
def global_search(v: Views) -> DataFrame:
    return filters.global_search(v.schools, v.contacts, v.outreach_events, " 12 ")


@query(
    "top_n_per_entity",
    f"""WITH {SEARCH_SQL.replace('{q}', 'r')} SELECT entity, id, label, rn AS hit FROM (FROM s UNION ALL FROM c UNION ALL FROM e) x WHERE rn <= 5""",
)
def top_n_per_entity(v: Views) -> DataFrame:
    def part(entity, df, key, label, cols):
        hits = df.filter(F.concat_ws("\n", *cols).ilike("%r%"))
        return hits.select(F.lit(entity).alias("entity"), F.col(key).alias("k"), label.alias("label"))

    who = F.concat_ws(" ", "first_name", "last_name")
    rows = (
        part("school", v.schools, "school_id", F.col("name"), ["name", "county", "city", "district"])
        .unionByName(part("contact", v.contacts, "contact_id", who, [who, "email"]))
        .unionByName(part("event", v.outreach_events, "event_id", F.col("name"), ["name", "location"]))
    )
    out = top_n_per_key(rows, ["entity"], [F.asc("label"), F.asc("k")], 5, rank="hit")
    return out.select("entity", F.col("k").cast("string").alias("id"), "label", F.col("hit").cast("bigint").alias("hit"))


@query(
    "table_view",
    """SELECT contact_id, first_name, last_name, email FROM contacts
      WHERE lower(first_name) LIKE '%7%' OR lower(last_name) LIKE '%7%' OR lower(email) LIKE '%7%'
      ORDER BY last_name DESC, contact_id LIMIT 25 OFFSET 25""",
)
def table_view(v: Views) -> DataFrame:
    rows = v.contacts.select("contact_id", "first_name", "last_name", "email")
    return filters.table_view(rows, "7", ["first_name", "last_name", "email"], F.desc("last_name"), "contact_id", page=1, size=25)


@query("paginate", "SELECT activity_id, date FROM activities ORDER BY date, activity_id LIMIT 50 OFFSET 100")
def paginate(v: Views) -> DataFrame:
    return filters.paginate(v.activities.select("activity_id", "date"), [F.col("date"), F.col("activity_id")], 2, 50)


@query("has_county", f"SELECT school_id, county FROM schools WHERE {HAS_COUNTY}")
def has_county(v: Views) -> DataFrame:
    return filters.has_county(v.schools).select("school_id", "county")


@query(
    "upcoming_events",
    f"SELECT event_id, name, date FROM outreach_events WHERE date > timestamp '{AS_OF}' ORDER BY date, event_id LIMIT 6",
)
def upcoming_events(v: Views) -> DataFrame:
    return filters.upcoming_events(v.outreach_events, AS_OF).select("event_id", "name", "date")


@query("past_flag", f"SELECT event_id, NOT (date > timestamp '{AS_OF}') AS is_past FROM outreach_events")
def past_flag(v: Views) -> DataFrame:
    return filters.past_flag(v.outreach_events, AS_OF).select("event_id", "is_past")


@query(
    "month_calendar",
    """SELECT cast(d.day AS varchar) AS day, e.event_id, e.name FROM
      (SELECT unnest(generate_series(timestamp '2000-02-01', timestamp '2000-02-29', interval 1 day))::date AS day) d
      LEFT JOIN outreach_events e ON e.date::date = d.day""",
)
def month_calendar(v: Views) -> DataFrame:
    out = filters.month_calendar(v.outreach_events, "2000-02")
    return out.select(F.col("day").cast("string").alias("day"), "event_id", "name")


@query("facet_values", "SELECT DISTINCT county FROM schools")
def facet_values(v: Views) -> DataFrame:
    return filters.facet_values(v.schools, "county")


@query("count_unverified", "SELECT count(*) FILTER (NOT is_verified) AS unverified FROM schools")
def count_unverified(v: Views) -> DataFrame:
    return filters.count_unverified(v.schools)


@query(
    "catalog_search",
    r"""SELECT r.school, cast(len(list_distinct(list_filter(list_transform(string_split(urls_csv, ','), lambda x: trim(x)), lambda x: x <> ''))) AS integer)
        AS n_alt_urls, s.seq AS position
      FROM rule_rows r LEFT JOIN (SELECT trim(school_name) AS school, seq FROM result_rows) s USING (school)
      WHERE lower(school) LIKE '%0012%'""",
)
def catalog_search(v: Views) -> DataFrame:
    listed = v.result_rows.select(F.col("school_name").alias("name"), F.col("seq").alias("pos"))
    return filters.catalog_search(rules(v), listed, " 0012 ")


# --- joins --------------------------------------------------------------------------------


@query(
    "resolve_contact_school",
    f"""WITH j AS ({LAST_LINK_SQL}) SELECT staff_id, coalesce(linked, school_worked_at, '') AS school_id FROM staff_rows LEFT JOIN j USING (staff_id)""",
)
def resolve_contact_school(v: Views) -> DataFrame:
    return tables.resolve_contact_school(v.staff_rows, v.junction_rows).select("staff_id", "school_id")


@query(
    "contacts_with_school",
    """SELECT contact_id, coalesce(s.name, 'Unknown') AS school_name, coalesce(s.county, 'Unknown') AS school_county
      FROM contacts c LEFT JOIN schools s ON c.school_id = s.school_id AND s.is_active""",
)
def contacts_with_school(v: Views) -> DataFrame:
    out = joins.contacts_with_school(v.contacts, v.schools.filter("is_active"), missing="Unknown")
    return out.select("contact_id", "school_name", "school_county")


@query(
    "contacts_semi_school",
    f"SELECT contact_id FROM contacts WHERE school_id IN (SELECT school_id FROM schools WHERE county = '{COUNTY}' AND school_type = 'high_school')",
)
def contacts_semi_school(v: Views) -> DataFrame:
    return filters.contacts_semi_school(v.contacts, v.schools, COUNTY, "high_school").select("contact_id")


@query(
    "contacts_semi_event",
    """SELECT contact_id FROM contacts WHERE school_id IN
      (SELECT school_id FROM participation WHERE event_id = (SELECT min(event_id) FROM participation WHERE school_id IN (SELECT school_id FROM contacts)))""",
)
def contacts_semi_event(v: Views) -> DataFrame:
    linked = v.participation.join(v.contacts.select("school_id").distinct(), "school_id", "left_semi")
    return filters.contacts_semi_event(v.contacts, v.participation, linked.agg(F.min("event_id")).scalar()).select("contact_id")


@query(
    "schools_never_at_event",
    "SELECT school_id, name, county FROM schools WHERE school_id NOT IN (SELECT school_id FROM participation)",
)
def schools_never_at_event(v: Views) -> DataFrame:
    return joins.schools_never_at_event(v.schools, v.participation).select("school_id", "name", "county")


@query("schools_with_contacts", "SELECT school_id, name FROM schools WHERE school_id IN (SELECT school_id FROM contacts)")
def schools_with_contacts(v: Views) -> DataFrame:
    return filters.schools_with_contacts(v.schools, v.contacts).select("school_id", "name")


@query("schools_without_contacts", "SELECT school_id, name FROM schools WHERE school_id NOT IN (SELECT school_id FROM contacts)")
def schools_without_contacts(v: Views) -> DataFrame:
    return filters.schools_without_contacts(v.schools, v.contacts).select("school_id", "name")


@query(
    "events_for_school",
    r"""SELECT event_id, name FROM (SELECT 'e_' || event_id AS event_id, coalesce(fair_name, location, 'Untitled Event') AS name,
      list_transform(string_split(schools_involved, ','), lambda x: trim(x)) AS p FROM event_rows) x WHERE list_contains(p, '7')""",
)
def events_for_school(v: Views) -> DataFrame:
    events = tables.load_events(v.event_rows, AS_OF)
    return joins.events_for_school(events, "7").select("event_id", "name")


@query(
    "events_for_county",
    f"""SELECT event_id, name, date FROM outreach_events WHERE event_id IN
      (SELECT event_id FROM participation JOIN schools USING (school_id) WHERE county = '{COUNTY}')""",
)
def events_for_county(v: Views) -> DataFrame:
    return joins.events_for_county(v.outreach_events, v.participation, v.schools, COUNTY).select("event_id", "name", "date")


@query(
    "recent_activity_feed",
    """SELECT activity_id, school_id, activity_type, date, s.name AS school_name FROM activities LEFT JOIN schools s USING (school_id)
      ORDER BY date DESC, activity_id LIMIT 12""",
)
def recent_activity_feed(v: Views) -> DataFrame:
    out = joins.recent_activity_feed(v.activities, v.schools)
    return out.select("activity_id", "school_id", "activity_type", "date", "school_name")


COUNTY_SUMMARY_SQL = f"""l AS (SELECT school_id, county, is_verified FROM schools WHERE {HAS_COUNTY}),
    sm AS (SELECT county, count(*) AS total_schools, count(*) FILTER (is_verified) AS verified_schools FROM l GROUP BY 1),
    sc AS (SELECT county, count(*) AS n FROM contacts JOIN l USING (school_id) GROUP BY 1),
    se AS (SELECT county, count(DISTINCT event_id) AS n FROM participation JOIN l USING (school_id) GROUP BY 1),
    sp AS (SELECT county, count(*) AS n FROM programs JOIN l USING (school_id) GROUP BY 1),
    summary AS (SELECT county, total_schools, verified_schools, coalesce(sc.n, 0) AS total_contacts, coalesce(se.n, 0) AS total_events,
      coalesce(sp.n, 0) AS total_programs FROM sm LEFT JOIN sc USING (county) LEFT JOIN se USING (county) LEFT JOIN sp USING (county)),
    rate AS (SELECT county, count(*) AS total_schools, count(*) FILTER (school_id IN (SELECT school_id FROM participation)) AS engaged_schools,
      round(100.0::double * count(*) FILTER (school_id IN (SELECT school_id FROM participation)) / count(*), 1) AS engagement_pct
      FROM l GROUP BY 1)"""


@query(
    "county_cards",
    f"""WITH {COUNTY_SUMMARY_SQL} SELECT s.*, coalesce(r.engaged_schools, 0) AS engaged_schools, coalesce(engagement_pct, 0.0) AS engagement_pct,
      CASE WHEN engagement_pct >= 30 THEN 'success' WHEN engagement_pct >= 10 THEN 'warning' ELSE 'error' END AS band
    FROM summary s LEFT JOIN rate r USING (county)""",
)
def county_cards(v: Views) -> DataFrame:
    return joins.county_cards(metrics.county_school_summary(v.schools, v.contacts, v.participation, v.programs, engaged=True))


@query(
    "resolve_school_name",
    """WITH k AS (SELECT lower(name) AS nm, school_id, 0 AS prio FROM schools
      UNION ALL SELECT lower(name), 1000000000 + seq, 1 FROM import_schools),
    w AS (SELECT nm, arg_max(school_id, (prio, school_id)) AS school_id FROM k GROUP BY 1)
    SELECT "row", coalesce(cast(w.school_id AS varchar), '') AS school_id FROM import_contacts i LEFT JOIN w ON lower(i."schoolId") = w.nm""",
)
def resolve_school_name(v: Views) -> DataFrame:
    rows = v.import_contacts.select("row", F.col("schoolId").alias("school_name"))
    imported = v.import_schools.select("name", (F.lit(1_000_000_000) + F.col("seq")).alias("school_id"))
    return joins.resolve_school_name(rows, v.schools, imported).select("row", "school_id")


FACILITY_KEY_SQL = f"""CASE WHEN {strip_sql("coalesce(FacilityKey, '')")} <> '' THEN {strip_sql('FacilityKey')}
      WHEN {strip_sql("coalesce(FacilityName, '')")} <> '' AND {strip_sql("coalesce(City, '')")} <> ''
        THEN {strip_sql("coalesce(County, '')")} || '|' || {strip_sql('FacilityName')} || '|' || {strip_sql('City')} || '|' || {strip_sql("coalesce(Zip, '')")}
      WHEN {strip_sql("coalesce(NCES_ID, '')")} <> '' AND lower(trim(NCES_ID)) NOT IN ('none', 'null', 'pending', '(pending)')
        THEN 'nces|' || {strip_sql('NCES_ID')} END"""
NORM_KEY_SQL = f"array_to_string(list_transform(string_split(fk, '|'), lambda p: {norm_sql('p')}), '|')"
FACILITIES_SQL = f"""fk AS (SELECT *, {FACILITY_KEY_SQL} AS fk FROM facility_list), fn AS (SELECT *, {NORM_KEY_SQL} AS facility_key FROM fk WHERE fk IS NOT NULL),
    fby AS (SELECT {norm_sql('FacilityName')} AS name_key, arg_max(facility_key, seq) AS facility_key FROM fn
      WHERE {norm_sql('FacilityName')} <> '' GROUP BY 1)"""


def completed_with_list_names(v: Views) -> DataFrame:
    """The finished results under names of the facility list, so that part of them link."""
    names = v.facility_list.select(
        (F.col("seq") + 1).alias("seq"), F.concat(F.lit(" "), F.upper(F.col("FacilityName"))).alias("_n")
    )
    rows = results(v, "completed").join(names, "seq", "left")
    return rows.withColumn("school_name", F.coalesce("_n", "school_name")).drop("_n")


LINKED_SQL = f"""{FACILITIES_SQL},
    cp AS (SELECT r.*, coalesce(' ' || upper(f.FacilityName), r.school_name) AS nm FROM result_rows r
      LEFT JOIN facility_list f ON f.seq + 1 = r.seq WHERE source = 'completed'),
    lk AS (SELECT nullif({strip_sql("c.name")}, '') AS name, nullif({strip_sql('c.phone')}, '') AS phone,
      nullif({strip_sql('c.email')}, '') AS email, nullif({strip_sql('c.title')}, '') AS job_name, fby.facility_key AS school_worked_at, c.seq, c.pos - 1 AS pos
      FROM result_contacts c JOIN cp ON c.seq = cp.seq AND c.source = 'completed' JOIN fby ON fby.name_key = {norm_sql('cp.nm')}
      WHERE {strip_sql('c.name')} <> '')"""


@query("link_scraped_contacts", f"WITH {LINKED_SQL} SELECT * FROM lk")
def link_scraped_contacts(v: Views) -> DataFrame:
    out = joins.link_scraped_contacts(completed_with_list_names(v), v.facility_list)
    return out.withColumn("pos", F.col("pos").cast("bigint"))


@query(
    "unknown_schools",
    f"WITH {LINKED_SQL} SELECT count(*) AS unknown FROM cp WHERE {norm_sql('nm')} NOT IN (SELECT name_key FROM fby)",
)
def unknown_schools(v: Views) -> DataFrame:
    return joins.unknown_schools(completed_with_list_names(v), v.facility_list).agg(F.count("*").alias("unknown"))


@query(
    "attach_district",
    """SELECT facility_key, name, cast(d.s_nationkey AS integer) AS district_id FROM school_rows
      LEFT JOIN supplier d ON facility_key = cast(d.s_suppkey AS varchar)""",
)
def attach_district(v: Views) -> DataFrame:
    districts = v.supplier.select(F.col("s_suppkey").cast("string").alias("facility_key"), F.col("s_nationkey").alias("district_id"))
    return joins.attach_district(v.school_rows.select("facility_key", "name"), districts)


def plain_name_sql(c: str) -> str:
    out = f"lower({strip_sql(f'coalesce({c}, {chr(39) * 2})')})"
    for pattern, put in [
        ("&", " and "), (r"st\.", "saint"), (r"\bst\b", "saint"), (r"\bsch\b", "school"), (r"\bjr\b", "junior"), (r"\bsr\b", "senior"),
        (r",\s*(il|illinois)\b", ""), (r"\billinois\b", ""), ("[^a-z0-9]+", " "),
    ]:
        out = f"regexp_replace({out}, '{pattern}', '{put}', 'g')"
    return f"trim({out})"


@query(
    "resume_pending",
    f"""WITH k AS (SELECT *, {plain_name_sql('FacilityName')} AS a, {plain_name_sql('City')} AS b FROM facility_list)
    SELECT seq, FacilityName, City FROM k WHERE (a, b) NOT IN (SELECT (a, b) FROM k WHERE Zip IS NULL)""",
)
def resume_pending(v: Views) -> DataFrame:
    rows = v.facility_list.select("seq", "FacilityName", "City")
    done = v.facility_list.filter("Zip is null").select(F.upper("FacilityName").alias("FacilityName"), "City")
    return joins.resume_pending(rows, done)


def ratio_sql(a: str, b: str) -> str:
    """200 * LCS / (len a + len b) by the usual table, one list per row of it."""
    chars = f"list_transform(string_split({b}, ''), lambda y: [unicode(y)::bigint])"
    step = f"""list_reduce(list_transform(range(1, length({a}) + 1), lambda i: [i]), lambda done, i: list_append(done, greatest(done[i[1]], prev[i[1] + 1],
      CASE WHEN unicode(substr({a}, i[1], 1)) = y[1] THEN prev[i[1]] + 1 ELSE 0 END)), [0::bigint])"""
    table = f"list_reduce({chars}, lambda prev, y: {step}, list_resize([0::bigint], length({a}) + 1, 0::bigint))"
    return f"200.0::double * {table}[length({a}) + 1] / (length({a}) + length({b}))"


FUZZY_SQL = f"""nm AS (SELECT DISTINCT p_brand, p_name || ' ' || p_type || ' hs' AS school_name FROM part),
    lb AS (SELECT p_brand, lower('the ' || p_name || ' ' || p_type || CASE WHEN p_size % 2 = 0 THEN ' high school' ELSE ' jr school' END) AS label,
      min(p_partkey) AS pos FROM part GROUP BY ALL),
    cd AS (SELECT p_brand, school_name, lower(school_name) AS t, label, pos FROM nm JOIN lb USING (p_brand)
      WHERE contains(label, split_part(lower(school_name), ' ', 2)) AND contains(label, 'school')),
    sp AS (SELECT t, label, {ratio_sql('t', 'label')} AS score FROM (SELECT DISTINCT t, label FROM cd) x),
    rk AS (SELECT p_brand, school_name, label, score, row_number() OVER (PARTITION BY p_brand, school_name ORDER BY score DESC, pos) AS rn
      FROM cd JOIN sp USING (t, label) WHERE score > 70)"""


@query("fuzzy_best_match", f"WITH {FUZZY_SQL} SELECT p_brand, school_name, label, round(score, 6) AS score FROM rk WHERE rn = 1")
def fuzzy_best_match(v: Views) -> DataFrame:
    """Each product name of a brand against labels of the brand that repeat its words in another form."""
    names, labels = fuzzy_inputs(v)
    return fuzzy.fuzzy_best_match(names, labels, on=["p_brand"]).withColumn("score", F.round("score", 6))


def fuzzy_inputs(v: Views) -> tuple[DataFrame, DataFrame]:
    names = v.part.select("p_brand", F.concat_ws(" ", "p_name", "p_type", F.lit("hs")).alias("school_name"))
    labels = v.part.select(
        "p_brand",
        F.concat_ws(" ", F.lit("the"), "p_name", "p_type", F.when(F.col("p_size") % 2 == 0, "high").otherwise("jr"), F.lit("school")).alias("label"),
        F.col("p_partkey").alias("pos"),
    )
    return names, labels


# --- first and last per key ---------------------------------------------------------------


@query(
    "latest_per_key",
    "SELECT school_id, arg_max(activity_id, (date, activity_id)) AS activity_id, max(date) AS date FROM activities GROUP BY 1",
)
def latest_per_key_query(v: Views) -> DataFrame:
    return latest_per_key(v.activities, ["school_id"], "date", "activity_id").select("school_id", "activity_id", "date")


@query(
    "first_per_key",
    "SELECT school_id, arg_min(activity_id, (date, activity_id)) AS activity_id, min(date) AS date FROM activities GROUP BY 1",
)
def first_per_key_query(v: Views) -> DataFrame:
    return first_per_key(v.activities, ["school_id"], "date", "activity_id").select("school_id", "activity_id", "date")


@query("explode_participants", "SELECT 'e_' || event_id AS event_id, p AS school_id FROM (SELECT event_id, trim(unnest(string_split(schools_involved, ','))) AS p FROM event_rows) x WHERE p <> ''")
def explode_participants(v: Views) -> DataFrame:
    return tables.explode_participants(tables.load_events(v.event_rows, AS_OF))


