"""Queries over set operations, catalogue merges, upserts and change logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvasser.functions import text as X
from canvasser.operators import catalog, joins, merge
from canvasser.plans.bindings import AS_OF, Views
from canvasser.plans.load import URL_CLEAN, city_directory, clean_sql, norm_sql, results, rules, strip_sql
from canvasser.plans.lookup import FACILITIES_SQL, LINKED_SQL, completed_with_list_names, plain_name_sql
from canvasser.plans.registry import query
from canvasser.session import fresh_path

# --- set operations -----------------------------------------------------------------------

LISTS_SQL = """a AS (SELECT p_partkey AS seq, CASE WHEN p_size = 50 THEN ' ' ELSE ' ' || upper(p_name || ' ' || p_brand) END AS id,
      p_type AS payload FROM part),
    b AS (SELECT p_partkey AS seq, p_name || ' Brand#' || p_size AS id, p_brand AS payload FROM part),
    ka AS (SELECT lower(trim(id)) AS k, *, min(seq) OVER (PARTITION BY lower(trim(id))) AS pos FROM a WHERE trim(id) <> ''
      QUALIFY row_number() OVER (PARTITION BY lower(trim(id)) ORDER BY seq DESC) = 1),
    kb AS (SELECT lower(trim(id)) AS k, *, min(seq) OVER (PARTITION BY lower(trim(id))) AS pos FROM b WHERE trim(id) <> ''
      QUALIFY row_number() OVER (PARTITION BY lower(trim(id)) ORDER BY seq DESC) = 1)"""
OUT = ["seq", "id", "payload", "pos"]


def _lists(v: Views) -> tuple[DataFrame, DataFrame]:
    seq = F.col("p_partkey").alias("seq")
    shouted = F.when(F.col("p_size") == 50, " ").otherwise(F.concat(F.lit(" "), F.upper(F.concat_ws(" ", "p_name", "p_brand"))))
    other = F.concat(F.col("p_name"), F.lit(" Brand#"), F.col("p_size").cast("string"))
    a = v.part.select(seq, shouted.alias("id"), F.col("p_type").alias("payload"))
    return a, v.part.select(seq, other.alias("id"), F.col("p_brand").alias("payload"))


def _shape(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("_pos", "pos").select(*OUT)


@query("keyed_union", f"WITH {LISTS_SQL} SELECT seq, id, payload, pos FROM ka UNION ALL SELECT seq, id, payload, pos FROM kb WHERE k NOT IN (SELECT k FROM ka)")
def keyed_union(v: Views) -> DataFrame:
    return _shape(catalog.keyed_union(*_lists(v), "id"))


@query("keyed_intersect", f"WITH {LISTS_SQL} SELECT seq, id, payload, pos FROM ka WHERE k IN (SELECT k FROM kb)")
def keyed_intersect(v: Views) -> DataFrame:
    return _shape(catalog.keyed_intersect(*_lists(v), "id"))


@query("keyed_difference", f"WITH {LISTS_SQL} SELECT seq, id, payload, pos FROM ka WHERE k NOT IN (SELECT k FROM kb)")
def keyed_difference(v: Views) -> DataFrame:
    return _shape(catalog.keyed_difference(*_lists(v), "id"))


ROWS_SQL = "WITH a AS (SELECT p_name, p_brand FROM part), b AS (SELECT p_name, 'Brand#' || p_size AS p_brand FROM part)"


def _row_lists(v: Views) -> tuple[DataFrame, DataFrame]:
    other = F.concat(F.lit("Brand#"), F.col("p_size").cast("string"))
    return v.part.select("p_name", "p_brand"), v.part.select("p_name", other.alias("p_brand"))


@query("row_union", f"{ROWS_SQL} SELECT * FROM a UNION SELECT * FROM b")
def row_union(v: Views) -> DataFrame:
    return catalog.row_union(*_row_lists(v))


@query("row_intersect", f"{ROWS_SQL} SELECT * FROM a INTERSECT SELECT * FROM b")
def row_intersect(v: Views) -> DataFrame:
    return catalog.row_intersect(*_row_lists(v))


@query("row_difference", f"{ROWS_SQL} SELECT * FROM a EXCEPT SELECT * FROM b")
def row_difference(v: Views) -> DataFrame:
    return catalog.row_difference(*_row_lists(v))


def _map(v: Views, source: str) -> DataFrame:
    return v.result_rows.filter(F.col("source") == source).select(F.col("school_name").alias("key"), "alt_url", "n_contacts")


MAPS_SQL = "WITH a AS (SELECT school_name AS key, alt_url, n_contacts FROM result_rows WHERE source = 'still_working'), b AS (SELECT school_name AS key, alt_url, n_contacts FROM result_rows WHERE source = 'completed')"


@query("map_union", f"{MAPS_SQL} SELECT * FROM b UNION ALL SELECT * FROM a WHERE key NOT IN (SELECT key FROM b)")
def map_union(v: Views) -> DataFrame:
    return catalog.map_union(_map(v, "still_working"), _map(v, "completed"))


@query("map_intersect", f"{MAPS_SQL} SELECT * FROM a WHERE key IN (SELECT key FROM b)")
def map_intersect(v: Views) -> DataFrame:
    return catalog.map_intersect(_map(v, "still_working"), _map(v, "completed"))


@query("map_difference", f"{MAPS_SQL} SELECT * FROM a WHERE key NOT IN (SELECT key FROM b)")
def map_difference(v: Views) -> DataFrame:
    return catalog.map_difference(_map(v, "still_working"), _map(v, "completed"))


@query(
    "build_facilities",
    """SELECT seq, coalesce(CountyName, 'None') || '|' || coalesce(FacilityName, 'None') || '|' || coalesce(City, 'None') || '|' || coalesce(Zip, 'None')
      AS "FacilityKey", cast(try_cast(StRep AS double) AS bigint) AS "StRep" FROM facility_sheet""",
)
def build_facilities(v: Views) -> DataFrame:
    return catalog.build_facilities(v.facility_sheet, ("StRep", "StSen")).select("seq", "FacilityKey", "StRep")


def _last_filled(col: str, usable: str) -> str:
    return f"arg_max({col}, (prio, name)) FILTER ({usable})"


@query(
    "merge_catalog",
    f"""WITH u AS (SELECT school AS name, cast(NULL AS varchar) AS base_url, ({URL_CLEAN})[1] AS alt_url, '' AS pages, 0 AS n, cast(NULL AS varchar) AS error,
        0 AS prio FROM rule_rows
      UNION ALL SELECT school_name, base_url, alt_url, pages_csv, n_contacts, error, CASE WHEN source = 'completed' THEN 2 ELSE 1 END FROM result_rows)
    SELECT arg_min(name, (prio, name)) AS school_name, {_last_filled('base_url', "trim(base_url) <> ''")} AS base_url,
      {_last_filled('alt_url', "trim(alt_url) <> ''")} AS alt_url, coalesce({_last_filled('pages', "pages <> ''")}, '') AS pages,
      coalesce(cast({_last_filled('n', 'n > 0')} AS bigint), 0) AS n_contacts, {_last_filled('error', "trim(error) <> ''")} AS error
    FROM u GROUP BY lower(trim(name))""",
)
def merge_catalog(v: Views) -> DataFrame:
    out = catalog.merge_catalog(rules(v), results(v, "still_working"), results(v, "completed"))
    return out.select(
        "school_name", "base_url", "alt_url", F.array_join("pages_with_contacts", ",").alias("pages"),
        F.col("n_contacts").cast("bigint").alias("n_contacts"), "error",
    )


ADDED_SQL = """r AS (SELECT seq, school, {u} AS urls FROM rule_rows),
    i AS (SELECT 'Customer#' || lpad(cast(p_partkey AS varchar), 9, '0') AS school, ['https://b.example.org', 'https://p' || p_size || '.example.org', ''] AS more
      FROM part)""".replace("{u}", URL_CLEAN)


def _ordered_distinct(c: str) -> str:
    return f"list_filter({c}, lambda x, i: x <> '' AND list_position({c}, x) = i)"


def _incoming_rules(v: Views) -> DataFrame:
    name = F.concat(F.lit("Customer#"), F.lpad(F.col("p_partkey").cast("string"), 9, "0"))
    urls = F.array(F.lit("https://b.example.org"), F.concat(F.lit("https://p"), F.col("p_size").cast("string"), F.lit(".example.org")), F.lit(" "))
    return v.part.select(name.alias("school"), urls.alias("alt_urls"))


@query(
    "bulk_add_rules",
    f"""WITH {ADDED_SQL}, j AS (SELECT school, list_concat(coalesce(urls, []), coalesce(more, [])) AS l FROM r FULL JOIN i USING (school))
    SELECT school, array_to_string({_ordered_distinct('l')}, ',') AS alt_urls FROM j""",
)
def bulk_add_rules(v: Views) -> DataFrame:
    out = catalog.bulk_add_rules(rules(v).drop("seq"), _incoming_rules(v))
    return out.withColumn("alt_urls", F.array_join("alt_urls", ","))


@query("bulk_delete_by_names", "SELECT seq, school FROM rule_rows WHERE school NOT IN (SELECT school_name FROM result_rows WHERE source = 'completed')")
def bulk_delete_by_names(v: Views) -> DataFrame:
    names = results(v, "completed").select(F.col("school_name").alias("school"))
    return catalog.bulk_delete_by_names(rules(v), names).select("seq", "school")


@query(
    "rename_or_edit_rules",
    f"""WITH r AS (SELECT seq, school, {URL_CLEAN} AS l FROM rule_rows), d AS (SELECT seq, school, {_ordered_distinct('l')} AS urls FROM r),
    e AS (SELECT seq, school, urls, CASE WHEN seq % 4 = 3 THEN CASE WHEN seq % 3 = 0 THEN 'Customer#000000001' ELSE 'Renamed ' || seq END END AS nn FROM d)
    SELECT CASE WHEN nn LIKE 'Renamed %' THEN nn ELSE school END AS school,
      array_to_string(CASE seq % 4 WHEN 0 THEN ['https://n.example.org']
        WHEN 1 THEN {_ordered_distinct("list_concat(urls, ['https://b.example.org', 'https://n.example.org'])")}
        WHEN 2 THEN list_filter(urls, lambda x: x <> 'https://b.example.org') ELSE urls END, ',') AS alt_urls FROM e""",
)
def rename_or_edit_rules(v: Views) -> DataFrame:
    rows = rules(v)
    kind = F.col("seq") % 4
    urls = (
        F.when(kind == 0, F.array(F.lit(" https://n.example.org "), F.lit("")))
        .when(kind == 1, F.array(F.lit("https://b.example.org"), F.lit("https://n.example.org")))
        .when(kind == 2, F.array(F.lit("https://b.example.org")))
    )
    action = F.when(kind == 0, "replace").when(kind == 1, "add").when(kind == 2, "remove").otherwise("rename")
    name = F.when(F.col("seq") % 3 == 0, "Customer#000000001").otherwise(F.concat(F.lit("Renamed "), F.col("seq").cast("string")))
    edits = rows.select("school", action.alias("action"), urls.alias("urls"), F.when(kind == 3, name).alias("new_name"))
    out = catalog.rename_or_edit_rules(rows.drop("seq"), edits)
    return out.withColumn("alt_urls", F.array_join("alt_urls", ","))


# --- upserts ------------------------------------------------------------------------------

MERGE_SQL = """t AS (SELECT s_suppkey AS id, s_name AS name, s_nationkey AS nation, s_acctbal AS bal FROM supplier),
    n AS (SELECT CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE p_partkey % 700 END AS id, p_name AS name, p_size AS nation, p_partkey AS seq FROM part),
    l AS (SELECT * FROM n WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1)"""


@query(
    "merge_upsert",
    f"""WITH {MERGE_SQL} SELECT coalesce(t.id, l.id) AS id, CASE WHEN l.id IS NOT NULL THEN l.name ELSE t.name END AS name,
      CASE WHEN t.id IS NULL THEN l.nation ELSE t.nation END AS nation, CASE WHEN t.id IS NULL THEN -1.0 ELSE bal END AS bal,
      CASE WHEN t.id IS NULL THEN 'insert' WHEN l.id IS NOT NULL THEN 'update' ELSE 'keep' END AS action FROM t FULL JOIN l ON t.id = l.id
    UNION ALL SELECT NULL, name, nation, -1.0, 'insert' FROM n WHERE id IS NULL""",
)
def merge_upsert(v: Views) -> DataFrame:
    target = v.supplier.select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("bal")
    )
    incoming = v.part.select(
        F.when(F.col("p_partkey") % 10 != 0, F.col("p_partkey") % 700).alias("id"), F.col("p_name").alias("name"),
        F.col("p_size").alias("nation"), F.col("p_partkey").alias("seq"),
    )
    out = merge.merge_upsert(target, incoming, ["id"], overlay=["name"], seq="seq", defaults={"bal": F.lit(-1.0)})
    return out.withColumnRenamed("_action", "action")


IMPORT_SCHOOLS_SQL = """i AS (SELECT *, lower(name) AS m FROM import_schools WHERE name <> ''),
    f AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY m ORDER BY seq) = 1),
    k AS (SELECT lower(name) AS m, max(facility_key) AS facility_key FROM school_rows GROUP BY 1),
    x AS (SELECT f.*, k.facility_key, CASE WHEN school_type = 'high_school' THEN 'High School' ELSE 'Middle School' END AS ty FROM f LEFT JOIN k USING (m))"""


@query(
    "import_schools",
    f"""WITH {IMPORT_SCHOOLS_SQL}
    SELECT s.facility_key, s.name, CASE WHEN x.m IS NULL THEN s.county_name ELSE x.county END AS county_name,
      CASE WHEN x.m IS NULL THEN s.address ELSE x.address END AS address, CASE WHEN x.m IS NULL THEN s.city ELSE x.city END AS city,
      CASE WHEN x.m IS NULL THEN s.zipcode ELSE x.zip_code END AS zipcode, CASE WHEN x.m IS NULL THEN s.type_of_school ELSE x.ty END AS type_of_school,
      CASE WHEN x.m IS NULL THEN s.data_source ELSE 'imported' END AS data_source, s.is_active, s.is_verified, s.priority_tier,
      CASE WHEN x.m IS NULL THEN 'keep' ELSE 'update' END AS action FROM school_rows s LEFT JOIN x USING (facility_key)
    UNION ALL SELECT 'new|' || m, name, county, address, city, zip_code, ty, 'imported', true, false, 'standard', 'insert' FROM x WHERE facility_key IS NULL
    UNION ALL SELECT NULL, name, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'duplicate_in_batch' FROM i WHERE seq NOT IN (SELECT seq FROM f)""",
)
def import_schools(v: Views) -> DataFrame:
    cols = ["facility_key", "name", "county_name", "address", "city", "zipcode", "type_of_school", "data_source", "is_active", "is_verified", "priority_tier"]
    key = F.concat(F.lit("new|"), F.lower("name"))
    out = merge.import_schools(v.school_rows.select(*cols), v.import_schools, new_key=key)
    return out.withColumnRenamed("_action", "action")


IMPORT_STAFF_SQL = """b AS (SELECT contact_id AS seq, first_name, last_name, CASE contact_id % 4 WHEN 0 THEN 'STAFF' || contact_id % 2500 || '@k12.example.org'
      WHEN 1 THEN 'New' || contact_id % 900 || '@example.org' WHEN 2 THEN email ELSE '' END AS email, phone, role,
      CASE WHEN contact_id % 5 = 0 THEN '' ELSE cast(school_id AS varchar) END AS school_id FROM contacts),
    f AS (SELECT *, lower(email) AS m FROM b WHERE email <> '' QUALIFY row_number() OVER (PARTITION BY lower(email) ORDER BY seq) = 1),
    k AS (SELECT lower(email) AS m, max(staff_id) AS staff_id FROM staff_rows WHERE email <> '' GROUP BY 1),
    mx AS (SELECT max(staff_id) AS mx FROM staff_rows),
    x AS (SELECT f.* EXCLUDE (m), staff_id AS old_id, coalesce(staff_id, seq + 1 + mx) AS staff_id FROM f LEFT JOIN k USING (m), mx
      UNION ALL SELECT *, NULL, seq + 1 + (SELECT mx FROM mx) FROM b WHERE email = '')"""
STAFF_COLUMNS = ["staff_id", "name", "phone", "email", "job_name", "school_worked_at", "is_active", "data_source", "is_verified", "last_verified_at"]


def _import_contacts(v: Views) -> merge.ContactImport:
    kind = F.col("contact_id") % 4
    mail = (
        F.when(kind == 0, F.concat(F.lit("STAFF"), (F.col("contact_id") % 2500).cast("string"), F.lit("@k12.example.org")))
        .when(kind == 1, F.concat(F.lit("New"), (F.col("contact_id") % 900).cast("string"), F.lit("@example.org")))
        .when(kind == 2, F.col("email"))
        .otherwise("")
    )
    school = F.when(F.col("contact_id") % 5 == 0, "").otherwise(F.col("school_id").cast("string"))
    rows = v.contacts.select(
        F.col("contact_id").alias("seq"), "first_name", "last_name", mail.alias("email"), "phone", "role", school.alias("school_id")
    )
    return merge.import_contacts(v.staff_rows.select(*STAFF_COLUMNS), v.junction_rows, rows)


@query(
    "import_contacts",
    f"""WITH {IMPORT_STAFF_SQL}
    SELECT s.staff_id, CASE WHEN x.seq IS NULL THEN s.name ELSE trim(x.first_name || ' ' || x.last_name) END AS name,
      CASE WHEN x.seq IS NULL THEN s.phone ELSE x.phone END AS phone, s.email, CASE WHEN x.seq IS NULL THEN s.job_name ELSE x.role END AS job_name,
      CASE WHEN x.seq IS NULL THEN s.school_worked_at ELSE x.school_id END AS school_worked_at,
      CASE WHEN x.seq IS NULL THEN s.is_active ELSE true END AS is_active, CASE WHEN x.seq IS NULL THEN s.data_source ELSE 'imported' END AS data_source,
      s.is_verified, s.last_verified_at, CASE WHEN x.seq IS NULL THEN 'keep' ELSE 'update' END AS action
      FROM staff_rows s LEFT JOIN x ON s.staff_id = x.old_id
    UNION ALL SELECT staff_id, trim(first_name || ' ' || last_name), phone, nullif(email, ''), role, school_id, true, 'imported', false, NULL, 'insert'
      FROM x WHERE old_id IS NULL
    UNION ALL SELECT NULL, NULL, NULL, email, NULL, NULL, NULL, NULL, NULL, NULL, 'duplicate_in_batch' FROM b WHERE email <> '' AND seq NOT IN (SELECT seq FROM f)""",
)
def import_contacts(v: Views) -> DataFrame:
    return _import_contacts(v).staff.withColumnRenamed("_action", "action")


@query(
    "import_contact_links",
    f"""WITH {IMPORT_STAFF_SQL} SELECT school_id, staff_id FROM junction_rows
    UNION ALL SELECT DISTINCT school_id, staff_id FROM x WHERE school_id <> '' AND (school_id, staff_id) NOT IN (SELECT (school_id, staff_id) FROM junction_rows)""",
)
def import_contact_links(v: Views) -> DataFrame:
    return _import_contacts(v).junction


COUNTY_TITLE = r"""array_to_string(list_transform(regexp_extract_all(cn, '\p{Ll}+|[^\p{Ll}]+'), lambda r: upper(r[1]) || r[2:]), '')"""
FACILITY_ROWS_SQL = f"""{FACILITIES_SQL}, fr AS (SELECT facility_key, coalesce({clean_sql('FacilityName')}, 'Unknown School') AS name,
      {clean_sql('Telephone')} AS phone_number, {clean_sql('Administrator')} AS admin, {clean_sql('City')} AS city, {clean_sql('Zip')} AS zipcode,
      {clean_sql('Website')} AS website, {norm_sql('County')} AS cn, {clean_sql('County')} AS cc, seq FROM fn
      QUALIFY row_number() OVER (PARTITION BY facility_key ORDER BY seq DESC) = 1),
    fz AS (SELECT * EXCLUDE (cn, cc), CASE WHEN cc IS NOT NULL THEN {COUNTY_TITLE} END AS county_name FROM fr)"""
FACILITY_COLUMNS = ["facility_key", "name", "phone_number", "admin", "city", "zipcode", "website", "county_name"]


@query(
    "upsert_facilities",
    f"""WITH {FACILITY_ROWS_SQL}, t AS (SELECT facility_key, 'old' AS name, 'kept' AS notes FROM fz WHERE website IS NOT NULL UNION ALL SELECT 'gone|x', 'old', 'kept')
    SELECT coalesce(t.facility_key, z.facility_key) AS facility_key, coalesce(z.name, t.name) AS name, phone_number, admin, city, zipcode, website, county_name,
      t.notes, CASE WHEN t.facility_key IS NULL THEN 'insert' WHEN z.facility_key IS NULL THEN 'keep' ELSE 'update' END AS action
    FROM t FULL JOIN fz z ON t.facility_key = z.facility_key""",
)
def upsert_facilities(v: Views) -> DataFrame:
    old = merge.facility_rows(v.facility_list).filter("website is not null").select("facility_key")
    old = old.unionByName(v.region.filter("r_regionkey = 0").select(F.lit("gone|x").alias("facility_key")))
    empty = [F.lit(None).cast("string").alias(c) for c in FACILITY_COLUMNS[2:]]
    target = old.select("facility_key", F.lit("old").alias("name"), *empty, F.lit("kept").alias("notes"))
    return merge.upsert_facilities(target, v.facility_list).withColumnRenamed("_action", "action")


CITY_KEY = f"'cps|' || regexp_replace(regexp_replace({norm_sql('school_name')}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
DIRECTORY_SQL = f"""d AS (SELECT *, {CITY_KEY} AS facility_key, trim(school_name) AS nm FROM directory_rows WHERE is_high_school),
    p AS (SELECT facility_key, nm, phone, website, seq, u.* FROM d, LATERAL (
      SELECT 0 AS slot, {clean_sql('administrator_name')} AS contact_name, administrator_title AS job_name
      UNION ALL SELECT 1, {clean_sql('second_name')}, second_title) u WHERE contact_name IS NOT NULL),
    r AS (SELECT *, row_number() OVER (PARTITION BY facility_key, seq ORDER BY slot) AS rk FROM p)"""


def _directory(v: Views) -> DataFrame:
    """The city directory with its list order (names are unique, so the name orders it)."""
    order = v.directory_rows.select(F.col("school_name").alias("name"), "seq")
    return city_directory(v).join(order, "name")


@query(
    "contact_rank",
    f"""WITH {DIRECTORY_SQL} SELECT nm AS school_name, facility_key, cast(rk AS varchar) AS contact_rank, contact_name, job_name, phone, website FROM r""",
)
def contact_rank(v: Views) -> DataFrame:
    return merge.contact_rank(_directory(v))


@query(
    "upsert_city_schools",
    f"""WITH {DIRECTORY_SQL}, t AS (SELECT {CITY_KEY} AS facility_key, 'old' AS name FROM directory_rows WHERE trim(administrator_name) = '')
    SELECT coalesce(t.facility_key, d.facility_key) AS facility_key, coalesce(d.nm, t.name) AS name, d.phone AS phone_number, d.website, r.contact_name AS admin,
      CASE WHEN t.facility_key IS NULL THEN 'insert' WHEN d.facility_key IS NULL THEN 'keep' ELSE 'update' END AS action
    FROM t FULL JOIN d ON t.facility_key = d.facility_key LEFT JOIN r ON r.facility_key = d.facility_key AND rk = 1""",
)
def upsert_city_schools(v: Views) -> DataFrame:
    return _city_schools(v).withColumnRenamed("_action", "action")


def _city_schools(v: Views, directory: DataFrame | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    target = v.directory_rows.filter("trim(administrator_name) = ''").select(
        X.city_school_key("school_name").alias("facility_key"), F.lit("old").alias("name"),
        none.alias("phone_number"), none.alias("website"), none.alias("admin"),
    )
    return merge.upsert_city_schools(target, _directory(v) if directory is None else directory)


def _key_sql(*cols: str) -> str:
    return ", ".join(norm_sql(c) for c in cols)


STAFF_TARGET_SQL = f"""inc AS (SELECT * FROM lk QUALIFY row_number() OVER (PARTITION BY {_key_sql('name', 'email', 'job_name', 'school_worked_at')} ORDER BY seq DESC, pos DESC) = 1),
    old AS (SELECT seq * 10 + pos AS staff_id, upper(name) AS name, 'old' AS phone, email, job_name, school_worked_at, true AS is_verified FROM lk WHERE email IS NOT NULL),
    ok AS (SELECT {norm_sql('name')} AS k1, {norm_sql('email')} AS k2, {norm_sql('job_name')} AS k3, {norm_sql('school_worked_at')} AS k4, max(staff_id) AS staff_id
      FROM old GROUP BY ALL),
    mt AS (SELECT inc.*, ok.staff_id FROM inc LEFT JOIN ok ON k1 = {norm_sql('name')} AND k2 = {norm_sql('email')} AND k3 = {norm_sql('job_name')}
      AND k4 = {norm_sql('school_worked_at')})"""
STAFF_MERGED_SQL = """SELECT o.staff_id, coalesce(m.name, o.name) AS name, CASE WHEN m.name IS NULL THEN o.phone ELSE m.phone END AS phone,
      CASE WHEN m.name IS NULL THEN o.email ELSE m.email END AS email, CASE WHEN m.name IS NULL THEN o.job_name ELSE m.job_name END AS job_name,
      CASE WHEN m.name IS NULL THEN o.school_worked_at ELSE m.school_worked_at END AS school_worked_at, {verified} AS is_verified,
      CASE WHEN m.name IS NULL THEN 'keep' ELSE 'update' END AS action FROM old o LEFT JOIN mt m USING (staff_id)
    UNION ALL SELECT NULL, name, phone, email, job_name, school_worked_at, NULL, 'insert' FROM mt WHERE staff_id IS NULL"""


def _linked(v: Views) -> DataFrame:
    return joins.link_scraped_contacts(completed_with_list_names(v), v.facility_list)


def _old_staff(linked: DataFrame) -> DataFrame:
    return linked.filter("email is not null").select(
        (F.col("seq") * 10 + F.col("pos")).alias("staff_id"), F.upper("name").alias("name"), F.lit("old").alias("phone"), "email", "job_name",
        "school_worked_at", F.lit(True).alias("is_verified"), F.lit(None).cast("timestamp_ntz").alias("last_verified_at"),
    )


@query("upsert_staff_scraped", f"WITH {LINKED_SQL}, {STAFF_TARGET_SQL} {STAFF_MERGED_SQL.format(verified='o.is_verified')}")
def upsert_staff_scraped(v: Views) -> DataFrame:
    linked = _linked(v)
    out = merge.upsert_staff(_old_staff(linked), linked, ["seq", "pos"])
    return out.drop("last_verified_at").withColumnRenamed("_action", "action")


@query(
    "reset_verification_on_change",
    f"""WITH {LINKED_SQL}, {STAFF_TARGET_SQL} {STAFF_MERGED_SQL.format(verified="CASE WHEN m.name IS NOT NULL AND m.phone IS DISTINCT FROM o.phone THEN false ELSE o.is_verified END")}""",
)
def reset_verification_on_change(v: Views) -> DataFrame:
    linked = _linked(v)
    out = merge.upsert_staff(_old_staff(linked), linked, ["seq", "pos"], reset_verification=True)
    return out.drop("last_verified_at").withColumnRenamed("_action", "action")


@query(
    "upsert_staff_city",
    f"""WITH {DIRECTORY_SQL}, inc AS (SELECT contact_name AS name, phone, job_name, facility_key AS school_worked_at, seq, slot FROM p),
    o AS (SELECT seq * 10 + slot AS staff_id, name, job_name, school_worked_at FROM inc WHERE phone IS NOT NULL)
    SELECT o.staff_id, i.name, i.phone, cast(NULL AS varchar) AS email, i.job_name, i.school_worked_at,
      CASE WHEN o.staff_id IS NULL THEN 'insert' ELSE 'update' END AS action
    FROM inc i LEFT JOIN o ON o.name = i.name AND o.school_worked_at = i.school_worked_at AND o.job_name IS NOT DISTINCT FROM i.job_name""",
)
def upsert_staff_city(v: Views) -> DataFrame:
    return _city_staff(v).withColumnRenamed("_action", "action")


def _city_staff(v: Views, rows: DataFrame | None = None) -> DataFrame:
    rows = merge.city_staff_rows(_directory(v)) if rows is None else rows
    slot = F.when(F.col("job_name") == "Principal", 0).otherwise(1)
    old = rows.filter("phone is not null").select(
        (F.col("seq") * 10 + slot).alias("staff_id"), "name", F.lit("x").alias("phone"), "email", "job_name", "school_worked_at"
    )
    return merge.upsert_staff(old, rows, ["seq", "pos"])


@query(
    "upsert_counties",
    f"""WITH c AS (SELECT DISTINCT {norm_sql('County')} AS cn FROM facility_list), t AS (SELECT {COUNTY_TITLE} AS county_name FROM c WHERE cn <> ''),
    o AS (SELECT n_name || ' Dekalb O''Brien' AS county_name FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT 'Kept ' || n_name FROM nation)
    SELECT coalesce(t.county_name, o.county_name) AS county_name, CASE WHEN o.county_name IS NULL THEN 'insert' WHEN t.county_name IS NULL THEN 'keep'
      ELSE 'update' END AS action FROM t FULL JOIN o ON t.county_name = o.county_name""",
)
def upsert_counties(v: Views) -> DataFrame:
    nation = v.table("nation")
    old = nation.filter("n_nationkey % 2 = 0").select(F.concat("n_name", F.lit(" Dekalb O'Brien")).alias("county_name"))
    old = old.unionByName(nation.select(F.concat(F.lit("Kept "), "n_name").alias("county_name")))
    return merge.upsert_counties(old, v.facility_list).withColumnRenamed("_action", "action")


@query(
    "upsert_by_optional_id",
    """WITH n AS (SELECT CASE p_partkey % 4 WHEN 0 THEN ' ' || p_partkey % 150 || '.7' WHEN 1 THEN '(Pending)' WHEN 2 THEN 'abc' ELSE cast(p_partkey % 300 AS varchar) END AS raw,
        p_name AS name, p_partkey AS seq FROM part),
    c AS (SELECT cast(trunc(try_cast(trim(raw) AS double)) AS bigint) AS id, name, seq FROM n),
    l AS (SELECT * FROM c WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1)
    SELECT coalesce(s_suppkey, l.id) AS id, coalesce(l.name, s_name) AS name, CASE WHEN s_suppkey IS NULL THEN 'insert' WHEN l.id IS NULL THEN 'keep' ELSE 'update' END
      AS action FROM supplier FULL JOIN l ON s_suppkey = l.id
    UNION ALL SELECT NULL, name, 'insert' FROM c WHERE id IS NULL""",
)
def upsert_by_optional_id(v: Views) -> DataFrame:
    k = F.col("p_partkey")
    raw = (
        F.when(k % 4 == 0, F.concat(F.lit(" "), (k % 150).cast("string"), F.lit(".7")))
        .when(k % 4 == 1, "(Pending)").when(k % 4 == 2, "abc").otherwise((k % 300).cast("string"))
    )
    rows = v.part.select(raw.alias("id"), F.col("p_name").alias("name"), k.alias("seq"))
    target = v.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return merge.upsert_by_optional_id(target, rows, "id", "seq").withColumnRenamed("_action", "action")


# --- list files ---------------------------------------------------------------------------

LIST_FIELDS = ["FacilityName", "City", "Website", "Telephone"]
SCHOOL_LIST_SQL = f"""e AS (SELECT 0 AS src, seq, FacilityName, City, Website, Telephone FROM facility_list),
    i AS (SELECT 1 AS src, seq, CASE seq % 4 WHEN 0 THEN upper(FacilityName) WHEN 1 THEN 'New ' || FacilityName ELSE FacilityName END AS FacilityName,
      CASE WHEN seq % 4 = 2 THEN 'Elsewhere' ELSE City END AS City,
      CASE WHEN seq % 5 = 0 THEN NULL WHEN seq % 7 = 0 THEN '' ELSE Website END AS Website, cast(NULL AS varchar) AS Telephone FROM facility_list),
    ek AS (SELECT *, lower({strip_sql("coalesce(FacilityName, '')")}) AS a, lower({strip_sql("coalesce(City, '')")}) AS b FROM e
      QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY seq) = 1),
    u AS (SELECT * FROM ek UNION ALL SELECT *, lower({strip_sql("coalesce(FacilityName, '')")}), lower({strip_sql("coalesce(City, '')")}) FROM i),
    g AS (SELECT a, b, arg_max(FacilityName, (src, seq)) AS "FacilityName", arg_max(City, (src, seq)) AS "City", arg_max(Website, (src, seq)) AS "Website",
      arg_max(Telephone, (src, seq)) AS "Telephone", CASE WHEN min(src) = 1 THEN 'insert' WHEN max(src) = 1 THEN 'update' ELSE 'keep' END AS action,
      cast(sum(src) AS bigint) AS incoming FROM u GROUP BY 1, 2)"""


def _merged_list(v: Views) -> DataFrame:
    rows = v.facility_list.select("seq", *LIST_FIELDS)
    s = F.col("seq")
    renamed = F.when(s % 4 == 0, F.upper("FacilityName")).when(s % 4 == 1, F.concat(F.lit("New "), "FacilityName"))
    incoming = rows.withColumns(
        {
            "FacilityName": F.when(s % 4 < 2, renamed).otherwise(F.col("FacilityName")),
            "City": F.when(s % 4 == 2, "Elsewhere").otherwise(F.col("City")),
            "Website": F.when(s % 5 == 0, F.lit(None)).when(s % 7 == 0, "").otherwise(F.col("Website")),
            "Telephone": F.lit(None).cast("string"),
        }
    )
    return merge.merge_school_list(rows, incoming, LIST_FIELDS)


@query("merge_school_list", f'WITH {SCHOOL_LIST_SQL} SELECT "FacilityName", "City", "Website", "Telephone", action FROM g')
def merge_school_list(v: Views) -> DataFrame:
    return _merged_list(v).select(*LIST_FIELDS, F.col("_action").alias("action"))


@query(
    "merge_school_list_counts",
    f"""WITH {SCHOOL_LIST_SQL} SELECT count(*) FILTER (action = 'insert') AS inserted,
      cast(sum(incoming) AS bigint) - count(*) FILTER (action = 'insert') AS updated, count(*) AS total FROM g""",
)
def merge_school_list_counts(v: Views) -> DataFrame:
    return merge.merge_school_list_counts(_merged_list(v))


def fold_sql(source: str, keys: str, site: str) -> str:
    """The preferred address by a literal left fold over each key's ordered list."""
    return f"""fold AS (SELECT {keys}, list_reduce(list_prepend('', list({site} ORDER BY seq)), lambda cur, cand:
        CASE WHEN cand LIKE 'https://%' AND cur NOT LIKE 'https://%' THEN cand WHEN length(cand) > length(cur) THEN cand ELSE cur END) AS site
      FROM {source} GROUP BY ALL)"""


DEDUPE_SQL = f"""k AS (SELECT seq, FacilityName, City, {strip_sql("coalesce(Website, '')")} AS w, {plain_name_sql('FacilityName')} AS a, {plain_name_sql('City')} AS b
      FROM facility_list), {fold_sql('k', 'a, b', 'w')},
    f AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY seq) = 1)"""


@query("dedupe_facilities", f'WITH {DEDUPE_SQL} SELECT seq, FacilityName AS "FacilityName", City AS "City", site AS "Website" FROM f JOIN fold USING (a, b)')
def dedupe_facilities(v: Views) -> DataFrame:
    out = merge.dedupe_facilities(v.facility_list.select("seq", "FacilityName", "City", "Website"))
    return out.select("seq", "FacilityName", "City", "Website")


URL_ROWS_SQL = f"""k0 AS (SELECT seq, {strip_sql("coalesce(FacilityName, '')")} AS n, {strip_sql("CASE WHEN seq % 2 = 0 THEN '' ELSE coalesce(City, '') END")} AS c,
      {strip_sql("coalesce(Website, '')")} AS w FROM facility_list),
    k AS (SELECT seq, n, c, w, {norm_sql('n')} AS a, {norm_sql('c')} AS b FROM k0 WHERE n <> '' OR c <> '' OR w <> ''), {fold_sql('k', 'a, b', 'w')},
    f AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY seq) = 1)"""


@query("dedupe_url_rows", f"WITH {URL_ROWS_SQL} SELECT seq, n AS school_name, c AS city, site AS homepage FROM f JOIN fold USING (a, b)")
def dedupe_url_rows(v: Views) -> DataFrame:
    rows = v.facility_list.select(
        "seq", F.col("FacilityName").alias("School Name"), F.when(F.col("seq") % 2 == 0, "").otherwise(F.col("City")).alias("City"),
        F.col("Website").alias("Homepage"),
    )
    return merge.dedupe_url_rows(rows).select("seq", "school_name", "city", "homepage")


@query(
    "preferred_website",
    f"""WITH k AS (SELECT o_custkey % 40 AS site, o_orderkey AS seq, CASE o_orderkey % 3 WHEN 0 THEN 'https://s' ELSE 'http://p' END
        || repeat('x', cast(o_orderkey * 7 % 23 AS integer)) || o_orderkey % 10 AS w FROM orders), {fold_sql('k', 'site', 'w').replace(' AS site', ' AS url')}
    SELECT site, url FROM fold""",
)
def preferred_website(v: Views) -> DataFrame:
    """Ordered fold of many addresses per key, in one hot-key-safe pass."""
    from canvasser.functions.ordering import fold_preferred_website

    k = F.col("o_orderkey")
    url = F.concat(
        F.when(k % 3 == 0, "https://s").otherwise("http://p"), F.repeat(F.lit("x"), (k * 7 % 23).cast("int")), (k % 10).cast("string")
    )
    rows = v.orders.select((F.col("o_custkey") % 40).alias("site"), k.alias("seq"), url.alias("w"))
    return fold_preferred_website(rows, ["site"], "seq", "w", "url")


@query(
    "dedupe_contacts",
    f"""WITH k AS (SELECT *, lower({strip_sql("coalesce(name, '')")}) AS a, lower({strip_sql("coalesce(title, '')")}) AS b, lower({strip_sql("coalesce(dept, '')")}) AS c,
      {strip_sql("coalesce(phone, '')")} AS d, lower({strip_sql("coalesce(email, '')")}) AS e FROM result_contacts)
    SELECT source, seq, pos, name, email FROM k QUALIFY row_number() OVER (PARTITION BY source, seq % 20, a, b, c, d, e ORDER BY seq, pos, school_name) = 1""",
)
def dedupe_contacts(v: Views) -> DataFrame:
    rows = v.result_contacts.withColumns({"site": F.col("seq") % 20, "pos": F.col("pos").cast("bigint")})
    out = merge.dedupe_contacts(rows, ["source", "site"], ["seq", "pos", "school_name"])
    return out.select("source", "seq", "pos", "name", "email")


# --- edits --------------------------------------------------------------------------------


def _delete(v: Views) -> merge.SchoolTables:
    doomed = v.school_rows.filter("not is_active").select(F.col("facility_key").alias("school_id"))
    return merge.cascade_delete_school(v.school_rows, v.staff_rows, v.junction_rows, doomed)


GONE_SQL = """WITH d AS (SELECT facility_key FROM school_rows WHERE NOT is_active),
    g AS (SELECT staff_id FROM staff_rows WHERE school_worked_at IN (SELECT facility_key FROM d))"""


@query(
    "cascade_delete_school",
    f"""{GONE_SQL} SELECT 'schools' AS entity, facility_key AS k, cast(NULL AS bigint) AS staff_id FROM school_rows WHERE facility_key NOT IN (FROM d)
    UNION ALL SELECT 'staff', NULL, staff_id FROM staff_rows WHERE staff_id NOT IN (FROM g)
    UNION ALL SELECT 'links', school_id, staff_id FROM junction_rows WHERE staff_id NOT IN (FROM g) AND school_id NOT IN (FROM d)
    UNION ALL SELECT 'deleted', NULL, staff_id FROM g""",
)
def cascade_delete_school(v: Views) -> DataFrame:
    t = _delete(v)

    def rows(entity: str, df: DataFrame, k: F.Column, staff: F.Column) -> DataFrame:
        return df.select(F.lit(entity).alias("entity"), k.cast("string").alias("k"), staff.cast("bigint").alias("staff_id"))

    none = F.lit(None)
    return (
        rows("schools", t.schools, F.col("facility_key"), none)
        .unionByName(rows("staff", t.staff, none, F.col("staff_id")))
        .unionByName(rows("links", t.junction, F.col("school_id"), F.col("staff_id")))
        .unionByName(rows("deleted", t.deleted_staff, none, F.col("staff_id")))
    )


@query(
    "delete_contacts",
    """WITH d AS (SELECT contact_id * 3 AS staff_id FROM contacts WHERE contact_id % 2 = 0)
    SELECT 'staff' AS entity, cast(NULL AS varchar) AS school_id, staff_id FROM staff_rows WHERE staff_id IS NULL OR staff_id NOT IN (FROM d)
    UNION ALL SELECT 'links', school_id, staff_id FROM junction_rows WHERE staff_id IS NULL OR staff_id NOT IN (FROM d)""",
)
def delete_contacts(v: Views) -> DataFrame:
    """Staff and links that are left when every third id of the even contacts goes; some of these exist."""
    doomed = v.contacts.filter("contact_id % 2 = 0").select((F.col("contact_id") * 3).alias("staff_id"))
    staff, links = merge.delete_contacts(v.staff_rows, v.junction_rows, doomed)
    out = staff.select(F.lit("staff").alias("entity"), F.lit(None).cast("string").alias("school_id"), F.col("staff_id").cast("bigint").alias("staff_id"))
    return out.unionByName(links.select(F.lit("links").alias("entity"), "school_id", F.col("staff_id").cast("bigint").alias("staff_id")))


@query(
    "mark_verified",
    f"""SELECT facility_key, school_id IN (SELECT school_id FROM contacts) OR coalesce(is_verified, false) AS is_verified,
      CASE WHEN school_id IN (SELECT school_id FROM contacts) THEN timestamp '{AS_OF}' ELSE last_verified_at END AS last_verified_at FROM school_rows""",
)
def mark_verified(v: Views) -> DataFrame:
    out = merge.mark_verified(v.school_rows, v.contacts.select("school_id"), "school_id", AS_OF)
    return out.select("facility_key", "is_verified", "last_verified_at")


PATCH_SQL = """p AS (SELECT o_custkey AS school_id, o_orderkey AS seq, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'City ' || o_orderkey END AS city,
      o_orderstatus AS county_name, o_orderkey % 2 = 0 AS has_city, o_orderkey % 3 = 0 AS has_county FROM orders),
    lc AS (SELECT school_id, city FROM p WHERE has_city QUALIFY row_number() OVER (PARTITION BY school_id ORDER BY seq DESC) = 1),
    ln AS (SELECT school_id, county_name FROM p WHERE has_county QUALIFY row_number() OVER (PARTITION BY school_id ORDER BY seq DESC) = 1)"""


@query(
    "patch_rows",
    f"""WITH {PATCH_SQL} SELECT s.school_id, s.name, CASE WHEN lc.school_id IS NULL THEN s.city ELSE lc.city END AS city,
      CASE WHEN ln.school_id IS NULL THEN s.county_name ELSE ln.county_name END AS county_name
    FROM school_rows s LEFT JOIN lc USING (school_id) LEFT JOIN ln USING (school_id)""",
)
def patch_rows(v: Views) -> DataFrame:
    k = F.col("o_orderkey")
    patches = v.orders.select(
        F.col("o_custkey").alias("school_id"), k.alias("seq"),
        F.when(k % 4 != 0, F.concat(F.lit("City "), k.cast("string"))).alias("city"), F.col("o_orderstatus").alias("county_name"),
        F.array_compact(F.array(F.when(k % 2 == 0, "city"), F.when(k % 3 == 0, "county_name"))).alias("provided"),
    )
    target = v.school_rows.select("school_id", "name", "city", "county_name")
    return merge.patch_rows(target, patches, "school_id", ["city", "county_name"])


PATCH_STAFF_SQL = """p AS (SELECT l_partkey AS staff_id, max(l_orderkey) AS seq FROM lineitem WHERE l_quantity > 30 GROUP BY 1),
    s AS (SELECT *, trim(coalesce(name, '')) AS n FROM staff_rows),
    m AS (SELECT s.staff_id, s.name, s.email, s.school_worked_at, p.seq, CASE WHEN p.seq % 3 = 0 THEN 'Zoe'
        WHEN strpos(n, ' ') > 0 THEN substr(n, 1, strpos(n, ' ') - 1) ELSE n END AS f,
      CASE WHEN strpos(n, ' ') > 0 THEN substr(n, strpos(n, ' ') + 1) ELSE '' END AS l FROM s LEFT JOIN p USING (staff_id)),
    o AS (SELECT staff_id, CASE WHEN seq % 3 = 0 THEN trim(f || ' ' || l) ELSE name END AS name, CASE WHEN seq % 5 = 0 THEN NULL ELSE email END AS email,
      CASE WHEN seq % 2 = 0 THEN cast(seq % 50 AS varchar) ELSE school_worked_at END AS school_worked_at, seq % 2 = 0 AS moved FROM m)"""


def _patched_staff(v: Views) -> tuple[DataFrame, DataFrame]:
    # lineitem rows are not unique in their order key, so one patch per member of staff is made.
    per_staff = v.lineitem.filter("l_quantity > 30").groupBy(F.col("l_partkey").alias("staff_id")).agg(F.max("l_orderkey").alias("seq"))
    s = F.col("seq")
    patches = per_staff.select(
        "staff_id", "seq", F.lit("Zoe").alias("first_name"), F.lit(None).cast("string").alias("last_name"),
        F.lit(None).cast("string").alias("email"), (s % 50).cast("string").alias("school_id"),
        F.array_compact(F.array(F.when(s % 3 == 0, "first_name"), F.when(s % 5 == 0, "email"), F.when(s % 2 == 0, "school_id"))).alias("provided"),
    )
    staff = v.staff_rows.select("staff_id", "name", "email", "school_worked_at")
    return merge.patch_contacts(staff, v.junction_rows, patches)


@query("patch_contacts", f"WITH {PATCH_STAFF_SQL} SELECT staff_id, name, email, school_worked_at FROM o")
def patch_contacts(v: Views) -> DataFrame:
    return _patched_staff(v)[0]


@query(
    "patch_contact_links",
    f"""WITH {PATCH_STAFF_SQL} SELECT school_id, staff_id FROM junction_rows WHERE staff_id NOT IN (SELECT staff_id FROM o WHERE moved)
    UNION ALL SELECT school_worked_at, staff_id FROM o WHERE moved""",
)
def patch_contact_links(v: Views) -> DataFrame:
    return _patched_staff(v)[1]


@query(
    "append_rows",
    """SELECT contact_id AS staff_id, trim(first_name || ' ' || last_name) AS name, email, school_id::varchar AS school_worked_at, is_active, 'manual' AS data_source
      FROM contacts UNION ALL SELECT staff_id, name, email, school_worked_at, is_active, data_source FROM staff_rows""",
)
def append_rows(v: Views) -> DataFrame:
    staff = v.staff_rows.select("staff_id", "name", "phone", "email", "job_name", "school_worked_at", "is_active", "data_source")
    rows = v.contacts.withColumnRenamed("contact_id", "staff_id").withColumn("school_id", F.col("school_id").cast("string"))
    out, _ = merge.append_contacts(staff, v.junction_rows, rows)
    return out.select("staff_id", "name", "email", "school_worked_at", "is_active", "data_source")


CALENDAR_SQL = """c AS (SELECT CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE 'k' || o_orderkey % 4000 END AS id, o_orderkey AS seq, 'Fair ' || o_orderkey AS name,
      o_orderstatus AS city, o_orderdate AS d, o_orderkey % 24 AS h, o_orderkey % 60 AS m, o_orderpriority AS note FROM orders),
    r AS (SELECT * FROM c WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1 UNION ALL SELECT * FROM c WHERE id IS NULL),
    f AS (SELECT id AS external_id, name, city, CASE WHEN seq % 17 = 0 THEN NULL ELSE strftime(d, '%Y-%m-%d') END AS date,
      lpad(cast(h AS varchar), 2, '0') || ':' || lpad(cast(m AS varchar), 2, '0') || ':00' AS start_time,
      CASE WHEN seq % 11 = 0 THEN NULL ELSE lpad(cast(h AS varchar), 2, '0') || ':' || lpad(cast(m AS varchar), 2, '0') || ':00' END AS end_time, note FROM r)"""


@query(
    "upsert_calendar_events",
    f"""WITH {CALENDAR_SQL}, t AS (SELECT 'k' || s_suppkey * 50 AS external_id, s_name AS name FROM supplier)
    SELECT coalesce(t.external_id, f.external_id) AS external_id, coalesce(f.name, t.name) AS name, city, date, start_time, end_time, note,
      CASE WHEN t.external_id IS NULL THEN 'insert' WHEN f.external_id IS NULL THEN 'keep' ELSE 'update' END AS action
    FROM t FULL JOIN f ON t.external_id = f.external_id""",
)
def upsert_calendar_events(v: Views) -> DataFrame:
    k = F.col("o_orderkey")
    clock = F.make_timestamp_ntz(F.lit(2000), F.lit(1), F.lit(1), (k % 24).cast("int"), (k % 60).cast("int"), F.lit(0))
    records = v.orders.select(
        F.when(k % 9 != 0, F.concat(F.lit("k"), (k % 4000).cast("string"))).alias("id"), k.alias("seq"),
        F.concat(F.lit("Fair "), k.cast("string")).alias("field_2"), F.col("o_orderstatus").alias("field_3"),
        F.struct(
            F.when(k % 17 != 0, F.date_format("o_orderdate", "MM/dd/yyyy")).alias("date"),
            F.date_format(clock, "h:mm a").alias("time_formatted"),
            F.struct(F.when(k % 11 != 0, F.date_format(clock, "H:mm")).alias("time_formatted")).alias("to"),
        ).alias("field_1_raw"),
        F.col("o_orderpriority").alias("field_38"),
    )
    none = F.lit(None).cast("string")
    target = v.supplier.select(
        F.concat(F.lit("k"), (F.col("s_suppkey") * 50).cast("string")).alias("external_id"), F.col("s_name").alias("name"),
        *[none.alias(c) for c in ("city", "date", "start_time", "end_time", "note")],
    )
    return merge.upsert_calendar_events(target, records).withColumnRenamed("_action", "action")


@query(
    "load_summary",
    f"""WITH {LINKED_SQL}, {STAFF_TARGET_SQL}, {DIRECTORY_SQL},
    ct AS (SELECT {CITY_KEY} AS facility_key FROM directory_rows WHERE trim(administrator_name) = ''),
    ci AS (SELECT contact_name AS name, phone, job_name, facility_key AS school_worked_at, seq, slot FROM p),
    co AS (SELECT seq * 10 + slot AS staff_id, name, job_name, school_worked_at FROM ci WHERE phone IS NOT NULL),
    cm AS (SELECT co.staff_id FROM ci LEFT JOIN co ON co.name = ci.name AND co.school_worked_at = ci.school_worked_at AND co.job_name IS NOT DISTINCT FROM ci.job_name),
    z AS (SELECT facility_key FROM fn GROUP BY 1),
    zt AS (SELECT facility_key FROM z WHERE length(facility_key) % 2 = 0 UNION ALL SELECT 'kept|' || s_suppkey FROM supplier),
    cy AS (SELECT DISTINCT {norm_sql('County')} AS cn FROM facility_list), cn AS (SELECT {COUNTY_TITLE} AS county_name FROM cy WHERE cn <> ''),
    nt AS (SELECT county_name FROM cn WHERE length(county_name) % 2 = 0 UNION ALL SELECT 'Kept ' || n_name FROM nation),
    all_rows AS (SELECT 'county' AS "table", CASE WHEN nt.county_name IS NULL THEN 'insert' WHEN cn.county_name IS NULL THEN 'keep' ELSE 'update' END AS action
      FROM cn FULL JOIN nt ON cn.county_name = nt.county_name
    UNION ALL SELECT 'schools', CASE WHEN zt.facility_key IS NULL THEN 'insert' WHEN z.facility_key IS NULL THEN 'keep' ELSE 'update' END
      FROM z FULL JOIN zt ON z.facility_key = zt.facility_key
    UNION ALL SELECT 'staff', CASE WHEN staff_id IS NULL THEN 'insert' ELSE 'update' END FROM mt
    UNION ALL SELECT 'staff', 'keep' FROM old WHERE staff_id NOT IN (SELECT staff_id FROM mt WHERE staff_id IS NOT NULL)
    UNION ALL SELECT 'city_schools', CASE WHEN ct.facility_key IS NULL THEN 'insert' WHEN d.facility_key IS NULL THEN 'keep' ELSE 'update' END
      FROM ct FULL JOIN d ON ct.facility_key = d.facility_key
    UNION ALL SELECT 'city_staff', CASE WHEN staff_id IS NULL THEN 'insert' ELSE 'update' END FROM cm)
    SELECT "table", action, count(*) AS rows FROM all_rows GROUP BY ALL
    UNION ALL SELECT "table", 'unique_incoming', count(*) FROM all_rows WHERE action <> 'keep' GROUP BY ALL
    UNION ALL SELECT 'staff', 'skipped_unknown_school', count(*) FROM cp WHERE {norm_sql('nm')} NOT IN (SELECT name_key FROM fby) HAVING count(*) > 0""",
)
def load_summary(v: Views) -> DataFrame:
    """Rows per action of a whole load, counted while each merged table is written.

    The customers are dealt out first: a small file is one task's scan, and the texts made of its
    rows are costly to clean. What several merges read is made once and written to the shared folder.
    """
    v = v.with_table("customer", _made(v.customer.repartition(v.spark.sparkContext.defaultParallelism, "c_custkey"), "customers"))
    counties = _made(merge.county_rows(v.facility_list), "counties")
    county_target = counties.filter(F.length("county_name") % 2 == 0).unionByName(v.table("nation").select(F.concat(F.lit("Kept "), "n_name").alias("county_name")))
    listed = _made(joins.with_facility_key(v.facility_list), "list")
    schools = _made(merge.facility_rows(listed), "schools")
    kept = v.supplier.select(F.concat(F.lit("kept|"), F.col("s_suppkey").cast("string")).alias("facility_key"))
    school_target = schools.filter(F.length("facility_key") % 2 == 0).unionByName(kept, allowMissingColumns=True)
    completed = completed_with_list_names(v)
    keys = _made(joins.facility_keys(listed), "keys")
    linked = _made(joins.link_to_keys(completed, keys), "linked")
    directory = _made(_directory(v).repartition(v.spark.sparkContext.defaultParallelism, "seq"), "directory")
    city_staff = _made(merge.city_staff_rows(directory), "city-staff")
    merges = {
        "county": merge.merge_upsert(county_target, counties, ["county_name"]),
        "schools": merge.merge_upsert(school_target, schools, ["facility_key"]),
        "staff": merge.upsert_staff(_old_staff(linked), linked, ["seq", "pos"]),
        "city_schools": _city_schools(v, directory),
        "city_staff": _city_staff(v, city_staff),
    }
    found = [row for table, merged in merges.items() for row in merge.write_counted(merged, fresh_path(v.spark, f"load-{table}"), table)]
    skipped = joins.without_key(completed, keys).count()
    found += [("staff", "skipped_unknown_school", skipped)] if skipped else []
    return v.spark.createDataFrame(found, "`table` string, action string, rows bigint")


def _made(df: DataFrame, label: str) -> DataFrame:
    """The rows written to the shared folder and read again."""
    path = fresh_path(df.sparkSession, f"load-{label}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _rule_documents(v: Views) -> DataFrame:
    """Every rule as a JSON document in one of the four shapes."""
    k, name = F.col("seq") % 4, F.col("school")
    obj = lambda key, value: F.concat(F.lit('{"'), key, F.lit('": '), value, F.lit("}"))
    urls = F.to_json(F.split("urls_csv", ","))
    text = (
        F.when(k == 0, obj(F.lit("school_rules"), obj(name, obj(F.lit("alt_urls"), urls))))
        .when(k == 1, obj(name, obj(F.lit("school_urls"), obj(F.lit("alt_url"), F.lit('" https://site "')))))
        .when(k == 2, F.concat(F.lit('[{"other": 1}, {"SchoolName": " '), name, F.lit(' ", "alt_urls": '), urls, F.lit("}, 5]")))
        .otherwise(obj(F.lit("matches"), F.concat(F.lit('[{"school": "'), name, F.lit('"}, {"school": " "}, 7]'))))
    )
    return v.rule_rows.select("seq", text.alias("text"))


@query(
    "rules_from_json",
    f"""SELECT seq, CASE WHEN seq % 4 = 3 THEN 'matches' ELSE school END AS school,
      CASE seq % 4 WHEN 1 THEN 'https://site' WHEN 3 THEN '' ELSE array_to_string(list_filter({URL_CLEAN}, lambda x, i: list_position({URL_CLEAN}, x) = i), ' ') END AS urls
    FROM rule_rows""",
)
def rules_from_json(v: Views) -> DataFrame:
    out = catalog.rules_from_json(_rule_documents(v), "text", ["seq"])
    return out.select("seq", "school", F.array_join("alt_urls", " ").alias("urls"))


@query("names_from_json", "SELECT seq, school FROM rule_rows")
def names_from_json(v: Views) -> DataFrame:
    return catalog.names_from_json(_rule_documents(v), "text", ["seq"])


# --- action log ---------------------------------------------------------------------------


def action_log(v: Views) -> DataFrame:
    payload = F.struct("name", "county", "is_verified", F.lit(None).cast("timestamp_ntz").alias("last_verified_at"))
    return v.action_log.select("seq", "op", "school_id", payload.alias("payload"), "at")


CHANGES_SQL = """s AS (SELECT school_id, max(seq) FILTER (op = 'ADD') AS ad, max(seq) FILTER (op = 'DELETE') AS dl,
      max(seq) FILTER (op IN ('ADD', 'UPDATE')) AS ct, max(seq) FILTER (op = 'VERIFY') AS vf, max("at") FILTER (op = 'VERIFY') AS va FROM action_log GROUP BY 1),
    j AS (SELECT coalesce(b.school_id, s.school_id) AS school_id, b.school_id IS NOT NULL AS inb, b.name AS bn, b.county AS bc, b.is_verified AS bv,
      s.* EXCLUDE (school_id) FROM action_base b FULL JOIN s USING (school_id)),
    live AS (SELECT j.*, l.name AS ln, l.county AS lc, l.is_verified AS lv FROM j LEFT JOIN action_log l ON l.seq = j.ct
      WHERE CASE WHEN ad IS NULL AND dl IS NULL THEN inb ELSE coalesce(ad, -1) > coalesce(dl, -1) END),
    result AS (SELECT school_id, CASE WHEN ct IS NULL THEN bn ELSE ln END AS name, CASE WHEN ct IS NULL THEN bc ELSE lc END AS county,
      CASE WHEN vf > coalesce(ct, -1) THEN true WHEN ct IS NULL THEN bv ELSE lv END AS is_verified,
      CASE WHEN vf > coalesce(ct, -1) THEN va END AS last_verified_at FROM live)"""


@query("apply_changes", f"WITH {CHANGES_SQL} SELECT * FROM result")
def apply_changes(v: Views) -> DataFrame:
    return merge.apply_changes(v.action_base, action_log(v), "school_id")


@query(
    "cascade_changes",
    """WITH cuts AS (SELECT o_custkey % 60 AS parent, o_orderkey AS seq FROM orders WHERE o_orderpriority = '5-LOW'),
    base AS (SELECT p_partkey AS id, p_partkey % 60 AS parent FROM part),
    w AS (SELECT o_custkey AS id, o_orderkey AS seq, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderkey % 60 END AS parent FROM orders WHERE o_orderpriority <> '5-LOW'),
    ver AS (SELECT id, seq, parent, lead(seq) OVER (PARTITION BY id ORDER BY seq) AS nxt FROM (SELECT id, -1 AS seq, parent FROM base UNION ALL SELECT id, seq, parent FROM w) x),
    hit AS (SELECT v.id, v.seq AS vs, min(c.seq) AS seq FROM ver v JOIN cuts c ON c.parent = v.parent AND c.seq > v.seq AND (v.nxt IS NULL OR c.seq < v.nxt) GROUP BY ALL)
    SELECT DISTINCT id, seq FROM hit""",
)
def cascade_changes(v: Views) -> DataFrame:
    k = F.col("o_orderkey")
    cuts = v.orders.filter("o_orderpriority = '5-LOW'").select((F.col("o_custkey") % 60).alias("parent"), k.alias("seq"))
    base = v.part.select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 60).alias("parent"))
    log = v.orders.filter("o_orderpriority <> '5-LOW'").select(
        F.col("o_custkey").alias("id"), k.alias("seq"), F.when(F.col("o_orderstatus") == "F", "DELETE").otherwise("UPDATE").alias("op"),
        F.struct((k % 60).alias("parent")).alias("payload"),
    )
    return merge.cascade_changes(base, log, "id", "parent", cuts)


@query(
    "apply_school_changes",
    """WITH cuts AS (SELECT school_id, seq FROM action_log WHERE op = 'DELETE'),
    m AS (SELECT seq, school_id AS new_school, name FROM action_log WHERE op = 'UPDATE'),
    c AS (SELECT contact_id, c.school_id, email, m.seq, m.new_school, m.name, (SELECT min(seq) FROM cuts WHERE cuts.school_id = c.school_id) AS first_cut
      FROM contacts c LEFT JOIN m ON m.seq = c.contact_id),
    k AS (SELECT *, seq IS NOT NULL AND (first_cut IS NULL OR first_cut > seq) AS moved FROM c)
    SELECT contact_id, CASE WHEN moved THEN new_school ELSE school_id END AS school_id, CASE WHEN moved THEN name ELSE email END AS email
    FROM k WHERE CASE WHEN moved THEN NOT EXISTS (SELECT 1 FROM cuts x WHERE x.school_id = k.new_school AND x.seq > k.seq) ELSE first_cut IS NULL END""",
)
def apply_school_changes(v: Views) -> DataFrame:
    """Contacts after a log that moves some of them and deletes schools in between."""
    contacts = v.contacts.select("contact_id", "school_id", "email")
    moves = v.action_log.filter("op = 'UPDATE'").select(
        "seq", "op", F.col("seq").alias("contact_id"), F.struct("school_id", F.col("name").alias("email")).alias("payload"), "at"
    )
    return merge.apply_school_changes(v.action_base, contacts, action_log(v), moves)[1]
