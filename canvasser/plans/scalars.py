"""Queries that apply the column expressions to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvasser import schema as M
from canvasser.functions import dates as D
from canvasser.functions import text as X
from canvasser.operators import fuzzy, quality
from canvasser.plans.bindings import Views
from canvasser.plans.load import ROLE_SQL, WS, clean_sql, norm_sql, strip_sql
from canvasser.plans.merging import CITY_KEY
from canvasser.plans.registry import query
from canvasser.plans.lookup import FACILITY_KEY_SQL, NORM_KEY_SQL, plain_name_sql, ratio_sql


def case_sql(column: str, mapping: dict[str, str], default: str = "NULL") -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{x}'" for k, x in mapping.items()) + f" ELSE {default} END"


@query(
    "split_name",
    """WITH s AS (SELECT staff_id, trim(coalesce(name, '')) AS n FROM staff_rows)
    SELECT staff_id, CASE WHEN strpos(n, ' ') > 0 THEN substr(n, 1, strpos(n, ' ') - 1) ELSE n END AS first,
      CASE WHEN strpos(n, ' ') > 0 THEN substr(n, strpos(n, ' ') + 1) ELSE '' END AS last FROM s""",
)
def split_name(v: Views) -> DataFrame:
    return v.staff_rows.select("staff_id", X.split_name("name").alias("n")).select("staff_id", "n.*")


@query("full_name", "SELECT contact_id, trim(first_name || ' ' || last_name) AS name FROM contacts")
def full_name(v: Views) -> DataFrame:
    return v.contacts.select("contact_id", X.full_name("first_name", "last_name").alias("name"))


@query("classify_role", f"SELECT staff_id, {ROLE_SQL} AS role FROM staff_rows")
def classify_role(v: Views) -> DataFrame:
    return v.staff_rows.select("staff_id", X.classify_role("job_name").alias("role"))


@query("resolve_role", f"""SELECT staff_id, {case_sql("lower(trim(coalesce(job_name, '')))", M.ROLE_SYNONYMS, "'counselor'")} AS role FROM staff_rows""")
def resolve_role(v: Views) -> DataFrame:
    return v.staff_rows.select("staff_id", X.resolve_role("job_name").alias("role"))


@query(
    "school_type",
    """SELECT school_id, CASE WHEN lower(type_of_school) LIKE '%middle%' OR lower(type_of_school) LIKE '%junior%' THEN 'middle_school' ELSE 'high_school' END AS stored,
      CASE WHEN lower(type_of_school) LIKE '%middle%' THEN 'middle_school' ELSE 'high_school' END AS imported FROM school_rows""",
)
def school_type(v: Views) -> DataFrame:
    return v.school_rows.select(
        "school_id", X.school_type("type_of_school").alias("stored"), X.school_type("type_of_school", ["middle"]).alias("imported")
    )


@query("clean_text", f"SELECT doc_id, md5({clean_sql("chr(9) || ' ' || text || chr(10)")}) AS cleaned FROM documents")
def clean_text(v: Views) -> DataFrame:
    padded = F.concat(F.lit("\t "), "text", F.lit("\n"))
    return v.documents.select("doc_id", F.md5(X.clean_text(padded)).alias("cleaned"))


RAW_NUMBER = """CASE p_partkey % 12 WHEN 8 THEN '5d' WHEN 9 THEN '1f' WHEN 10 THEN '0x10p0' WHEN 11 THEN '1e3' WHEN 0 THEN ' ' || p_retailprice WHEN 1 THEN '(Pending)' WHEN 2 THEN 'none' WHEN 3 THEN '' WHEN 4 THEN '-' || p_size || '.9'
      WHEN 5 THEN p_name WHEN 6 THEN NULL ELSE cast(p_partkey AS varchar) || ' ' END"""


@query("safe_int", f"SELECT p_partkey, cast(trunc(try_cast(trim({RAW_NUMBER}) AS double)) AS bigint) AS number FROM part")
def safe_int(v: Views) -> DataFrame:
    raw = F.expr(RAW_NUMBER.replace("varchar", "string"))
    return v.part.select("p_partkey", X.safe_int(raw).alias("number"))


def _key() -> F.Column:
    return X.facility_key(*[F.col(c) for c in ("FacilityKey", "County", "FacilityName", "City", "Zip", "NCES_ID")])


@query("facility_key", f"SELECT seq, {FACILITY_KEY_SQL} AS facility_key FROM facility_list")
def facility_key(v: Views) -> DataFrame:
    return v.facility_list.select("seq", _key().alias("facility_key"))


@query("normalize_facility_key", f"WITH k AS (SELECT seq, {FACILITY_KEY_SQL} AS fk FROM facility_list) SELECT seq, {NORM_KEY_SQL} AS facility_key FROM k")
def normalize_facility_key(v: Views) -> DataFrame:
    return v.facility_list.select("seq", X.normalize_facility_key(_key()).alias("facility_key"))


@query("normalize_text", f"SELECT doc_id, md5({norm_sql('text')}) AS normalized, length({norm_sql('text')}) AS n FROM documents")
def normalize_text(v: Views) -> DataFrame:
    out = v.documents.select("doc_id", X.normalize_text("text").alias("t"))
    return out.select("doc_id", F.md5("t").alias("normalized"), F.length("t").cast("bigint").alias("n"))


@query("slug", f"SELECT doc_id, md5(regexp_replace(regexp_replace({norm_sql('text')}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS slug FROM documents")
def slug(v: Views) -> DataFrame:
    return v.documents.select("doc_id", F.md5(X.slug("text")).alias("slug"))


@query("city_school_key", f"SELECT school_id, {CITY_KEY} AS facility_key FROM directory_rows")
def city_school_key(v: Views) -> DataFrame:
    return v.directory_rows.select("school_id", X.city_school_key("school_name").alias("facility_key"))


@query(
    "py_title",
    r"""SELECT doc_id, md5(array_to_string(list_transform(regexp_extract_all(lower(text), '\p{Ll}+|[^\p{Ll}]+'), lambda r: CASE WHEN r[1] = 'ß' THEN 'Ss' ELSE upper(r[1]) END || r[2:]), '')) AS title
      FROM documents""",
)
def py_title(v: Views) -> DataFrame:
    return v.documents.select("doc_id", F.md5(X.letter_title("text")).alias("title"))


@query(
    "word_title",
    f"""SELECT doc_id, md5(array_to_string(list_transform(string_split(trim(regexp_replace(text, '{WS}+', ' ', 'g')), ' '),
      lambda w: CASE WHEN w[1] = 'ß' THEN 'SS' ELSE upper(w[1]) END || lower(w[2:])), ' ')) AS title FROM documents""",
)
def word_title(v: Views) -> DataFrame:
    return v.documents.select("doc_id", F.md5(X.word_title("text")).alias("title"))


@query("normalize_facility_name", f"SELECT seq, {plain_name_sql('FacilityName')} AS name, {plain_name_sql('City')} AS city FROM facility_list")
def normalize_facility_name(v: Views) -> DataFrame:
    return v.facility_list.select(
        "seq", X.normalize_facility_name("FacilityName").alias("name"), X.normalize_facility_name("City").alias("city")
    )


@query(
    "normalize_urls",
    """WITH u AS (SELECT seq, list_filter(list_transform(string_split(urls_csv, ','), lambda x: trim(x)), lambda x: x <> '') AS l FROM rule_rows)
    SELECT seq, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') AS urls FROM u""",
)
def normalize_urls(v: Views) -> DataFrame:
    return v.rule_rows.select("seq", F.array_join(X.normalize_urls(F.split("urls_csv", ",")), ",").alias("urls"))


@query(
    "build_urls",
    f"""SELECT page_id, array_to_string(list_transform([{', '.join(f"'{p}'" for p in M.CONTACT_PATHS)}],
      lambda p: regexp_replace(url || '//', '/+$', '') || p), ' ') AS urls FROM pages""",
)
def build_urls(v: Views) -> DataFrame:
    base = F.concat("url", F.lit("//"))
    return v.table("pages").select("page_id", F.array_join(X.build_urls(base, M.CONTACT_PATHS), " ").alias("urls"))


@query("is_valid_email", f"""SELECT contact_id, regexp_matches(email, '^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$') AS valid FROM contacts""")
def is_valid_email(v: Views) -> DataFrame:
    return v.contacts.select("contact_id", X.is_valid_email("email").alias("valid"))


@query(
    "format_school_type",
    f"""SELECT 'school' AS entity, school_id AS id, CASE WHEN school_type = 'high_school' THEN 'High School' ELSE 'Middle School' END AS label FROM schools
    UNION ALL SELECT 'contact', contact_id, {case_sql('role', M.ROLE_LABELS)} FROM contacts
    UNION ALL SELECT 'event', event_id, {case_sql('type', M.EVENT_LABELS)} FROM outreach_events
    UNION ALL SELECT 'program', program_id, {case_sql('category', M.PROGRAM_LABELS)} FROM programs""",
)
def format_school_type(v: Views) -> DataFrame:
    def part(entity: str, df: DataFrame, key: str, label: F.Column) -> DataFrame:
        return df.select(F.lit(entity).alias("entity"), F.col(key).alias("id"), label.alias("label"))

    return (
        part("school", v.schools, "school_id", X.format_school_type("school_type"))
        .unionByName(part("contact", v.contacts, "contact_id", X.labels("role", M.ROLE_LABELS)))
        .unionByName(part("event", v.outreach_events, "event_id", X.labels("type", M.EVENT_LABELS)))
        .unionByName(part("program", v.programs, "program_id", X.labels("category", M.PROGRAM_LABELS)))
    )


@query(
    "activity_label",
    """SELECT activity_id, array_to_string(list_transform(string_split(replace(activity_type, '_', ' '), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS label
      FROM activities""",
)
def activity_label(v: Views) -> DataFrame:
    return v.activities.select("activity_id", X.activity_label("activity_type").alias("label"))


@query(
    "truncate_label",
    """SELECT doc_id, CASE WHEN length(text) > 22 THEN substr(text, 1, 20) || '…' ELSE text END AS label,
      CASE WHEN length(source) > 4 THEN substr(source, 1, 3) || '…' ELSE source END AS short FROM documents""",
)
def truncate_label(v: Views) -> DataFrame:
    return v.documents.select(
        "doc_id", X.truncate_label("text", 22, 20).alias("label"), X.truncate_label("source", 4, 3).alias("short")
    )


EVENT_TEXT = "CASE event_id % 5 WHEN 0 THEN 'e_' || event_id WHEN 1 THEN 'se_' || event_id WHEN 2 THEN 's_' || event_id WHEN 3 THEN cast(event_id AS varchar) ELSE 'x' || event_id END"


@query("format_event_id", "SELECT event_id, 'e_' || event_id AS formatted FROM events")
def format_event_id(v: Views) -> DataFrame:
    return v.table("events").select("event_id", X.format_event_id("event_id").alias("formatted"))


@query("parse_event_id", "SELECT event_id, CASE WHEN event_id % 5 <> 4 THEN event_id END AS parsed FROM events")
def parse_event_id(v: Views) -> DataFrame:
    text = F.expr(EVENT_TEXT.replace("varchar", "string"))
    return v.table("events").select("event_id", X.parse_event_id(text).alias("parsed"))


@query(
    "participants_split",
    """WITH p AS (SELECT event_id, list_filter(list_transform(string_split(coalesce(schools_involved, ''), ','), lambda x: trim(x)), lambda x: x <> '') AS l FROM event_rows)
    SELECT event_id, cast(len(l) AS integer) AS n, array_to_string(l, '|') AS ids FROM p""",
)
def participants_split(v: Views) -> DataFrame:
    parts = X.participants_split("schools_involved")
    return v.event_rows.select("event_id", F.size(parts).alias("n"), F.array_join(parts, "|").alias("ids"))


@query(
    "participants_join",
    """SELECT event_id, nullif(concat_ws(',', CASE WHEN event_id % 3 > 0 THEN 'a' || event_id END, CASE WHEN event_id % 3 = 2 THEN 'b' END), '') AS schools_involved
    FROM event_rows""",
)
def participants_join(v: Views) -> DataFrame:
    k = F.col("event_id") % 3
    ids = F.array_compact(F.array(F.when(k > 0, F.concat(F.lit("a"), F.col("event_id").cast("string"))), F.when(k == 2, F.lit("b"))))
    return v.event_rows.select("event_id", X.participants_join(ids).alias("schools_involved"))


@query(
    "months_before",
    """SELECT event_id, ts - interval 1 month AS one, ts - interval 6 month AS six, ts - interval 12 month AS year,
      timestamp '2024-03-31 10:00:00' - interval 1 month < ts AS recent FROM events""",
)
def months_before(v: Views) -> DataFrame:
    ts = F.col("ts")
    return v.table("events").select(
        "event_id", D.months_before(ts, 1).alias("one"), D.months_before(ts, 6).alias("six"), D.months_before(ts, 12).alias("year"),
        (ts > D.months_before("2024-03-31 10:00:00", 1)).alias("recent"),
    )


@query(
    "days_between",
    """SELECT event_id, (epoch_us(timestamp '2024-01-15 12:00:00') - epoch_us(ts)) // 86400000000 AS days FROM events""",
)
def days_between(v: Views) -> DataFrame:
    return v.table("events").select("event_id", D.days_between(D.at("2024-01-15 12:00:00"), F.col("ts")).alias("days"))


@query("format_day", "SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 'Never' ELSE strftime(o_orderdate, '%b %-d, %Y') END AS day FROM orders")
def format_day(v: Views) -> DataFrame:
    day = F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderdate"))
    return v.orders.select("o_orderkey", D.format_day(day).alias("day"))


@query("to_db_date", "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE strftime(ts, '%Y-%m-%d') END AS day FROM events")
def to_db_date(v: Views) -> DataFrame:
    text = F.when(F.col("event_id") % 7 != 0, F.date_format("ts", "MM/dd/yyyy")).otherwise(F.date_format("ts", "dd.MM.yyyy"))
    return v.table("events").select("event_id", D.to_db_date(text).alias("day"))


@query("to_db_time", "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE strftime(ts, '%H:%M:00') END AS clock FROM events")
def to_db_time(v: Views) -> DataFrame:
    k, ts = F.col("event_id") % 7, F.col("ts")
    clock = F.when(k == 0, "soon").when(k < 4, F.date_format(ts, "h:mm a")).otherwise(F.date_format(ts, "HH:mm"))
    return v.table("events").select("event_id", D.to_db_time(clock).alias("clock"))


@query(
    "pct_round",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN 0 ELSE cast(floor(100.0::double * (o_orderkey % 97) / (o_orderkey % 13) + 0.5) AS bigint) END AS pct
    FROM orders""",
)
def pct_round(v: Views) -> DataFrame:
    a, b = F.col("o_orderkey") % 97, F.col("o_orderkey") % 13
    return v.orders.select("o_orderkey", X.pct_round(a, b).alias("pct"))


@query(
    "one_decimal",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN 0.0 ELSE round((o_orderkey % 97)::double / (o_orderkey % 13), 1) END AS ratio FROM orders",
)
def one_decimal(v: Views) -> DataFrame:
    a, b = F.col("o_orderkey") % 97, F.col("o_orderkey") % 13
    return v.orders.select("o_orderkey", X.one_decimal(a, b).alias("ratio"))


@query("split_event_timestamp", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS date, strftime(ts, '%H:%M:%S') AS time FROM events")
def split_event_timestamp(v: Views) -> DataFrame:
    return v.table("events").select("event_id", D.split_event_timestamp(F.col("ts")).alias("p")).select("event_id", "p.*")


@query(
    "indel_ratio",
    f"""WITH n AS (SELECT DISTINCT p_name AS a, lower(p_type || ' ' || p_name) AS b FROM part)
    SELECT a, b, round({ratio_sql('a', 'b')}, 6) AS ratio FROM n""",
)
def indel_ratio(v: Views) -> DataFrame:
    names = v.part.select(F.col("p_name").alias("a"), F.lower(F.concat_ws(" ", "p_type", "p_name")).alias("b")).distinct()
    return names.select("a", "b", F.round(fuzzy.indel_ratio("a", "b"), 6).alias("ratio"))


@query(
    "form_errors",
    r"""SELECT 'school' AS entity, school_id AS id, concat_ws(',', CASE WHEN name = '' THEN 'name' END, CASE WHEN county = '' THEN 'county' END,
      CASE WHEN address = '' THEN 'address' END, CASE WHEN city = '' THEN 'city' END, CASE WHEN state = '' THEN 'state' END,
      CASE WHEN length(zip_code) < 5 THEN 'zip_code' END) AS errors FROM schools
    UNION ALL SELECT 'contact', contact_id, concat_ws(',', CASE WHEN first_name = '' THEN 'first_name' END, CASE WHEN last_name = '' THEN 'last_name' END,
      CASE WHEN NOT regexp_matches(email, '^[^\s@]+@[^\s@]+\.[^\s@]+$') THEN 'email' END) FROM contacts
    UNION ALL SELECT 'event', event_id, concat_ws(',', CASE WHEN name = '' THEN 'name' END, CASE WHEN location = '' THEN 'location' END) FROM outreach_events
    UNION ALL SELECT 'program', program_id, CASE WHEN category = 'unlisted' THEN 'category' ELSE '' END FROM programs""",
)
def form_errors(v: Views) -> DataFrame:
    def part(entity: str, df: DataFrame, key: str, errors: F.Column) -> DataFrame:
        return df.select(F.lit(entity).alias("entity"), F.col(key).alias("id"), F.array_join(errors, ",").alias("errors"))

    return (
        part("school", v.schools, "school_id", quality.school_form_errors())
        .unionByName(part("contact", v.contacts, "contact_id", quality.contact_form_errors()))
        .unionByName(part("event", v.outreach_events, "event_id", quality.event_form_errors()))
        .unionByName(part("program", v.programs, "program_id", quality.program_form_errors()))
    )
