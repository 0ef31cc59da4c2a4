"""Queries over validation, quarantine and page extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvasser import schema as M
from canvasser.operators import catalog, extract, quality
from canvasser.plans.bindings import Views
from canvasser.plans.load import COMBINED_SQL, WS, results, strip_sql
from canvasser.plans.registry import query

# --- import checks ------------------------------------------------------------------------


def _mapped(v: Views, raw: DataFrame | None = None) -> DataFrame:
    raw = v.import_contacts_raw if raw is None else raw
    mapping = quality.auto_map_columns([c for c in raw.columns if c != "row"], "contacts")
    return quality.map_row(raw, mapping, keep=["row"])


@query(
    "auto_map_columns",
    """SELECT 'firstName' AS field, count(*) FILTER ("firstName" <> '') AS filled FROM import_contacts
    UNION ALL SELECT 'lastName', count(*) FILTER ("lastName" <> '') FROM import_contacts
    UNION ALL SELECT 'email', count(*) FILTER (email <> '') FROM import_contacts
    UNION ALL SELECT 'role', count(*) FILTER (role <> '') FROM import_contacts
    UNION ALL SELECT 'schoolId', count(*) FILTER ("schoolId" <> '') FROM import_contacts""",
)
def auto_map_columns(v: Views) -> DataFrame:
    """Filled values per field found for the headers of the file."""
    rows = _mapped(v).drop("row")
    counts = rows.agg(*[F.count_if(F.col(c) != "").alias(c) for c in rows.columns])
    return counts.unpivot([], rows.columns, "field", "filled")


@query("map_row", "SELECT * FROM import_contacts")
def map_row(v: Views) -> DataFrame:
    return _mapped(v)


CONTACT_ISSUES_SQL = r"""ce AS (SELECT DISTINCT lower(email) AS e FROM contacts), sn AS (SELECT DISTINCT lower(name) AS n FROM schools),
    ii AS (SELECT "row", 'firstName' AS field, 'Missing first name' AS message, 'error' AS severity FROM import_contacts WHERE "firstName" = ''
    UNION ALL SELECT "row", 'lastName', 'Missing last name', 'error' FROM import_contacts WHERE "lastName" = ''
    UNION ALL SELECT "row", 'email', 'Missing email', 'error' FROM import_contacts WHERE email = ''
    UNION ALL SELECT "row", 'email', 'Invalid email format', 'error' FROM import_contacts WHERE email <> '' AND NOT regexp_matches(email, '^[^\s@]+@[^\s@]+\.[^\s@]+$')
    UNION ALL SELECT "row", 'email', 'Duplicate email (already exists)', 'warning' FROM import_contacts WHERE lower(email) IN (FROM ce)
    UNION ALL SELECT "row", 'schoolId', 'School "' || "schoolId" || '" not found — row will be skipped', 'error' FROM import_contacts
      WHERE "schoolId" <> '' AND lower("schoolId") NOT IN (FROM sn))"""


@query("validate_contacts", f"WITH {CONTACT_ISSUES_SQL} SELECT * FROM ii")
def validate_contacts(v: Views) -> DataFrame:
    return quality.validate_contacts(_mapped(v), v.contacts, v.schools)


@query(
    "clean_rows",
    f"""WITH {CONTACT_ISSUES_SQL} SELECT * FROM import_contacts WHERE "row" NOT IN (SELECT "row" FROM ii WHERE severity = 'error')""",
)
def clean_rows(v: Views) -> DataFrame:
    rows = _mapped(v)
    return quality.clean_rows(rows, quality.validate_contacts(rows, v.contacts, v.schools))


@query(
    "validate_schools",
    """SELECT seq AS "row", 'name' AS field, 'Missing school name' AS message, 'error' AS severity FROM import_schools WHERE name = ''
    UNION ALL SELECT seq, 'county', 'Missing county', 'error' FROM import_schools WHERE county = ''
    UNION ALL SELECT seq, 'name', 'School already exists — will be skipped', 'warning' FROM import_schools WHERE lower(name) IN (SELECT lower(name) FROM schools)""",
)
def validate_schools(v: Views) -> DataFrame:
    return quality.validate_schools(v.import_schools, v.schools, row="seq")


@query("duplicate_names", "SELECT seq, name FROM import_schools WHERE lower(name) IN (SELECT lower(name) FROM schools)")
def duplicate_names(v: Views) -> DataFrame:
    return quality.duplicate_names(v.import_schools, v.schools).select("seq", "name")


REASONS_SQL = rf"""n AS (SELECT *, {strip_sql("coalesce(name, '')")} AS who, {strip_sql("coalesce(title, '')")} AS ttl FROM result_contacts),
    rs AS (SELECT source, school_name, seq, pos, list_filter(list_concat(CASE WHEN who = '' THEN ['name is empty'] ELSE [
      CASE WHEN length(regexp_replace(who, '[^\p{{L}}]', '', 'g')) < 3 THEN 'name has too few letters' END,
      CASE WHEN regexp_matches(who, '\p{{Nd}}') THEN 'name contains digits' END,
      CASE WHEN regexp_matches(lower(who), 'school|district|building|department|campus|office|academy|elementary|middle|high|board')
        THEN 'name looks like organization text' END,
      CASE WHEN len(string_split(trim(regexp_replace(replace(who, '.', ' '), '\s+', ' ', 'g')), ' ')) > 4 THEN 'name has too many tokens' END] END,
      [CASE WHEN ttl = '' THEN 'missing title' END]), lambda x: x IS NOT NULL) AS r FROM n)"""


def _flagged(v: Views) -> DataFrame:
    rows = v.result_contacts.select("source", "school_name", "seq", F.col("pos").cast("bigint").alias("pos"), "name", "title")
    return rows.withColumn("reasons", quality.contact_unlikely_reasons(F.col("name"), F.col("title")))


@query("contact_unlikely_reasons", f"WITH {REASONS_SQL} SELECT source, school_name, pos, array_to_string(r, '; ') AS reasons FROM rs WHERE len(r) > 0")
def contact_unlikely_reasons(v: Views) -> DataFrame:
    out = _flagged(v).filter(F.size("reasons") > 0)
    return out.select("source", "school_name", "pos", F.array_join("reasons", "; ").alias("reasons"))


@query(
    "school_unlikely_reasons",
    """SELECT source, seq, CASE WHEN error IS NULL AND n_contacts > 0 AND base_url IS NULL THEN 'school_urls is missing'
      WHEN error IS NULL AND n_contacts > 0 AND pages_csv = '' THEN 'contacts found but pages_with_contacts is empty' ELSE '' END AS reasons FROM result_rows""",
)
def school_unlikely_reasons(v: Views) -> DataFrame:
    reasons = quality.school_unlikely_reasons(
        F.col("error"), F.col("contacts"), F.col("pages_with_contacts"), F.col("base_url").isNotNull()
    )
    return results(v).select("source", "seq", F.array_join(reasons, ",").alias("reasons"))


@query(
    "quarantine",
    f"""WITH {REASONS_SQL},
    sr AS (SELECT *, CASE WHEN error IS NULL AND n_contacts > 0 AND base_url IS NULL THEN 'school_urls is missing'
        WHEN error IS NULL AND n_contacts > 0 AND pages_csv = '' THEN 'contacts found but pages_with_contacts is empty' ELSE '' END AS r FROM result_rows),
    gone AS (SELECT * FROM sr WHERE r <> '' AND seq % 2 = 0),
    cs AS (SELECT rs.*, (source, seq) IN (SELECT (source, seq) FROM gone) AS with_school FROM rs)
    SELECT 'school_result' AS flag_type, source, seq, school_name, cast(NULL AS integer) AS pos, base_url, alt_url, r AS reasons FROM gone
    UNION ALL SELECT 'contact', cs.source, cs.seq, cs.school_name, pos, base_url, alt_url, array_to_string(cs.r, '; ') FROM cs
      JOIN result_rows w ON w.source = cs.source AND w.seq = cs.seq AND w.school_name = cs.school_name WHERE NOT with_school AND len(cs.r) > 0 AND cs.seq % 3 <> 0
    UNION ALL SELECT 'kept', source, seq, school_name, pos, NULL, NULL, array_to_string(r, '; ') FROM cs WHERE NOT with_school AND NOT (len(r) > 0 AND seq % 3 <> 0)""",
)
def quarantine(v: Views) -> DataFrame:
    """Flagged schools and contacts whose decision is "error" move with their record; the others stay."""
    reasons = quality.school_unlikely_reasons(F.col("error"), F.col("contacts"), F.col("pages_with_contacts"), F.col("base_url").isNotNull())
    schools = results(v).withColumn("reasons", reasons)
    key = ["source", "seq", "school_name"]
    on_school = F.when(F.col("seq") % 2 == 0, "error").otherwise("keep").alias("decision")
    on_contact = F.when(F.col("seq") % 3 != 0, "error").otherwise("keep").alias("decision")
    _, kept, errors = quality.quarantine_results(
        schools, _flagged(v), key, "pos", schools.select(*key, on_school), _flagged(v).select(*key, "pos", on_contact)
    )
    none = F.lit(None).cast("string")
    same = ["flag_type", *key, F.col("pos").cast("int").alias("pos"), "base_url", "alt_url", F.array_join("reasons", "; ").alias("reasons")]
    kept = kept.withColumns({"flag_type": F.lit("kept"), "base_url": none, "alt_url": none})
    return errors.select(*same).unionByName(kept.select(*same))


@query(
    "list_classification",
    f"""WITH {COMBINED_SQL} SELECT school_name, n_contacts = 0 AS no_contacts, n_contacts > 0 AS with_contacts, pages_csv = '' AS no_staff_page FROM combined""",
)
def list_classification(v: Views) -> DataFrame:
    combined = catalog.combine_results(results(v, "still_working"), results(v, "completed"))
    return catalog.list_classification(combined).select("school_name", "no_contacts", "with_contacts", "no_staff_page")


# --- extraction ---------------------------------------------------------------------------



def _unicode(pattern: str) -> str:
    """A pattern of the data model with its classes spelled out, as the checking engine's are ASCII."""
    return pattern.replace(r"[\s.-]", f"[{WS[1:-1]}.-]").replace(r"\s", WS).replace(r"\d", r"\p{Nd}")


MAIL_RE = M.EMAIL_PATTERN.split(")", 1)[1]  # the checking engine has no look-behind
PHONE_RE = _unicode(M.PHONE_PATTERN)
MESSAGE_RE = "(?i)" + _unicode(M.MESSAGE_PATTERN)


def signals_sql(table: str, key: str, text: str) -> str:
    kinds = {"email": MAIL_RE, "phone": PHONE_RE, "message": MESSAGE_RE}
    parts = [
        f"""SELECT {key}, '{kind}' AS kind, cast(generate_subscripts(l, 1) - 1 AS integer) AS ord, unnest(l) AS value
        FROM (SELECT {key}, regexp_extract_all({text}, '{pattern}') AS l FROM {table}) x"""
        for kind, pattern in kinds.items()
    ]
    return "\nUNION ALL ".join(parts)


@query("extract_signals", signals_sql("documents", "doc_id", "text"))
def extract_signals(v: Views) -> DataFrame:
    return extract.extract_signals(v.documents, "doc_id", "text")


@query("extract_page_signals", signals_sql("site_pages", "page_id", "html"))
def extract_page_signals(v: Views) -> DataFrame:
    return extract.extract_signals(v.site_pages, "page_id", "html")


@query("extract_blocks")
def extract_blocks(v: Views) -> DataFrame:
    return _blocks(v.site_pages)


@query(
    "card_blocks",
    """SELECT 1000000000 + s_suppkey AS page_id, 'https://d' || s_suppkey || '.example.org/staff' AS url, 'S' || s_suppkey || '@D.example.org' AS link_email,
      s_name || ' JONES | ' || CASE s_suppkey % 4 WHEN 0 THEN 'Dean Of Students' WHEN 1 THEN 'school counselor' WHEN 2 THEN 'Assistant Principal' ELSE 'Admissions' END
      || ' | Room ' || s_nationkey || ' | (618)' || CASE WHEN s_suppkey % 3 = 0 THEN chr(160) ELSE ' ' END || '555-' || lpad(cast(s_suppkey % 10000 AS varchar), 4, '0') AS lines
    FROM supplier
    UNION ALL SELECT 1000000000 + s_suppkey, 'https://d' || s_suppkey || '.example.org/staff', 'p' || s_suppkey || '@x.example.org',
      'Pat Plain | Principal | p' || s_suppkey || '@x.example.org' FROM supplier""",
)
def card_blocks(v: Views) -> DataFrame:
    """Blocks of the pages made from suppliers; ``extract_blocks`` takes the raw pages as well."""
    return _blocks(v.card_pages)


def _blocks(pages: DataFrame) -> DataFrame:
    return extract.extract_blocks(pages).select("page_id", "url", "link_email", F.array_join("lines", " | ").alias("lines"))


FIELDS_SQL = """SELECT 1000000000 + s_suppkey AS page_id, 'Supplier#' || lpad(cast(s_suppkey AS varchar), 9, '0') || ' Jones' AS name,
      CASE s_suppkey % 4 WHEN 0 THEN 'Dean Of Students' WHEN 1 THEN 'School Counselor' ELSE 'Admissions' END AS title, 'Room ' || s_nationkey AS dept,
      '(618)' || CASE WHEN s_suppkey % 3 = 0 THEN chr(160) ELSE ' ' END || '555-' || lpad(cast(s_suppkey % 10000 AS varchar), 4, '0') AS phone, 's' || s_suppkey || '@d.example.org' AS email
    FROM supplier WHERE s_suppkey % 4 <> 2
    UNION ALL SELECT 1000000000 + s_suppkey, 'Pat Plain', 'Principal', '', '', 'p' || s_suppkey || '@x.example.org' FROM supplier"""


@query("assign_fields", FIELDS_SQL)
def assign_fields(v: Views) -> DataFrame:
    out = extract.assign_fields(extract.extract_blocks(v.site_pages))
    return out.select("page_id", "name", "title", "dept", "phone", "email")


def _term_sql(words: list[str], mode: str) -> str:
    body = "|".join(words)
    return rf"\b(?:{body})\b" if mode == "word" else body


TITLE_TEXT = "coalesce(job_name, '') || ' ' || CASE staff_id % 5 WHEN 0 THEN 'Dean of Students' WHEN 1 THEN 'Student Services' WHEN 2 THEN 'primary counselor' WHEN 3 THEN 'Deanery' ELSE '' END"


@query(
    "title_match",
    f"""WITH t AS (SELECT staff_id, lower({TITLE_TEXT}) AS x FROM staff_rows)
    SELECT staff_id, regexp_matches(x, '{_term_sql(M.TITLE_TERMS, "sub")}') AND NOT regexp_matches(x, '{_term_sql(M.TITLE_REJECTS, "sub")}') AS anywhere,
      regexp_matches(x, '{_term_sql(M.TITLE_TERMS, "word")}') AND NOT regexp_matches(x, '{_term_sql(M.TITLE_REJECTS, "word")}') AS whole_word FROM t""",
)
def title_match(v: Views) -> DataFrame:
    line = F.expr(TITLE_TEXT)
    return v.staff_rows.select(
        "staff_id", extract.title_match(line).alias("anywhere"), extract.title_match(line, "word").alias("whole_word")
    )


@query(
    "link_email",
    """SELECT contact_id, CASE WHEN contact_id % 4 = 3 THEN NULL ELSE nullif(email, '') END AS email FROM contacts""",
)
def link_email(v: Views) -> DataFrame:
    k = F.col("contact_id") % 4
    href = F.concat(
        F.when(k == 0, "mailto:").when(k == 1, " MAILTO:").when(k == 2, "sendto:").otherwise("https://x/?m=mailto:"), "email", F.lit("?subject=a?b")
    )
    return v.contacts.select("contact_id", extract.link_email(href).alias("email"))


@query(
    "pagination_links",
    """SELECT 1000000000 + s_suppkey AS page_id, 0 AS ord, 'https://d' || s_suppkey || '.example.org/staff?page=2' AS target FROM supplier""",
)
def pagination_links(v: Views) -> DataFrame:
    return extract.pagination_links(v.site_pages)


def _records(v: Views, source: str) -> DataFrame:
    rows = v.result_contacts.filter(F.col("source") == source)
    page = F.concat(F.lit("https://s"), F.col("seq").cast("string"), F.lit(".example.org/staff"))
    return rows.select((F.col("seq") % 700).alias("school"), page.alias("page_url"), "seq", F.col("pos").cast("bigint").alias("pos"), "name", "email")


FALLBACK_SQL = """x AS (SELECT source, seq % 700 AS school, 'https://s' || seq || '.example.org/staff' AS page_url, seq, pos, name, email FROM result_contacts),
    f AS (SELECT * EXCLUDE (source) FROM x WHERE source = 'completed' UNION ALL SELECT * EXCLUDE (source) FROM x
      WHERE source = 'still_working' AND school NOT IN (SELECT school FROM x WHERE source = 'completed'))"""


@query("contacts_with_fallback", f"WITH {FALLBACK_SQL} SELECT * FROM f")
def contacts_with_fallback(v: Views) -> DataFrame:
    return extract.contacts_with_fallback(_records(v, "completed"), _records(v, "still_working"))[0]


@query("pages_with_contacts", f"WITH {FALLBACK_SQL} SELECT DISTINCT school, page_url FROM f")
def pages_with_contacts(v: Views) -> DataFrame:
    return extract.contacts_with_fallback(_records(v, "completed"), _records(v, "still_working"))[1]


@query(
    "card_contacts",
    """WITH p AS (SELECT 2000000000 + s_suppkey AS page_id, 'https://n' || s_nationkey || '.example.org' AS site, s_name, s_suppkey FROM supplier),
    c AS (SELECT site, page_id, s_name || ' Ada' AS name, 'Dean of Students' AS title, cast(NULL AS varchar) AS phone, 'a' || s_suppkey || '@d.example.org' AS email FROM p
      UNION ALL SELECT site, page_id, 'Ben ' || s_name, 'School Counselor', '(618) 555-' || lpad(cast(s_suppkey % 10000 AS varchar), 4, '0'), 'b@d.example.org' FROM p
      UNION ALL SELECT site, page_id, 'Di Lee', 'Admissions', NULL, 'd@d.example.org' FROM p
      UNION ALL SELECT site, page_id, 'Ed Poe', 'Principal', NULL, 'e@d.example.org' FROM p
      UNION ALL SELECT site, page_id, 'No Picture', 'Principal', NULL, NULL FROM p)
    SELECT site, min(page_id) AS page_id, name, title, phone, email FROM c GROUP BY site, name, title, phone, email""",
)
def card_contacts(v: Views) -> DataFrame:
    """From pages to contacts by the second extractor: cards, usual classes, text rules."""
    host = F.regexp_extract("url", "^(https?://[^/]+)", 1)
    return extract.card_contacts(extract.extract_cards(v.staff_pages), host)


@query("site_contacts", f"SELECT 'https://d' || (page_id - 1000000000) || '.example.org' AS school, page_id, name, title, phone, email FROM ({FIELDS_SQL}) f")
def site_contacts(v: Views) -> DataFrame:
    """Pages of two kinds of sites from fetch to contacts: records of the first extractor."""
    host = F.regexp_extract("url", "^(https?://[^/]+)", 1)
    records = extract.site_contacts(v.site_pages, host)[0]
    return records.filter("page_id >= 1000000000").select("school", "page_id", "name", "title", "phone", "email")


@query(
    "extract_enrollment",
    """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE cast(n_chars AS integer) END AS enrollment FROM documents""",
)
def extract_enrollment(v: Views) -> DataFrame:
    gap = F.when(F.col("doc_id") % 2 == 0, "\u00a0").otherwise(" ")
    figure = F.concat(F.lit(" Total Enrollment:"), gap, F.format_number("n_chars", 0), F.lit(" students"))
    docs = v.documents.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(F.concat("text", figure)).alias("text"))
    return extract.extract_enrollment(docs, "doc_id", "text")


@query(
    "split_outcomes",
    """SELECT s.school, count(c.pos) AS n_records, CASE WHEN count(c.pos) > 0 THEN 'completed' ELSE 'still_working' END AS outcome
      FROM (SELECT DISTINCT source || ':' || seq AS school FROM result_rows) s
      LEFT JOIN (SELECT source || ':' || seq AS school, pos FROM result_contacts) c ON s.school = c.school GROUP BY ALL""",
)
def split_outcomes(v: Views) -> DataFrame:
    site = F.concat_ws(":", "source", F.col("seq").cast("string")).alias("school")
    return extract.split_outcomes(v.result_rows.select(site).distinct(), v.result_contacts.select(site))


TEXT_BLOCKS_SQL = f"""tb AS (SELECT staff_id AS page_id, coalesce(trim(name), '') AS l1, coalesce(trim(job_name), '') AS l2, coalesce(phone, '') AS l3,
      coalesce(email, '') AS l4, CASE WHEN staff_id % 3 = 0 THEN 'Title - Dean of Students :' ELSE 'Student Services' END AS l5 FROM staff_rows),
    ft AS (SELECT page_id, list_filter([l1, l2, l3, l4, CASE WHEN l5 LIKE 'Title%' THEN '- Dean of Students' ELSE l5 END], lambda x: x <> '') AS t, l3, l4 FROM tb),
    fw AS (SELECT *, string_split(t[1], ' ') AS w FROM ft),
    fa AS (SELECT *, array_to_string(w[:2], ' ') AS name, CASE WHEN len(w) > 2 THEN list_concat([array_to_string(w[3:], ' ')], t[2:4])[:3] ELSE t[2:4] END AS nx FROM fw)"""


@query(
    "text_contact",
    f"""WITH {TEXT_BLOCKS_SQL} SELECT page_id, name, list_filter(nx, lambda x: NOT regexp_matches(x, '{PHONE_RE}') AND NOT regexp_matches(x, '{MAIL_RE}')
      AND regexp_matches(lower(x), '{_term_sql(M.TITLE_TERMS, "word")}') AND NOT regexp_matches(lower(x), '{_term_sql(M.TITLE_REJECTS, "word")}'))[1] AS title,
      nullif(l3, '') AS phone, nullif(l4, '') AS email FROM fa""",
)
def text_contact(v: Views) -> DataFrame:
    """Blocks of a line each for name, job, phone, e-mail and a title."""
    text = lambda c: F.coalesce(F.trim(c), F.lit(""))
    last = F.when(F.col("staff_id") % 3 == 0, "Title - Dean of Students :").otherwise("Student Services")
    lines = F.array(text("name"), text("job_name"), text("phone"), text("email"), last)
    return extract.text_contact(v.staff_rows.select(F.col("staff_id").alias("page_id"), lines.alias("lines")))
