"""The benchmark tables seen as outreach tables.

Each view is one SELECT that Spark and the checking engine read alike, so both sides compute
on the same input. ``{name}`` stands for a table or another view; the few constructs the two
dialects spell differently are the ``{explode:...}`` and ``{div:...}`` marks.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2001-08-01 00:00:00"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

# Fields of the contact at position ``pos`` of the result ``seq``.
RESULT_CONTACT = """
          CASE (seq + pos) % 7 WHEN 0 THEN '' WHEN 1 THEN 'Main Office ' || pos WHEN 2 THEN 'J.' || pos
               WHEN 3 THEN 'Ana Maria de la Cruz' ELSE ' Jo  Doe ' END AS name,
          CASE (seq + pos) % 4 WHEN 0 THEN NULL WHEN 1 THEN ' ' ELSE 'Dean' END AS title,
          CASE WHEN pos % 2 = 0 THEN NULL ELSE 'Dept' END AS dept,
          CASE WHEN seq % 3 = 0 THEN '' ELSE '217-555-' || lpad(cast(seq % 10000 AS string), 4, '0') END AS phone,
          CASE WHEN pos % 3 = 0 THEN '' ELSE 'Person' || seq % 50 || '@example.org' END AS email"""

# The stream table shares its name with the outreach events, which read from `part`.
VIEWS: dict[str, str] = {
    "school_rows": """
        SELECT c.c_custkey AS school_id, cast(c.c_custkey AS string) AS facility_key,
          CASE WHEN c.c_custkey % 10 = 0 THEN c.c_name || ' Academy' ELSE c.c_name END AS name,
          CASE WHEN c.c_custkey % 5 = 0 THEN NULL ELSE c.c_nationkey END AS district_id,
          CASE WHEN c.c_custkey % 47 = 0 THEN NULL WHEN c.c_custkey % 53 = 0 THEN '  '
               WHEN n.n_nationkey % 3 = 0 THEN n.n_name || ' Region' ELSE n.n_name END AS county_name,
          CASE WHEN c.c_custkey % 7 = 0 THEN NULL ELSE c.c_custkey || ' Main St' END AS address,
          CASE WHEN c.c_custkey % 11 = 0 THEN NULL ELSE 'City ' || c.c_custkey % 40 END AS city,
          CASE WHEN c.c_custkey % 19 = 0 THEN '12' ELSE lpad(cast(c.c_custkey % 100000 AS string), 5, '0') END AS zipcode,
          CASE c.c_mktsegment WHEN 'HOUSEHOLD' THEN 'Middle School' WHEN 'MACHINERY' THEN 'JUNIOR HIGH'
               WHEN 'FURNITURE' THEN NULL ELSE c.c_mktsegment END AS type_of_school,
          CASE WHEN c.c_custkey % 13 = 0 THEN NULL ELSE c.c_acctbal >= 500 END AS is_active,
          CASE WHEN c.c_custkey % 17 = 0 THEN NULL ELSE c.c_acctbal >= 4500 END AS is_verified,
          CASE c.c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'imported' ELSE 'scraped' END AS data_source,
          CASE WHEN c.c_custkey % 4 = 0 THEN NULL WHEN c.c_acctbal > 8000 THEN 'high' ELSE 'low' END AS priority_tier,
          CASE WHEN c.c_custkey % 17 = 0 THEN NULL ELSE cast('2001-01-01 00:00:00' AS timestamp) END AS last_verified_at
        FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey""",
    "schools": """
        SELECT school_id, name, cast(district_id AS string) AS district, coalesce(county_name, '') AS county,
          coalesce(address, '') AS address, coalesce(city, '') AS city, 'IL' AS state, coalesce(zipcode, '') AS zip_code,
          CASE WHEN lower(type_of_school) LIKE '%middle%' OR lower(type_of_school) LIKE '%junior%'
               THEN 'middle_school' ELSE 'high_school' END AS school_type,
          coalesce(is_active, true) AS is_active, coalesce(is_verified, false) AS is_verified,
          coalesce(data_source, 'manual') AS data_source, coalesce(priority_tier, 'standard') AS priority_tier
        FROM {school_rows}""",
    "contacts": """
        SELECT o_orderkey AS contact_id, o_custkey AS school_id, 'First' || o_orderkey % 500 AS first_name,
          CASE WHEN o_orderkey % 29 = 0 THEN '' ELSE 'Last' || o_orderkey % 700 END AS last_name,
          CASE WHEN o_orderkey % 31 = 0 THEN '' WHEN o_orderkey % 37 = 0 THEN 'broken mail'
               ELSE 'c' || o_orderkey || '@k12.example.org' END AS email,
          CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE '217-555-' || lpad(cast(o_orderkey % 10000 AS string), 4, '0') END AS phone,
          CASE o_orderkey % 7 WHEN 0 THEN 'superintendent' WHEN 1 THEN 'principal' WHEN 2 THEN 'counselor'
               WHEN 3 THEN 'cs_teacher' WHEN 4 THEN 'engineering_teacher' WHEN 5 THEN 'math_teacher'
               ELSE 'science_teacher' END AS role,
          o_orderstatus <> 'F' AS is_active, o_totalprice >= 100000 AS is_verified
        FROM {orders} WHERE o_orderpriority = '2-HIGH'""",
    "activities": """
        SELECT o_orderkey AS activity_id, o_custkey AS school_id,
          CASE o_orderkey % 4 WHEN 0 THEN 'phone_call' WHEN 1 THEN 'site_visit' WHEN 2 THEN 'email'
               ELSE 'campus tour' END AS activity_type,
          o_orderdate AS date, 'Order ' || o_orderkey AS description
        FROM {orders} WHERE o_orderpriority = '5-LOW'""",
    "program_rows": """
        SELECT o_orderkey AS program_id, o_custkey AS school_id, 'Program ' || o_orderkey AS name,
          CASE o_orderkey % 8 WHEN 0 THEN 'cs' WHEN 1 THEN 'engineering' WHEN 2 THEN 'robotics' WHEN 3 THEN 'stem_club'
               WHEN 4 THEN 'math_club' WHEN 5 THEN 'science_club' WHEN 6 THEN 'other' ELSE 'unlisted' END AS category,
          CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE o_orderstatus <> 'F' END AS is_active
        FROM {orders} WHERE o_orderpriority = '1-URGENT'""",
    "programs": """
        SELECT program_id, school_id, name, category, coalesce(is_active, true) AS is_active FROM {program_rows}""",
    "participation": """
        SELECT l.l_partkey AS event_id, o.o_custkey AS school_id
        FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey
        WHERE l.l_returnflag = 'R'""",
    "event_rows": """
        SELECT p_partkey AS event_id,
          CASE WHEN p_partkey % 9 = 0 THEN NULL
               WHEN p_partkey % 10 = 0 THEN p_size || ', ,' || p_size
               ELSE p_partkey || ' ,' || (p_partkey + 7) || ',' || p_size END AS schools_involved,
          CASE WHEN p_partkey % 14 = 0 THEN NULL ELSE p_brand END AS location,
          CASE WHEN p_partkey % 21 = 0 THEN NULL
               ELSE cast('1999-01-01 09:30:00' AS timestamp) + (p_partkey * 13 % 1100) * interval '1' day END AS date,
          CASE WHEN p_size % 9 = 0 THEN NULL ELSE p_size END AS attendance,
          CASE WHEN p_partkey % 15 = 0 THEN NULL ELSE p_size % 2 = 0 END AS is_scraped,
          CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_name END AS fair_name, p_type
        FROM {part}""",
    "outreach_events": """
        SELECT event_id, coalesce(fair_name, location, 'Untitled Event') AS name,
          CASE event_id % 6 WHEN 0 THEN 'outreach_fair' WHEN 1 THEN 'campus_visit' WHEN 2 THEN 'recruitment_event'
               WHEN 3 THEN 'summer_camp' WHEN 4 THEN 'workshop' ELSE 'other' END AS type,
          coalesce(date, cast('2001-08-01 00:00:00' AS timestamp)) AS date, coalesce(location, '') AS location,
          cast(attendance AS bigint) AS attendees
        FROM {event_rows}""",
    "staff_rows": """
        SELECT p_partkey AS staff_id,
          CASE WHEN p_partkey % 41 = 0 THEN NULL WHEN p_partkey % 43 = 0 THEN '   '
               WHEN p_partkey % 4 = 0 THEN '  ' || p_name || ' ' || p_brand ELSE p_name END AS name,
          CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE '618-555-' || lpad(cast(p_partkey % 10000 AS string), 4, '0') END AS phone,
          CASE WHEN p_partkey % 8 = 0 THEN NULL ELSE 'Staff' || p_partkey || '@K12.example.org' END AS email,
          CASE p_size % 12 WHEN 0 THEN 'District Superintendent' WHEN 1 THEN 'Vice Principal' WHEN 2 THEN 'Guidance Office'
               WHEN 3 THEN 'Computer Science' WHEN 4 THEN 'computing teacher' WHEN 5 THEN 'Engineering Lead'
               WHEN 6 THEN 'Mathematics' WHEN 7 THEN ' Science ' WHEN 8 THEN 'cs_teacher' WHEN 9 THEN NULL
               WHEN 10 THEN 'Supt' ELSE 'Librarian' END AS job_name,
          CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE cast(p_partkey % 1000 AS string) END AS school_worked_at,
          CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_size > 5 END AS is_active,
          CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'imported' END AS data_source,
          CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_size > 25 END AS is_verified,
          CASE WHEN p_size > 25 THEN cast('2001-01-01 00:00:00' AS timestamp) ELSE NULL END AS last_verified_at
        FROM {part}""",
    "junction_rows": """
        SELECT cast(l_suppkey AS string) AS school_id, l_partkey AS staff_id, l_orderkey AS seq
        FROM {lineitem} WHERE l_returnflag = 'A' AND l_linenumber = 1""",
    "facility_list": """
        SELECT c.c_custkey AS seq,
          CASE WHEN c.c_custkey % 31 = 0 THEN '  own|KEY ' || c.c_custkey ELSE NULL END AS FacilityKey,
          CASE WHEN c.c_custkey % 8 = 0 THEN '  ' ELSE n.n_name || ' dekalb o''brien' END AS County,
          CASE WHEN c.c_custkey % 12 = 0 THEN NULL WHEN c.c_custkey % 3 = 0 THEN '  St.  ' || c.c_mktsegment || ' & Sons SCH, IL '
               ELSE 'Lincoln  ' || c.c_mktsegment || ' Jr High ' || c.c_custkey % 200 END AS FacilityName,
          CASE WHEN c.c_custkey % 14 = 0 THEN '' ELSE ' City  ' || c.c_custkey % 40 END AS City,
          CASE WHEN c.c_custkey % 9 = 0 THEN NULL ELSE '6' || lpad(cast(c.c_custkey % 300 AS string), 4, '0') END AS Zip,
          CASE WHEN c.c_custkey % 10 = 0 THEN ' ' ELSE '217-' || c.c_custkey END AS Telephone,
          'Admin ' || c.c_custkey % 77 AS Administrator,
          CASE c.c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'http://www' || c.c_custkey % 1000 || '.example.org/' || c.c_mktsegment
               WHEN 2 THEN 'https://s' || c.c_custkey % 100 || '.example.org' ELSE ' http://h' || c.c_custkey % 10000 || '.example.org ' END AS Website,
          CASE c.c_custkey % 5 WHEN 0 THEN '(Pending)' WHEN 1 THEN NULL ELSE '17' || c.c_custkey END AS NCES_ID
        FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey""",
    "facility_sheet": """
        SELECT c.c_custkey AS seq, n.n_name AS CountyName,
          CASE c.c_custkey % 3 WHEN 0 THEN 'high SCH dist' WHEN 1 THEN 'school' ELSE 'Sch' END AS SearchToken,
          c.c_name AS FacilityName, CASE WHEN c.c_custkey % 11 = 0 THEN NULL ELSE 'City ' || c.c_custkey % 40 END AS City,
          lpad(cast(c.c_custkey % 100000 AS string), 5, '0') AS Zip,
          CASE c.c_custkey % 5 WHEN 0 THEN '9-12' WHEN 1 THEN 'K-8' WHEN 2 THEN '112' WHEN 3 THEN '12' ELSE NULL END AS GradesServed,
          CASE c.c_custkey % 4 WHEN 0 THEN '12' WHEN 1 THEN '5d' WHEN 2 THEN '7.0' ELSE NULL END AS StRep
        FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey""",
    "result_rows": """
        SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN 'still_working' ELSE 'completed' END AS source, c_custkey AS seq,
          CASE WHEN c_custkey % 4 = 0 THEN upper(c_name) ELSE c_name END AS school_name,
          CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE 'https://s' || c_custkey || '.example.org' END AS base_url,
          CASE WHEN c_custkey % 4 = 1 THEN 'https://alt' || c_custkey || '.example.org' ELSE NULL END AS alt_url,
          CASE WHEN c_custkey % 5 < 2 THEN '' ELSE '/staff,/faculty' END AS pages_csv,
          CASE WHEN c_mktsegment = 'BUILDING' THEN 0 ELSE c_custkey % 5 END AS n_contacts,
          CASE WHEN c_custkey % 13 = 0 THEN 'missing website' WHEN c_custkey % 29 = 0 THEN 'timeout' ELSE NULL END AS error
        FROM {customer}
        UNION ALL
        SELECT 'still_working' AS source, c_custkey AS seq, c_name AS school_name, NULL AS base_url,
          'https://old' || c_custkey || '.example.org' AS alt_url, '/old' AS pages_csv, 1 AS n_contacts, NULL AS error
        FROM {customer} WHERE c_mktsegment = 'MACHINERY'""",
    "result_contacts": f"""
        SELECT source, school_name, seq, pos, {RESULT_CONTACT}
        FROM (SELECT r.*, {{explode:r.n_contacts:pos}} FROM {{result_rows}} r WHERE n_contacts > 0) x""",
    "rule_rows": """
        SELECT c_custkey AS seq, CASE WHEN c_custkey % 6 = 0 THEN lower(c_name) ELSE c_name END AS school,
          CASE WHEN c_custkey % 8 = 0 THEN '' WHEN c_custkey % 8 = 1 THEN ' https://a.example.org , ,https://a.example.org'
               ELSE 'https://r' || c_custkey || '.example.org,https://b.example.org' END AS urls_csv
        FROM {customer}""",
    "directory_rows": """
        SELECT c_custkey AS seq, c_custkey AS school_id, c_name || ' ' || c_mktsegment || ' HS' AS school_name,
          c_acctbal >= 2000 AS is_high_school, 'https://c' || c_custkey || '.example.org' AS website,
          CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE '773-' || c_custkey END AS phone,
          CASE WHEN c_custkey % 4 = 0 THEN '  ' ELSE 'Admin ' || c_custkey % 90 END AS administrator_name,
          'Principal' AS administrator_title,
          CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'Second ' || c_custkey % 80 END AS second_name,
          CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE 'Assistant' END AS second_title
        FROM {customer}""",
    "import_contacts_raw": """
        SELECT o_orderkey AS "row", ' Ann' || o_orderkey % 50 AS "First Name",
          CASE WHEN o_orderkey % 9 = 0 THEN ' ' ELSE 'Lee ' END AS last_name,
          CASE o_orderkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'no at sign' WHEN 2 THEN 'C' || o_orderkey || '@K12.example.org'
               ELSE 'new' || o_orderkey % 3000 || '@example.org' END AS "Email Address",
          'Math Teacher ' AS "Title",
          CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'customer#' || lpad(cast(o_custkey AS string), 9, '0')
               WHEN 2 THEN 'Nowhere' ELSE 'Customer#' || lpad(cast(o_custkey AS string), 9, '0') END AS "School",
          'x' AS "Shoe Size"
        FROM {orders} WHERE o_orderpriority IN ('2-HIGH', '3-MEDIUM')""",
    "import_contacts": """
        SELECT "row", trim("First Name") AS "firstName", trim(last_name) AS "lastName", trim("Email Address") AS email,
          trim("Title") AS role, trim("School") AS "schoolId"
        FROM {import_contacts_raw}""",
    "import_schools": """
        SELECT s_suppkey AS seq, CASE WHEN s_suppkey % 7 = 0 THEN '' WHEN s_suppkey % 3 = 0 THEN 'New ' || s_suppkey % 40
            ELSE 'CUSTOMER#' || lpad(cast(s_suppkey % 60 AS string), 9, '0') END AS name,
          CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE 'County ' || s_nationkey END AS county, 'Addr ' || s_suppkey AS address,
          'Town' AS city, '62000' AS zip_code, CASE WHEN s_suppkey % 2 = 0 THEN 'middle_school' ELSE 'high_school' END AS school_type
        FROM {supplier}""",
    "action_log": """
        SELECT e.event_id AS seq, CASE e.event_type WHEN 'click' THEN 'UPDATE' WHEN 'view' THEN 'ADD' WHEN 'error' THEN 'DELETE'
            WHEN 'purchase' THEN 'VERIFY' ELSE 'UPDATE' END AS op,
          e.user_id AS school_id, 'Name ' || e.event_id AS name, e.event_type AS county, e.value > 50 AS is_verified, e.ts AS "at"
        FROM {events} e""",
    "action_base": """
        SELECT c_custkey AS school_id, c_name AS name, 'base' AS county, false AS is_verified,
          cast(NULL AS timestamp) AS last_verified_at
        FROM {customer} WHERE c_custkey % 3 <> 0""",
    "stream_activities": """
        SELECT event_id AS activity_id, user_id AS school_id, event_type AS activity_type, ts AS date FROM {events}""",
    "staff_pages": """
        SELECT 2000000000 + s_suppkey AS page_id, 'https://n' || s_nationkey || '.example.org/staff' AS url,
          '<html><body><div class="menu">Staff</div>'
          || '<div class="a card"><img src="1"><h3>' || s_name || ' Ada Jones</h3><p>Dean of Students</p><a href="mailto:a' || s_suppkey || '@d.example.org">Email</a></div>'
          || '<div class="card a"><img src="2"><h3>Ben ' || s_name || '</h3><p>School Counselor</p><p>(618) 555-' || lpad(cast(s_suppkey % 10000 AS string), 4, '0') || '</p><p>b@d.example.org</p></div>'
          || '<div class="a card"><img src="3"><h3>Cy Fox</h3><p>Assistant Principal</p><a onclick="message(1)">write</a></div>'
          || '<div class="a card"><img src="4"><h3>Di Lee</h3><p>Admissions</p><a href="mailto:d@d.example.org">write</a></div>'
          || '<div class="b"><img src="5"><h3>Ed Poe</h3><p>Principal</p><a href="mailto:e@d.example.org">write</a></div>'
          || '<div class="a card"><h3>No Picture</h3><p>Principal</p></div></body></html>' AS html
        FROM {supplier}""",
    "site_pages": """
        SELECT page_id, url, html FROM {pages} UNION ALL SELECT page_id, url, html FROM {card_pages}""",
    "card_pages": """
        SELECT 1000000000 + s_suppkey AS page_id, 'https://d' || s_suppkey || '.example.org/staff' AS url,
          '<html><body><div class="list"><div class="card"><p>' || s_name || ' JONES</p><p>'
          || CASE s_suppkey % 4 WHEN 0 THEN 'Dean Of Students' WHEN 1 THEN 'school counselor' WHEN 2 THEN 'Assistant Principal'
                  ELSE 'Admissions' END
          || '</p><p>Room ' || s_nationkey || '</p><p>(618)' || CASE WHEN s_suppkey % 3 = 0 THEN '&nbsp;' ELSE ' ' END || '555-' || lpad(cast(s_suppkey % 10000 AS string), 4, '0')
          || '</p><a href="mailto:S' || s_suppkey || '@D.example.org?subject=hi">Send Email</a></div>'
          || '<div class="card"><p>Pat Plain</p><p>Principal</p><p>p' || s_suppkey || '@x.example.org</p></div></div>'
          || '<nav class="pagination"><a href="?page=2">2</a><a href="#top">next</a></nav></body></html>' AS html
        FROM {supplier}""",
}

_MARK = re.compile(r"\{(?:(explode):([^:}]+):(\w+)|(\w+))\}")


def _columns_for_spark(sql: str) -> str:
    """Double-quoted identifiers as Spark writes them (texts in the views hold none)."""
    head, sep, tail = sql.partition("<html>")
    head = re.sub(r'"([^"]+)"', r"`\1`", head).replace("AS timestamp)", "AS timestamp_ntz)")
    return head + sep + tail


def checking_sql(name: str) -> str:
    """The view for the checking engine, in terms of tables and other views."""

    def put(m: re.Match) -> str:
        if m.group(1):
            return f"unnest(range(1, {m.group(2)} + 1)) AS {m.group(3)}"
        return m.group(4)

    return _MARK.sub(put, VIEWS[name])


def needed_views(body: str) -> list[str]:
    """Views a query text names, each after the ones it reads itself."""
    out: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in out and re.search(rf"\b{name}\b", text):
                visit(checking_sql(name))
                if name not in out:
                    out.append(name)

    visit(body)
    return out


def with_views(body: str) -> str:
    """A query text preceded by the views it names."""
    body = body.strip()
    views = needed_views(body)
    parts = [f"{v} AS ({checking_sql(v)})" for v in views]
    if body.upper().startswith("WITH "):
        body = body[5:]
        return "WITH " + ",\n".join([*parts, body])
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


class Views:
    """DataFrames of one data folder, by table or view name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}

    def with_table(self, name: str, rows: DataFrame) -> Views:
        """The same views over other rows of one table."""
        other = Views(self.spark, self.sf_dir)
        other._made[f"table:{name}"] = rows
        return other

    def table(self, name: str) -> DataFrame:
        key = f"table:{name}"
        if key not in self._made:
            self._made[key] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._made[key]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in VIEWS:
            if name in TABLES:
                return self.table(name)
            raise AttributeError(name)
        if name not in self._made:
            self._made[name] = self._view(name)
        return self._made[name]

    def _view(self, name: str) -> DataFrame:
        used: dict[str, DataFrame] = {}

        def put(m: re.Match) -> str:
            if m.group(1):
                return f"explode(sequence(1, {m.group(2)})) AS {m.group(3)}"
            source = m.group(4)
            used[source] = self.table(source) if source in TABLES else getattr(self, source)
            return "{" + source + "}"

        return self.spark.sql(_columns_for_spark(_MARK.sub(put, VIEWS[name])), **used)


@lru_cache(maxsize=8)
def views(spark: SparkSession, sf_dir: str) -> Views:
    return Views(spark, sf_dir)
