"""Queries over metrics, rankings and follow-up lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvasser import schema as M
from canvasser.operators import catalog, extract, metrics
from canvasser.plans.bindings import AS_OF, Views
from canvasser.plans.load import COMBINED_SQL, results
from canvasser.plans.registry import query
from canvasser.plans.lookup import COUNTY, COUNTY_SUMMARY_SQL, HAS_COUNTY

SIX = "timestamp '2001-02-01 00:00:00'"
FACTS_SQL = """a AS (SELECT school_id, count(*) AS activities, max(date) AS latest FROM activities GROUP BY 1),
    c AS (SELECT school_id, count(*) AS total_contacts, count(*) FILTER (is_active) AS active_contacts FROM contacts GROUP BY 1),
    p AS (SELECT school_id, count(*) AS appearances FROM participation GROUP BY 1),
    facts AS (SELECT s.school_id, s.name, s.county, coalesce(activities, 0) AS activities, latest, coalesce(total_contacts, 0) AS total_contacts,
      coalesce(active_contacts, 0) AS active_contacts, coalesce(appearances, 0) AS appearances
      FROM schools s LEFT JOIN a USING (school_id) LEFT JOIN c USING (school_id) LEFT JOIN p USING (school_id))"""


def pct_sql(a: str, b: str) -> str:
    return f"CASE WHEN {b} = 0 THEN 0 ELSE cast(floor(100.0::double * {a} / {b} + 0.5) AS bigint) END"


@query(
    "contacts_per_school",
    "SELECT school_id, count(*) AS total_contacts, count(*) FILTER (is_active) AS active_contacts FROM contacts GROUP BY 1",
)
def contacts_per_school(v: Views) -> DataFrame:
    return metrics.contacts_per_school(v.contacts)


@query("activities_per_school", "SELECT school_id, count(*) AS activities, max(date) AS latest FROM activities GROUP BY 1")
def activities_per_school(v: Views) -> DataFrame:
    return metrics.activities_per_school(v.activities)


@query("event_appearances_per_school", "SELECT school_id, count(*) AS appearances FROM participation GROUP BY 1")
def event_appearances_per_school(v: Views) -> DataFrame:
    return metrics.event_appearances_per_school(v.participation)


@query(
    "summary_metrics",
    f"""WITH {FACTS_SQL} SELECT (SELECT count(*) FROM facts) AS total_schools,
      (SELECT count(*) FROM facts WHERE activities > 0) AS engaged_schools,
      (SELECT count(*) FROM facts WHERE latest IS NULL OR latest <= {SIX}) AS needing_attention,
      (SELECT count(*) FROM contacts WHERE is_active) AS active_contacts, (SELECT count(*) FROM outreach_events) AS total_events,
      (SELECT cast(sum(attendees) AS bigint) FROM outreach_events) AS total_attendees""",
)
def summary_metrics(v: Views) -> DataFrame:
    return metrics.summary_metrics(v.schools, v.contacts, v.outreach_events, v.activities, AS_OF)


@query(
    "engagement_funnel",
    f"""WITH {FACTS_SQL}, n AS (SELECT count(*) AS t, count(*) FILTER (total_contacts > 0) AS wc, count(*) FILTER (latest > {SIX}) AS ra,
      count(*) FILTER (appearances > 0) AS ev FROM facts)
    SELECT 0 AS ord, 'Total Schools' AS stage, t AS schools, 'baseline' AS share FROM n
    UNION ALL SELECT 1, 'With Contacts', wc, {pct_sql('wc', 't')} || '%' FROM n
    UNION ALL SELECT 2, 'Active (6 mo)', ra, {pct_sql('ra', 't')} || '%' FROM n
    UNION ALL SELECT 3, 'At Events', ev, {pct_sql('ev', 't')} || '%' FROM n""",
)
def engagement_funnel(v: Views) -> DataFrame:
    return metrics.engagement_funnel(v.schools, v.contacts, v.activities, v.participation, AS_OF)


@query(
    "top_engaged_schools",
    f"""WITH {FACTS_SQL} SELECT school_id, name, CASE WHEN length(name) > 22 THEN substr(name, 1, 20) || '…' ELSE name END AS label,
      3 * activities + 2 * active_contacts + 4 * appearances AS score, activities, active_contacts, appearances FROM facts
      WHERE 3 * activities + 2 * active_contacts + 4 * appearances > 0 ORDER BY score DESC, name, school_id LIMIT 10""",
)
def top_engaged_schools(v: Views) -> DataFrame:
    return metrics.top_engaged_schools(v.schools, v.contacts, v.activities, v.participation)


@query(
    "counties_at_risk",
    f"""WITH {FACTS_SQL}, g AS (SELECT county, count(*) AS total, count(*) FILTER (total_contacts > 0) AS with_contacts FROM facts
      WHERE {HAS_COUNTY} GROUP BY 1)
    SELECT *, total - with_contacts AS gap, with_contacts::double / total AS rate FROM g WHERE total >= 2 AND total > with_contacts
    ORDER BY gap DESC, county LIMIT 8""",
)
def counties_at_risk(v: Views) -> DataFrame:
    return metrics.counties_at_risk(v.schools, v.contacts)


EVENT_LABEL_SQL = "CASE type " + " ".join(f"WHEN '{k}' THEN '{x}'" for k, x in M.EVENT_LABELS.items()) + " END"


@query(
    "event_type_distribution",
    f"""SELECT type, count(*) AS events, cast(coalesce(sum(attendees), 0) AS bigint) AS attendees, {EVENT_LABEL_SQL} AS label
      FROM outreach_events GROUP BY type""",
)
def event_type_distribution(v: Views) -> DataFrame:
    return metrics.event_type_distribution(v.outreach_events)


def _ranking_sql(reached: str, label: str) -> str:
    return f"""WITH g AS (SELECT county, count(*) AS total, count(*) FILTER (school_id IN (SELECT school_id FROM {reached})) AS engaged
      FROM schools WHERE {HAS_COUNTY} GROUP BY 1)
    SELECT *, engaged::double / total AS rate, {pct_sql('engaged', 'total')} AS pct, '{label}' AS label FROM g WHERE total >= 2
    ORDER BY rate, county LIMIT 14"""


@query("county_engagement_rate_ranking", _ranking_sql("participation", "at event"))
def county_engagement_rate_ranking(v: Views) -> DataFrame:
    return metrics.county_engagement_rate_ranking(v.schools, v.participation, "event")


@query("county_contact_rate_ranking", _ranking_sql("contacts", "with contacts"))
def county_contact_rate_ranking(v: Views) -> DataFrame:
    return metrics.county_engagement_rate_ranking(v.schools, v.contacts, "contact")


@query(
    "county_comparison",
    f"""SELECT county, count(*) AS total, count(*) FILTER (school_id IN (SELECT school_id FROM participation)) AS engaged,
      CASE WHEN length(county) > 12 THEN substr(county, 1, 10) || '…' ELSE county END AS label
      FROM schools WHERE {HAS_COUNTY} GROUP BY county ORDER BY total DESC, county LIMIT 12""",
)
def county_comparison(v: Views) -> DataFrame:
    return metrics.county_comparison(v.schools, v.participation)


CATEGORY_COUNTS = ", ".join(f"count(*) FILTER (category = '{c}') AS {c}" for c in M.PROGRAM_CATEGORIES)
KNOWN = ", ".join(f"'{c}'" for c in M.PROGRAM_CATEGORIES)


@query(
    "program_coverage_by_county",
    f"""SELECT county, {CATEGORY_COUNTS}, count(*) FILTER (category IN ({KNOWN})) AS total,
      CASE WHEN length(county) > 12 THEN substr(county, 1, 10) || '…' ELSE county END AS label
      FROM programs JOIN schools USING (school_id) WHERE {HAS_COUNTY} GROUP BY county ORDER BY total DESC, county LIMIT 10""",
)
def program_coverage_by_county(v: Views) -> DataFrame:
    return metrics.program_coverage_by_county(v.programs, v.schools)


@query(
    "dashboard_metrics",
    f"""SELECT (SELECT count(*) FROM schools WHERE is_active) AS active_schools, (SELECT count(*) FROM contacts WHERE is_active) AS active_contacts,
      (SELECT count(*) FROM outreach_events WHERE date > timestamp '{AS_OF}') AS upcoming_events,
      (SELECT count(*) FROM activities WHERE date > timestamp '2000-08-01') AS recent_activities""",
)
def dashboard_metrics(v: Views) -> DataFrame:
    return metrics.dashboard_metrics(v.schools, v.contacts, v.outreach_events, v.activities, AS_OF)


@query(
    "dashboard_overview",
    f"""WITH {FACTS_SQL} SELECT count(*) AS total_schools, count(*) FILTER (total_contacts > 0) AS with_contacts,
      count(*) FILTER (latest > {SIX}) AS with_recent_activity, round((SELECT count(*) FROM contacts)::double / count(*), 1) AS avg_contacts FROM facts""",
)
def dashboard_overview(v: Views) -> DataFrame:
    return metrics.dashboard_overview(v.schools, v.contacts, v.activities, AS_OF)


@query("county_school_summary", f"WITH {COUNTY_SUMMARY_SQL} SELECT * FROM summary")
def county_school_summary(v: Views) -> DataFrame:
    return metrics.county_school_summary(v.schools, v.contacts, v.participation, v.programs)


@query("county_engagement_rate", f"WITH {COUNTY_SUMMARY_SQL} SELECT * FROM rate")
def county_engagement_rate(v: Views) -> DataFrame:
    return metrics.county_engagement_rate(v.schools, v.participation)


@query(
    "school_engagement_summary",
    f"""WITH {FACTS_SQL}, e AS (SELECT school_id, count(DISTINCT event_id) AS n, max(date) AS d FROM participation
      LEFT JOIN outreach_events USING (event_id) GROUP BY 1)
    SELECT school_id, name, county, total_contacts AS contact_count, coalesce(e.n, 0) AS event_count, e.d AS last_event_date
    FROM facts LEFT JOIN e USING (school_id)""",
)
def school_engagement_summary(v: Views) -> DataFrame:
    return metrics.school_engagement_summary(v.schools, v.contacts, v.participation, v.outreach_events)


PROGRAM_LABEL_SQL = "CASE category " + " ".join(f"WHEN '{k}' THEN '{x}'" for k, x in M.PROGRAM_LABELS.items()) + " END"


@query(
    "county_program_coverage",
    f"""SELECT category, count(*) AS programs, {PROGRAM_LABEL_SQL} AS label FROM programs
      WHERE is_active AND category IN ({KNOWN}) AND school_id IN (SELECT school_id FROM schools WHERE county = '{COUNTY}') GROUP BY category""",
)
def county_program_coverage(v: Views) -> DataFrame:
    return metrics.county_program_coverage(v.programs, v.schools, COUNTY)


SCORE_SQL = f"""ca AS (SELECT school_id, count(*) FILTER (is_active) AS n FROM contacts GROUP BY 1),
    aa AS (SELECT school_id, count(*) FILTER (date > {SIX}) AS n, max(date) AS latest FROM activities GROUP BY 1),
    ea AS (SELECT school_id, count(DISTINCT event_id) AS n FROM participation GROUP BY 1),
    pa AS (SELECT school_id, count(*) FILTER (is_active) AS n FROM programs GROUP BY 1),
    sx AS (SELECT s.school_id, s.name, s.county, coalesce(ca.n, 0) AS active_contacts, coalesce(aa.n, 0) AS recent_activities,
      coalesce(ea.n, 0) AS events, coalesce(pa.n, 0) AS active_programs, latest FROM schools s LEFT JOIN ca USING (school_id)
      LEFT JOIN aa USING (school_id) LEFT JOIN ea USING (school_id) LEFT JOIN pa USING (school_id)),
    sc AS (SELECT *, cast(least(active_contacts, 3) * 10 + least(recent_activities, 3) * 10 + least(events, 2) * 10
      + least(active_programs, 2) * 10 AS bigint) AS score, date_diff('day', latest, timestamp '{AS_OF}') AS days FROM sx),
    sr AS (SELECT *, list_filter([
      CASE WHEN active_contacts = 0 THEN 'No active contacts — reach out to establish a school liaison.'
        WHEN active_contacts = 1 THEN 'Only 1 active contact — consider building a broader relationship at this school.' END,
      CASE WHEN recent_activities = 0 AND latest IS NULL THEN 'No activity logged yet — schedule an initial outreach visit or call.'
        WHEN recent_activities = 0 THEN 'No activity in the last 6 months — last contact was ' || days
          || CASE WHEN days = 1 THEN ' day ago.' ELSE ' days ago.' END END,
      CASE WHEN events = 0 THEN 'This school has never appeared at an event — invite them to an upcoming fair or campus visit.' END,
      CASE WHEN active_programs = 0 THEN 'No STEM programs recorded — survey the school to identify CS, engineering, or robotics offerings.' END],
      lambda x: x IS NOT NULL) AS r FROM sc),
    scored AS (SELECT school_id, name, county, active_contacts, recent_activities, events, active_programs, score,
      CASE WHEN score >= 60 THEN 'high' WHEN score >= 30 THEN 'medium' ELSE 'low' END AS tier,
      CASE WHEN len(r) > 0 THEN array_to_string(r, ' | ')
        ELSE 'Strong engagement — maintain regular contact and continue inviting this school to events.' END AS recommendations FROM sr)"""


def scored_schools(v: Views) -> DataFrame:
    return metrics.engagement_score(v.schools, v.contacts, v.activities, v.participation, v.programs, AS_OF)


@query("engagement_score", f"WITH {SCORE_SQL} SELECT * FROM scored")
def engagement_score(v: Views) -> DataFrame:
    return scored_schools(v).withColumn("recommendations", F.array_join("recommendations", " | "))


@query(
    "programs_by_category",
    f"""SELECT cast(list_position([{KNOWN}], category) AS bigint) AS category_ord, category, program_id, name, is_active FROM programs
      WHERE category IN ({KNOWN}) AND school_id = (SELECT min(school_id) FROM programs WHERE category <> 'unlisted')""",
)
def programs_by_category(v: Views) -> DataFrame:
    first = v.programs.filter("category <> 'unlisted'").agg(F.min("school_id")).scalar()
    return metrics.programs_by_category(v.programs, first)


@query(
    "scrape_coverage",
    f"""WITH {COMBINED_SQL} SELECT count(*) AS total, count(*) FILTER (error = 'missing website') AS missing_website,
      count(*) FILTER (coalesce(error, '') <> 'missing website' AND n_contacts = 0) AS no_contacts,
      count(*) FILTER (coalesce(error, '') <> 'missing website' AND n_contacts > 0) AS with_contacts FROM combined""",
)
def scrape_coverage(v: Views) -> DataFrame:
    return catalog.scrape_coverage(catalog.combine_results(results(v, "still_working"), results(v, "completed")))


@query("missing_county_count", f"SELECT count(*) FILTER (NOT ({HAS_COUNTY})) AS missing_county FROM schools")
def missing_county_count(v: Views) -> DataFrame:
    return metrics.missing_county_count(v.schools)


FOLLOWUP_SQL = f"""{FACTS_SQL}, rc AS (SELECT DISTINCT school_id FROM participation JOIN outreach_events USING (event_id)
      WHERE date_trunc('day', date) > timestamp '2001-05-01'),
    fu AS (SELECT school_id, name, county, latest, active_contacts, school_id IN (SELECT school_id FROM rc) AS recent,
      date_diff('day', latest, timestamp '{AS_OF}') AS days FROM facts),
    fr AS (SELECT school_id, name, county, CASE WHEN recent AND latest IS NULL THEN 'Attended recent event — no follow-up'
        WHEN active_contacts > 0 AND latest IS NULL THEN 'Has contacts — no activity logged yet'
        WHEN active_contacts > 0 AND latest <= timestamp '2001-07-01' THEN days || 'd since last activity' END AS reason,
      CASE WHEN recent AND latest IS NULL THEN 9999 WHEN active_contacts > 0 AND latest IS NULL THEN 8888 ELSE days END AS urgency FROM fu),
    fl AS (SELECT * FROM fr WHERE reason IS NOT NULL ORDER BY urgency DESC, name, school_id LIMIT 10)"""


def followups(v: Views) -> DataFrame:
    return metrics.upcoming_followups(v.schools, v.contacts, v.outreach_events, v.activities, v.participation, AS_OF)


@query("upcoming_followups", f"WITH {FOLLOWUP_SQL} SELECT * FROM fl")
def upcoming_followups(v: Views) -> DataFrame:
    return followups(v)


@query("followup_candidates", f"WITH {FOLLOWUP_SQL} SELECT * FROM fr WHERE reason IS NOT NULL")
def followup_candidates(v: Views) -> DataFrame:
    return metrics.followup_candidates(v.schools, v.contacts, v.outreach_events, v.activities, v.participation, AS_OF)


@query("single_reason", f"WITH {FOLLOWUP_SQL} SELECT count(*) > 0 AND count(DISTINCT reason) = 1 AS single_reason FROM fl")
def single_reason(v: Views) -> DataFrame:
    return metrics.single_reason(followups(v))


ATTENTION_SQL = f"""{FACTS_SQL}, g AS (SELECT *, list_filter([CASE WHEN total_contacts = 0 THEN 'No contacts'
      WHEN active_contacts = 0 THEN 'No active contacts' END, CASE WHEN latest IS NULL THEN 'No activity recorded'
      WHEN latest <= {SIX} THEN 'No activity in 6+ months' END], lambda x: x IS NOT NULL) AS i FROM facts)"""


@query(
    "schools_needing_attention",
    f"""WITH {ATTENTION_SQL} SELECT school_id, name, county, total_contacts, coalesce(strftime(latest, '%b %-d, %Y'), 'Never') AS last_activity,
      array_to_string(i, '; ') AS issues, CASE WHEN len(i) >= 2 THEN 'high' ELSE 'medium' END AS priority FROM g WHERE len(i) > 0""",
)
def schools_needing_attention(v: Views) -> DataFrame:
    out = metrics.schools_needing_attention(v.schools, v.contacts, v.activities, AS_OF, sort="county")
    return out.withColumn("issues", F.array_join("issues", "; "))


@query(
    "top_attention",
    f"""WITH {FACTS_SQL}, g AS (SELECT school_id, name, county, total_contacts, list_filter([CASE WHEN total_contacts = 0 THEN 'No contacts' END,
      CASE WHEN latest IS NULL THEN 'No activity' WHEN latest <= {SIX} THEN 'Activity stale (6+ mo)' END], lambda x: x IS NOT NULL) AS i FROM facts)
    SELECT school_id, name, county, total_contacts, array_to_string(i, '; ') AS issues FROM g WHERE len(i) > 0
    ORDER BY len(i) DESC, name, school_id LIMIT 5""",
)
def top_attention(v: Views) -> DataFrame:
    out = metrics.top_attention(v.schools, v.contacts, v.activities, AS_OF)
    return out.withColumn("issues", F.array_join("issues", "; "))


@query(
    "county_school_table",
    f"WITH {SCORE_SQL} SELECT school_id, name, active_contacts, score, tier FROM scored WHERE county = '{COUNTY}'",
)
def county_school_table(v: Views) -> DataFrame:
    return metrics.county_school_table(scored_schools(v), COUNTY).select("school_id", "name", "active_contacts", "score", "tier")


@query(
    "preview_limits",
    "SELECT contact_id, email FROM contacts WHERE is_active AND is_verified ORDER BY contact_id LIMIT 50",
)
def preview_limits(v: Views) -> DataFrame:
    rows = v.contacts.filter("is_active and is_verified")
    return metrics.preview(rows, ["contact_id"], 50).select("contact_id", "email")


@query(
    "dominant_signatures",
    """WITH cards AS (SELECT o_custkey % 97 AS site, o_custkey AS page_ord, o_orderkey AS block_ord,
        CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderstatus || ' ' || o_orderpriority END AS signature FROM orders),
    f AS (SELECT site, min(page_ord) AS page_ord FROM (SELECT site, page_ord FROM cards GROUP BY ALL HAVING count(*) >= 5) x GROUP BY 1),
    n AS (SELECT site, signature, count(*) AS blocks, min(block_ord) AS fb FROM cards JOIN f USING (site, page_ord) WHERE signature <> '' GROUP BY ALL)
    SELECT site, signature, blocks, row_number() OVER (PARTITION BY site ORDER BY blocks DESC, fb, signature) AS rank FROM n
    QUALIFY rank <= 2""",
)
def dominant_signatures(v: Views) -> DataFrame:
    cards = v.orders.select(
        (F.col("o_custkey") % 97).alias("site"), F.col("o_custkey").alias("page_ord"), F.col("o_orderkey").alias("block_ord"),
        F.when(F.col("o_orderkey") % 5 == 0, "").otherwise(F.concat_ws(" ", "o_orderstatus", "o_orderpriority")).alias("signature"),
    )
    out = extract.dominant_signatures(cards)
    return out.select("site", "signature", "blocks", F.col("rank").cast("bigint").alias("rank"))
