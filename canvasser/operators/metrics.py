"""Engagement metrics.

Children (contacts, activities, participation, programs) are always aggregated per school on
their own and joined afterwards: no fan-out, partial aggregation before each shuffle, and all
joins share the partitioning by ``school_id``. Participation is the long table
(event_id, school_id), so an event with very many participants stays many rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canvasser import schema as M
from canvasser.functions import text as X
from canvasser.functions.dates import AsOf, at, days_between, format_day, months_before
from canvasser.operators.filters import has_county


def _n(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0)).cast("bigint")


def _total(c: Column | str) -> Column:
    """Sum, 0 instead of null over no rows."""
    return F.coalesce(F.sum(c), F.lit(0)).cast("bigint")


def contacts_per_school(contacts: DataFrame) -> DataFrame:
    return contacts.groupBy("school_id").agg(
        F.count("*").alias("total_contacts"), F.count_if("is_active").alias("active_contacts")
    )


def activities_per_school(activities: DataFrame) -> DataFrame:
    return activities.groupBy("school_id").agg(
        F.count("*").alias("activities"), F.max("date").alias("latest")
    )


def event_appearances_per_school(participation: DataFrame, distinct: bool = False) -> DataFrame:
    """Appearances per school; a repeated id inside one event counts again unless ``distinct``."""
    rows = participation.select("event_id", "school_id")
    rows = rows.distinct() if distinct else rows
    return rows.groupBy("school_id").agg(F.count("*").alias("appearances"))


def school_facts(
    schools: DataFrame,
    contacts: DataFrame | None = None,
    activities: DataFrame | None = None,
    participation: DataFrame | None = None,
) -> DataFrame:
    """Schools with the counters of the given children, 0 where there are none."""
    out = schools
    if contacts is not None:
        out = out.join(contacts_per_school(contacts), "school_id", "left")
        out = out.withColumns({c: _n(c) for c in ("total_contacts", "active_contacts")})
    if activities is not None:
        out = out.join(activities_per_school(activities), "school_id", "left")
        out = out.withColumn("activities", _n("activities"))
    if participation is not None:
        out = out.join(event_appearances_per_school(participation), "school_id", "left")
        out = out.withColumn("appearances", _n("appearances"))
    return out


def _one_row(*parts: DataFrame) -> DataFrame:
    """One row with the columns of several one-row aggregates (no column is in two of them)."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out.agg(*[F.max(c).alias(c) for c in out.columns])


def summary_metrics(schools: DataFrame, contacts: DataFrame, events: DataFrame, activities: DataFrame, as_of: AsOf) -> DataFrame:
    facts = school_facts(schools.select("school_id"), activities=activities)
    stale = F.col("latest").isNull() | (F.col("latest") <= months_before(as_of, 6))
    return _one_row(
        facts.agg(
            F.count("*").alias("total_schools"),
            F.count_if(F.col("activities") > 0).alias("engaged_schools"),
            F.count_if(stale).alias("needing_attention"),
        ),
        contacts.agg(F.count_if("is_active").alias("active_contacts")),
        events.agg(F.count("*").alias("total_events"), _total("attendees").alias("total_attendees")),
    )


def engagement_funnel(schools: DataFrame, contacts: DataFrame, activities: DataFrame, participation: DataFrame, as_of: AsOf) -> DataFrame:
    facts = school_facts(schools.select("school_id"), contacts, activities, participation)
    recent = F.coalesce(F.col("latest") > months_before(as_of, 6), F.lit(False))
    counts = facts.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("total_contacts") > 0).alias("with_contacts"),
        F.count_if(recent).alias("recent"),
        F.count_if(F.col("appearances") > 0).alias("at_events"),
    )
    stages = F.array(
        *[
            F.struct(F.lit(i).alias("ord"), F.lit(label).alias("stage"), F.col(c).alias("schools"))
            for i, (label, c) in enumerate(
                [("Total Schools", "total"), ("With Contacts", "with_contacts"), ("Active (6 mo)", "recent"), ("At Events", "at_events")]
            )
        ]
    )
    rows = counts.select("total", F.inline(stages))
    share = F.concat(X.pct_round("schools", "total").cast("string"), F.lit("%"))
    return rows.select(
        "ord", "stage", "schools", F.when(F.col("ord") == 0, "baseline").otherwise(share).alias("share")
    )


def top_engaged_schools(schools: DataFrame, contacts: DataFrame, activities: DataFrame, participation: DataFrame, n: int = 10) -> DataFrame:
    facts = school_facts(schools.select("school_id", "name"), contacts, activities, participation)
    score = 3 * F.col("activities") + 2 * F.col("active_contacts") + 4 * F.col("appearances")
    return (
        facts.select(
            "school_id", "name", X.truncate_label("name", 22, 20).alias("label"),
            score.alias("score"), "activities", "active_contacts", "appearances",
        )
        .filter("score > 0")
        .orderBy(F.desc("score"), "name", "school_id")
        .limit(n)
    )


def _county_reach(schools: DataFrame, reached: DataFrame, name: str) -> DataFrame:
    """Per county: schools in all and those with a row in ``reached``."""
    ids = reached.select("school_id").distinct().withColumn("_hit", F.lit(True))
    rows = has_county(schools).select("school_id", "county").join(ids, "school_id", "left")
    return rows.groupBy("county").agg(
        F.count("*").alias("total"), F.count_if(F.coalesce("_hit", F.lit(False))).alias(name)
    )


def counties_at_risk(schools: DataFrame, contacts: DataFrame, n: int = 8) -> DataFrame:
    reach = _county_reach(schools, contacts, "with_contacts")
    reach = reach.withColumns(
        {"gap": F.col("total") - F.col("with_contacts"), "rate": F.col("with_contacts") / F.col("total")}
    )
    return reach.filter("total >= 2 and gap > 0").orderBy(F.desc("gap"), "county").limit(n)


def event_type_distribution(events: DataFrame, label_map: Mapping[str, str] = M.EVENT_LABELS) -> DataFrame:
    counts = events.groupBy("type").agg(F.count("*").alias("events"), _total("attendees").alias("attendees"))
    return counts.withColumn("label", X.labels("type", label_map))


def county_engagement_rate_ranking(schools: DataFrame, reached: DataFrame, mode: str = "event", n: int = 14) -> DataFrame:
    """Lowest rate first. ``reached`` is participation (mode event) or contacts (mode contact)."""
    reach = _county_reach(schools, reached, "engaged").filter("total >= 2")
    label = {"event": "at event", "contact": "with contacts"}[mode]
    return (
        reach.withColumns(
            {
                "rate": F.col("engaged") / F.col("total"),
                "pct": X.pct_round("engaged", "total"),
                "label": F.lit(label),
            }
        )
        .orderBy("rate", "county")
        .limit(n)
    )


def county_comparison(schools: DataFrame, participation: DataFrame, n: int = 12) -> DataFrame:
    reach = _county_reach(schools, participation, "engaged")
    return (
        reach.withColumn("label", X.truncate_label("county", 12, 10))
        .orderBy(F.desc("total"), "county")
        .limit(n)
    )


def program_coverage_by_county(programs: DataFrame, schools: DataFrame, categories: Sequence[str] = tuple(M.PROGRAM_CATEGORIES), n: int = 10) -> DataFrame:
    """Programs per county and fixed category, inactive ones included.

    Programs are first counted per school and category, then carried to the county. Counties
    that only have programs of unknown categories stay with a total of 0.
    """
    per_school = programs.groupBy("school_id", "category").agg(F.count("*").alias("_n"))
    located = per_school.join(has_county(schools).select("school_id", "county"), "school_id")
    wide = located.groupBy("county").agg(
        *[_total(F.when(F.col("category") == c, F.col("_n"))).alias(c) for c in categories]
    )
    total = sum((F.col(c) for c in categories), F.lit(0))
    return (
        wide.withColumns({"total": total.cast("bigint"), "label": X.truncate_label("county", 12, 10)})
        .orderBy(F.desc("total"), "county")
        .limit(n)
    )


def dashboard_metrics(schools: DataFrame, contacts: DataFrame, events: DataFrame, activities: DataFrame, as_of: AsOf) -> DataFrame:
    return _one_row(
        schools.agg(F.count_if("is_active").alias("active_schools")),
        contacts.agg(F.count_if("is_active").alias("active_contacts")),
        events.agg(F.count_if(F.col("date") > at(as_of)).alias("upcoming_events")),
        activities.agg(F.count_if(F.col("date") > months_before(as_of, 12)).alias("recent_activities")),
    )


def dashboard_overview(schools: DataFrame, contacts: DataFrame, activities: DataFrame, as_of: AsOf) -> DataFrame:
    facts = school_facts(schools.select("school_id"), contacts, activities)
    recent = F.coalesce(F.col("latest") > months_before(as_of, 6), F.lit(False))
    both = _one_row(
        facts.agg(
            F.count("*").alias("total_schools"),
            F.count_if(F.col("total_contacts") > 0).alias("with_contacts"),
            F.count_if(recent).alias("with_recent_activity"),
        ),
        contacts.agg(F.count("*").alias("_contacts")),
    )
    return both.withColumn("avg_contacts", X.one_decimal("_contacts", "total_schools")).drop("_contacts")


def county_school_summary(schools: DataFrame, contacts: DataFrame, participation: DataFrame, programs: DataFrame, engaged: bool = False) -> DataFrame:
    """Schools, verified schools, contacts, distinct events and programs per county.

    Every child is reduced before it meets the schools. Distinct events are the distinct
    (county, event) pairs, which is a plain two-step aggregate. With ``engaged`` also the
    schools with an event and their share in percent, from the same facts.
    """
    located = has_county(schools).select("school_id", "county", "is_verified")
    facts = located
    children = [(contacts, "_contacts"), (programs, "_programs"), *([(participation, "_events")] if engaged else [])]
    for child, name in children:
        facts = facts.join(child.groupBy("school_id").agg(F.count("*").alias(name)), "school_id", "left")
    reach = [F.count("_events").alias("engaged_schools")] if engaged else []
    per_county = facts.groupBy("county").agg(
        F.count("*").alias("total_schools"), F.count_if("is_verified").alias("verified_schools"),
        F.coalesce(F.sum("_contacts"), F.lit(0)).alias("total_contacts"), F.coalesce(F.sum("_programs"), F.lit(0)).alias("total_programs"), *reach,
    )
    pairs = participation.select("school_id", "event_id").distinct().join(located.select("school_id", "county"), "school_id")
    events = pairs.select("county", "event_id").distinct().groupBy("county").agg(F.count("*").alias("total_events"))
    out = per_county.join(events, "county", "left").withColumn("total_events", _n("total_events"))
    share = [F.col("engaged_schools"), F.round(100.0 * F.col("engaged_schools") / F.col("total_schools"), 1).alias("engagement_pct")] if engaged else []
    return out.select("county", "total_schools", "verified_schools", "total_contacts", "total_events", "total_programs", *share)


def county_engagement_rate(schools: DataFrame, participation: DataFrame) -> DataFrame:
    reach = _county_reach(schools, participation, "engaged_schools").withColumnRenamed("total", "total_schools")
    pct = F.round(100.0 * F.col("engaged_schools") / F.col("total_schools"), 1)
    return reach.withColumn("engagement_pct", pct).orderBy(F.desc("total_schools"), "county")


def school_engagement_summary(schools: DataFrame, contacts: DataFrame, participation: DataFrame, events: DataFrame) -> DataFrame:
    """Per school: contacts, distinct events and the date of the last one."""
    dated = participation.select("event_id", "school_id").distinct()
    dated = dated.join(events.select("event_id", "date"), "event_id", "left")
    per_school = dated.groupBy("school_id").agg(
        F.count("*").alias("event_count"), F.max("date").alias("last_event_date")
    )
    out = school_facts(schools.select("school_id", "name", "county"), contacts)
    out = out.join(per_school, "school_id", "left")
    return out.select(
        "school_id", "name", "county",
        F.col("total_contacts").alias("contact_count"), _n("event_count").alias("event_count"), "last_event_date",
    )


def county_program_coverage(programs: DataFrame, schools: DataFrame, county: str, label_map: Mapping[str, str] = M.PROGRAM_LABELS) -> DataFrame:
    """Active programs per known category in one county."""
    local = schools.filter(F.col("county") == county).select("school_id")
    rows = programs.filter("is_active").filter(F.col("category").isin(list(label_map)))
    rows = rows.join(local, "school_id", "left_semi")
    counts = rows.groupBy("category").agg(F.count("*").alias("programs"))
    order = F.array_position(F.array(*[F.lit(c) for c in label_map]), F.col("category"))
    return counts.withColumn("label", X.labels("category", label_map)).orderBy(F.desc("programs"), order)


def engagement_score(
    schools: DataFrame,
    contacts: DataFrame,
    activities: DataFrame,
    participation: DataFrame,
    programs: DataFrame,
    as_of: AsOf,
) -> DataFrame:
    """Score 0..100, tier and recommendations per school."""
    recent = F.col("date") > months_before(as_of, 6)
    per_contact = contacts.groupBy("school_id").agg(F.count_if("is_active").alias("active_contacts"))
    per_activity = activities.groupBy("school_id").agg(
        F.count_if(recent).alias("recent_activities"), F.max("date").alias("latest")
    )
    per_event = event_appearances_per_school(participation, distinct=True).withColumnRenamed("appearances", "events")
    per_program = programs.groupBy("school_id").agg(F.count_if("is_active").alias("active_programs"))
    out = schools.select("school_id", "name", "county")
    for child in (per_contact, per_activity, per_event, per_program):
        out = out.join(child, "school_id", "left")
    counters = ["active_contacts", "recent_activities", "events", "active_programs"]
    out = out.withColumns({c: _n(c) for c in counters})

    capped = lambda c, most: F.least(F.col(c), F.lit(most)) * 10
    score = capped("active_contacts", 3) + capped("recent_activities", 3) + capped("events", 2) + capped("active_programs", 2)
    out = out.withColumn("score", score.cast("bigint"))
    tier = F.when(F.col("score") >= 60, "high").when(F.col("score") >= 30, "medium").otherwise("low")

    days = days_between(at(as_of), F.col("latest"))
    stale = F.concat(
        F.lit("No activity in the last 6 months — last contact was "),
        days.cast("string"),
        F.when(days == 1, " day ago.").otherwise(" days ago."),
    )
    # Fixed texts.
    advice = [
        F.when(F.col("active_contacts") == 0, "No active contacts — reach out to establish a school liaison.")
        .when(F.col("active_contacts") == 1, "Only 1 active contact — consider building a broader relationship at this school."),
        F.when(
            F.col("recent_activities") == 0,
            F.when(F.col("latest").isNotNull(), stale).otherwise(
                "No activity logged yet — schedule an initial outreach visit or call."
            ),
        ),
        F.when(F.col("events") == 0, "This school has never appeared at an event — invite them to an upcoming fair or campus visit."),
        F.when(F.col("active_programs") == 0, "No STEM programs recorded — survey the school to identify CS, engineering, or robotics offerings."),
    ]
    given = F.array_compact(F.array(*advice))
    strong = F.array(F.lit("Strong engagement — maintain regular contact and continue inviting this school to events."))
    return out.select(
        "school_id", "name", "county", *counters, "score", tier.alias("tier"),
        F.when(F.size(given) > 0, given).otherwise(strong).alias("recommendations"),
    )


def programs_by_category(programs: DataFrame, school_id, categories: Sequence[str] = tuple(M.PROGRAM_CATEGORIES)) -> DataFrame:
    """Programs of one school in category order, one row each: a list per category stays rows."""
    order = F.array_position(F.array(*[F.lit(c) for c in categories]), F.col("category"))
    rows = programs.filter(F.col("school_id") == school_id).withColumn("category_ord", order)
    return rows.filter("category_ord > 0").select("category_ord", "category", "program_id", "name", "is_active").orderBy(
        "category_ord", "program_id"
    )


def missing_county_count(schools: DataFrame) -> DataFrame:
    return schools.agg(F.count_if(~X.has_text("county")).alias("missing_county"))


def single_reason(followups: DataFrame) -> DataFrame:
    """True if there are rows and all have the same reason."""
    return followups.agg((F.coalesce(F.min("reason") == F.max("reason"), F.lit(False))).alias("single_reason"))


def schools_needing_attention(schools: DataFrame, contacts: DataFrame, activities: DataFrame, as_of: AsOf, sort: str = "name") -> DataFrame:
    facts = school_facts(schools.select("school_id", "name", "county"), contacts, activities)
    # Fixed texts.
    issues = F.array_compact(
        F.array(
            F.when(F.col("total_contacts") == 0, "No contacts").when(F.col("active_contacts") == 0, "No active contacts"),
            F.when(F.col("latest").isNull(), "No activity recorded").when(
                F.col("latest") <= months_before(as_of, 6), "No activity in 6+ months"
            ),
        )
    )
    out = facts.select(
        "school_id", "name", "county", "total_contacts",
        format_day(F.col("latest")).alias("last_activity"), issues.alias("issues"),
        F.when(F.size(issues) >= 2, "high").otherwise("medium").alias("priority"),
    ).filter(F.size("issues") > 0)
    keys = ["county", "name", "school_id"] if sort == "county" else ["name", "school_id"]
    return out.orderBy(*keys)


def top_attention(schools: DataFrame, contacts: DataFrame, activities: DataFrame, as_of: AsOf, n: int = 5) -> DataFrame:
    facts = school_facts(schools.select("school_id", "name", "county"), contacts, activities)
    # Fixed texts.
    issues = F.array_compact(
        F.array(
            F.when(F.col("total_contacts") == 0, "No contacts"),
            F.when(F.col("latest").isNull(), "No activity").when(
                F.col("latest") <= months_before(as_of, 6), "Activity stale (6+ mo)"
            ),
        )
    )
    out = facts.select("school_id", "name", "county", "total_contacts", issues.alias("issues"))
    return out.filter(F.size("issues") > 0).orderBy(F.desc(F.size("issues")), "name", "school_id").limit(n)


def followup_candidates(schools: DataFrame, contacts: DataFrame, events: DataFrame, activities: DataFrame, participation: DataFrame, as_of: AsOf) -> DataFrame:
    """Schools to follow up, with reason and urgency."""
    recent_events = events.filter(F.to_date("date").cast("timestamp_ntz") > months_before(as_of, 3)).select("event_id")
    at_recent = participation.join(recent_events, "event_id", "left_semi").select("school_id").distinct()
    facts = school_facts(schools.select("school_id", "name", "county"), contacts, activities)
    facts = facts.join(at_recent.withColumn("_recent", F.lit(True)), "school_id", "left")
    idle, active = F.col("latest").isNull(), F.col("active_contacts") > 0
    days = days_between(at(as_of), F.col("latest"))
    overdue = active & (F.col("latest") <= months_before(as_of, 1))
    # Fixed texts and weights.
    reason = (
        F.when(F.col("_recent") & idle, "Attended recent event — no follow-up")
        .when(active & idle, "Has contacts — no activity logged yet")
        .when(overdue, F.concat(days.cast("string"), F.lit("d since last activity")))
    )
    urgency = F.when(F.col("_recent") & idle, 9999).when(active & idle, 8888).when(overdue, days)
    return facts.select(
        "school_id", "name", "county", reason.alias("reason"), urgency.cast("bigint").alias("urgency")
    ).filter("reason is not null")


def upcoming_followups(schools, contacts, events, activities, participation, as_of: AsOf, n: int = 10) -> DataFrame:
    rows = followup_candidates(schools, contacts, events, activities, participation, as_of)
    return rows.orderBy(F.desc("urgency"), "name", "school_id").limit(n)


def county_school_table(scored: DataFrame, county: str, sort: str = "score", descending: bool = True) -> DataFrame:
    """Scored schools of a county by name, contacts or score."""
    column = {"name": "name", "contacts": "active_contacts", "score": "score"}[sort]
    direction = F.desc if descending else F.asc
    rows = scored.filter(F.col("county") == county)
    return rows.orderBy(direction(column), "name", "school_id")


def preview(df: DataFrame, order: Sequence[Column | str], n: int) -> DataFrame:
    """The first n rows shown of a longer list."""
    return df.orderBy(*order).limit(n)
