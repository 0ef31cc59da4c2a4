"""Metrics on a small school list with the edge cases of each rule."""

import datetime as dt

import pytest
from frames import rows

from canvasser.operators import filters, joins, metrics

AS_OF = "2024-08-31 10:00:00"
EDGE = dt.datetime(2024, 2, 29, 10)  # six months before, clamped to the month end


@pytest.fixture(scope="module")
def crm(spark):
    make = spark.createDataFrame
    schools = make(
        [
            (1, "Alpha", "Cook", True, True, "high_school", "", "Chicago", ""),
            (2, "Beta", "Cook", True, False, "middle_school", "", "Chicago", ""),
            (3, "Gamma", "Lake", False, False, "high_school", "", "", ""),
            (4, "Delta", "", True, False, "high_school", "", "", ""),
            (5, "Epsilon", "  ", True, False, "high_school", "", "", ""),
            (6, "Zeta", None, True, False, "high_school", "", "", ""),
            (7, "A name of 23 characters", "County of 13c", True, False, "high_school", "", "", ""),
            (8, "A name of 22 character", "County of 13c", True, True, "high_school", "", "", ""),
        ],
        "school_id int, name string, county string, is_active boolean, is_verified boolean, school_type string, district string, city string, address string",
    )
    contacts = make(
        [(1, 1, True), (2, 1, True), (3, 1, False), (4, 1, True), (5, 1, True), (6, 2, False), (7, 3, True), (8, 99, True), (9, 8, True)],
        "contact_id int, school_id int, is_active boolean",
    )
    activities = make(
        [
            (1, 1, EDGE + dt.timedelta(microseconds=1)),
            (2, 2, EDGE),
            (3, 1, dt.datetime(2024, 8, 30)),
            (4, 1, dt.datetime(2024, 8, 1)),
            (5, 1, dt.datetime(2024, 7, 1)),
            (6, 3, dt.datetime(2024, 7, 31, 10)),
        ],
        "activity_id int, school_id int, date timestamp_ntz",
    )
    events = make(
        [
            ("e1", "Fair", "workshop", dt.datetime(2024, 8, 31, 10), 10),
            ("e2", "Camp", "other", dt.datetime(2024, 8, 31, 10, 0, 1), None),
            ("e3", "Old", "other", dt.datetime(2020, 1, 1), 5),
        ],
        "event_id string, name string, type string, date timestamp_ntz, attendees bigint",
    )
    participation = make([("e1", 1), ("e1", 1), ("e2", 7), ("e3", 2), ("e3", 77)], "event_id string, school_id int")
    programs = make(
        [(1, 1, "cs", True), (2, 1, "cs", False), (3, 2, "robotics", True), (4, 2, "odd", True), (5, 4, "cs", True)],
        "program_id int, school_id int, category string, is_active boolean",
    )
    return dict(schools=schools, contacts=contacts, activities=activities, events=events, participation=participation, programs=programs)


def pick(crm, *names):
    return [crm[n] for n in names]


def test_counts_per_school(crm):
    assert rows(metrics.contacts_per_school(crm["contacts"])) == [(1, 5, 4), (2, 1, 0), (3, 1, 1), (8, 1, 1), (99, 1, 1)]
    assert rows(metrics.event_appearances_per_school(crm["participation"])) == [(1, 2), (2, 1), (7, 1), (77, 1)]
    assert rows(metrics.event_appearances_per_school(crm["participation"], distinct=True))[0] == (1, 1)


def test_summary_and_funnel(crm):
    s = metrics.summary_metrics(*pick(crm, "schools", "contacts", "events", "activities"), AS_OF).first().asDict()
    # Beta's only activity is exactly six months old, so it needs attention; one microsecond later does not.
    assert s == dict(total_schools=8, engaged_schools=3, needing_attention=6, active_contacts=7, total_events=3, total_attendees=15)
    funnel = metrics.engagement_funnel(*pick(crm, "schools", "contacts", "activities", "participation"), AS_OF)
    assert rows(funnel) == [
        (0, "Total Schools", 8, "baseline"), (1, "With Contacts", 4, "50%"), (2, "Active (6 mo)", 2, "25%"), (3, "At Events", 3, "38%")
    ]


def test_top_and_labels(crm):
    top = metrics.top_engaged_schools(*pick(crm, "schools", "contacts", "activities", "participation")).collect()
    assert [(r.school_id, r.score) for r in top] == [(1, 28), (2, 7), (3, 5), (7, 4), (8, 2)]
    assert top[3].label == "A name of 23 charact…" and top[4].label == "A name of 22 character"


def test_counties(crm):
    assert rows(metrics.counties_at_risk(crm["schools"], crm["contacts"]), "county", "total", "with_contacts", "gap") == [("County of 13c", 2, 1, 1)]
    ranked = metrics.county_engagement_rate_ranking(crm["schools"], crm["participation"]).collect()
    assert [(r.county, r.engaged, r.pct) for r in ranked] == [("County of 13c", 1, 50), ("Cook", 2, 100)]
    assert {r.label for r in metrics.county_comparison(crm["schools"], crm["participation"]).collect()} == {"County of …", "Cook", "Lake"}
    cover = metrics.program_coverage_by_county(crm["programs"], crm["schools"]).collect()
    assert [(r.county, r.cs, r.robotics, r.total) for r in cover] == [("Cook", 2, 1, 3)]
    assert metrics.missing_county_count(crm["schools"]).first()[0] == 3
    summary = metrics.county_school_summary(*pick(crm, "schools", "contacts", "participation", "programs"))
    assert rows(summary.filter("county = 'Cook'")) == [("Cook", 2, 1, 6, 2, 4)]
    with_rate = metrics.county_school_summary(*pick(crm, "schools", "contacts", "participation", "programs"), engaged=True)
    assert rows(with_rate.drop("engaged_schools", "engagement_pct")) == rows(summary)
    rate = metrics.county_engagement_rate(crm["schools"], crm["participation"])
    assert rows(with_rate, "county", "engaged_schools", "engagement_pct") == rows(rate, "county", "engaged_schools", "engagement_pct")
    cards = joins.county_cards(with_rate)
    assert rows(cards, "county", "engagement_pct", "band") == [("Cook", 100.0, "success"), ("County of 13c", 50.0, "success"), ("Lake", 0.0, "error")]


def test_dashboard(crm):
    d = metrics.dashboard_metrics(*pick(crm, "schools", "contacts", "events", "activities"), AS_OF).first().asDict()
    assert d == dict(active_schools=7, active_contacts=7, upcoming_events=1, recent_activities=6)
    o = metrics.dashboard_overview(*pick(crm, "schools", "contacts", "activities"), AS_OF).first().asDict()
    assert o == dict(total_schools=8, with_contacts=4, with_recent_activity=2, avg_contacts=1.1)
    empty = metrics.dashboard_overview(crm["schools"].limit(0), crm["contacts"].limit(0), crm["activities"].limit(0), AS_OF).first()
    assert empty.avg_contacts == 0.0 and empty.total_schools == 0


def test_engagement_score(crm):
    got = {r.school_id: r for r in metrics.engagement_score(*pick(crm, "schools", "contacts", "activities", "participation", "programs"), AS_OF).collect()}
    # Contacts and activities are capped at 3, the doubled participant counts as one event.
    assert (got[1].score, got[1].tier, got[1].events) == (30 + 30 + 10 + 10, "high", 1)
    assert got[1].recommendations == ["Strong engagement — maintain regular contact and continue inviting this school to events."]
    assert (got[2].score, got[2].tier) == (10 + 20, "medium")
    assert got[2].recommendations[1] == "No activity in the last 6 months — last contact was 184 days ago."
    assert got[3].recommendations[0].startswith("Only 1 active contact")
    assert len(got[6].recommendations) == 4 and got[6].score == 0 and got[6].tier == "low"


def test_attention_and_followups(crm):
    args = pick(crm, "schools", "contacts", "activities")
    need = {r.school_id: r for r in metrics.schools_needing_attention(*args, AS_OF).collect()}
    assert need[2].issues == ["No active contacts", "No activity in 6+ months"] and need[2].priority == "high"
    assert need[2].last_activity == "Feb 29, 2024" and need[6].last_activity == "Never"
    assert 1 not in need and 3 not in need
    top = metrics.top_attention(*args, AS_OF).collect()
    assert [len(r.issues) for r in top] == [2, 2, 2, 2, 1]
    follow = metrics.upcoming_followups(*pick(crm, "schools", "contacts", "events", "activities", "participation"), AS_OF).collect()
    assert [(r.school_id, r.urgency) for r in follow] == [(7, 9999), (8, 8888), (3, 31)]
    assert metrics.single_reason(metrics.followup_candidates(*pick(crm, "schools", "contacts", "events", "activities", "participation"), AS_OF)).first()[0] is False


def test_events(crm):
    assert rows(filters.upcoming_events(crm["events"], AS_OF), "event_id") == [("e2",)]
    past = {r.event_id: r.is_past for r in filters.past_flag(crm["events"], AS_OF).collect()}
    assert past == {"e1": True, "e2": False, "e3": True}
    assert rows(joins.events_for_county(crm["events"], crm["participation"], crm["schools"], "Cook"), "event_id") == [("e1",), ("e3",)]
    days = filters.month_calendar(crm["events"], "2024-02")
    assert days.count() == 29 and days.filter("event_id is not null").count() == 0
    assert filters.month_calendar(crm["events"], "2024-08").filter("event_id is not null").count() == 2


def test_never_at_event_and_tables(crm):
    assert {r[0] for r in joins.schools_never_at_event(crm["schools"], crm["participation"]).select("school_id").collect()} == {3, 4, 5, 6, 8}
    scored = metrics.engagement_score(*pick(crm, "schools", "contacts", "activities", "participation", "programs"), AS_OF)
    assert [r.school_id for r in metrics.county_school_table(scored, "Cook").collect()] == [1, 2]
    assert [r.school_id for r in metrics.county_school_table(scored, "Cook", "contacts", descending=False).collect()] == [2, 1]


def test_hot_school(spark, crm):
    """One school with most of the rows gives the same counts as a plain count."""
    hot = spark.range(200_000).selectExpr("id as contact_id", "if(id % 3 = 0, 1, int(id % 1000)) as school_id", "id % 2 = 0 as is_active")
    got = metrics.school_facts(crm["schools"].select("school_id"), contacts=hot).filter("school_id = 1").first()
    want = sum(1 for i in range(200_000) if i % 3 == 0 or i % 1000 == 1)
    assert got.total_contacts == want
