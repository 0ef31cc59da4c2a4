"""Loaders: stored rows to typed entities with the defaults of the data model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvasser import schema as M
from canvasser.functions import text as X
from canvasser.functions.dates import AsOf, at
from canvasser.functions.ordering import latest_per_key


def _or(name: str, default) -> F.Column:
    return F.coalesce(F.col(name), F.lit(default))


def load_schools(rows: DataFrame, ordered: bool = True, key: str = "facility_key") -> DataFrame:
    """Schools with defaults; ``ordered=False`` for use inside other plans."""
    out = rows.select(
        F.col(key).alias("school_id"),
        "name",
        F.col("district_id").cast("string").alias("district"),
        _or("county_name", "").alias("county"),
        _or("address", "").alias("address"),
        _or("city", "").alias("city"),
        F.lit(M.STATE).alias("state"),
        _or("zipcode", "").alias("zip_code"),
        X.school_type("type_of_school").alias("school_type"),
        _or("is_active", True).alias("is_active"),
        _or("is_verified", False).alias("is_verified"),
        _or("data_source", "manual").alias("data_source"),
        _or("priority_tier", "standard").alias("priority_tier"),
    )
    return out.orderBy("name", "school_id") if ordered else out


def resolve_contact_school(staff: DataFrame, junction: DataFrame) -> DataFrame:
    """Staff with their school: last junction row, else the inline column, else empty."""
    last = latest_per_key(junction.filter("staff_id is not null"), ["staff_id"], "seq", "school_id")
    last = last.select("staff_id", F.col("school_id").alias("_linked"))
    joined = staff.join(last, "staff_id", "left")
    found = F.coalesce(F.col("_linked"), F.col("school_worked_at"), F.lit(""))
    return joined.withColumn("school_id", found).drop("_linked")


def load_contacts(staff: DataFrame, junction: DataFrame) -> DataFrame:
    who = X.split_name("name")
    return resolve_contact_school(staff, junction).select(
        F.col("staff_id").cast("string").alias("contact_id"),
        who["first"].alias("first_name"),
        who["last"].alias("last_name"),
        _or("email", "").alias("email"),
        "phone",
        X.classify_role("job_name").alias("role"),
        "school_id",
        _or("is_active", True).alias("is_active"),
        _or("data_source", "manual").alias("data_source"),
        _or("is_verified", False).alias("is_verified"),
    )


def load_events(rows: DataFrame, as_of: AsOf) -> DataFrame:
    return rows.select(
        X.format_event_id("event_id").alias("event_id"),
        F.coalesce("fair_name", "location", F.lit(M.UNKNOWN_EVENT)).alias("name"),
        F.when(F.col("is_scraped"), "outreach_fair").otherwise("other").alias("type"),
        F.coalesce(F.col("date"), at(as_of)).alias("date"),
        _or("location", "").alias("location"),
        X.participants_split("schools_involved").alias("participants"),
        F.col("attendance").cast("bigint").alias("attendees"),
    )


def explode_participants(events: DataFrame) -> DataFrame:
    """One row per array element: the long form (event_id, school_id) used by the metrics."""
    return events.select("event_id", F.explode("participants").alias("school_id"))


def load_activities(rows: DataFrame, ordered: bool = True) -> DataFrame:
    return rows.orderBy(F.desc("date"), "activity_id") if ordered else rows


def load_programs(rows: DataFrame) -> DataFrame:
    return rows.withColumn("is_active", _or("is_active", True))


def load_pages(rows: DataFrame) -> DataFrame:
    return rows.select("page_id", "url", "html")


def build_city_directory(typeahead: DataFrame, profiles: DataFrame) -> DataFrame:
    """High schools of the search list joined to their profile; last profile per name wins.

    ``contacts`` maps the seven slots to (title, name). The list itself is keyed by name
    first, its last entry per name naming the profile to read.
    """
    wanted = latest_per_key(typeahead.filter("is_high_school"), ["school_name"], "seq")
    picked = profiles.join(wanted.select("school_id"), "school_id", "left_semi")
    last = latest_per_key(picked, ["school_name"], "seq")
    slots = [
        part
        for slot in M.DIRECTORY_SLOTS
        for part in (
            F.lit(slot),
            F.struct(F.col(f"{slot}_title").alias("title"), F.col(f"{slot}_name").alias("name")),
        )
    ]
    return last.select(
        F.col("school_name").alias("name"), "phone", "website", F.create_map(*slots).alias("contacts")
    )
