"""Joins between the entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvasser.functions import text as X
from canvasser.functions.ordering import latest_per_key


def contacts_with_school(contacts: DataFrame, schools: DataFrame, missing: str = "") -> DataFrame:
    """Contact rows with the school's columns; ``missing`` stands in for an unknown school."""
    cols = ["name", "county", "address", "city", "state", "zip_code"]
    right = schools.select("school_id", *[F.col(c).alias(f"school_{c}") for c in cols])
    joined = contacts.join(right, "school_id", "left")
    return joined.withColumns({f"school_{c}": F.coalesce(f"school_{c}", F.lit(missing)) for c in cols})


def schools_never_at_event(schools: DataFrame, participation: DataFrame) -> DataFrame:
    seen = participation.select("school_id").distinct()
    return schools.join(seen, "school_id", "left_anti").orderBy("county", "name", "school_id")


def events_for_school(events: DataFrame, school_id) -> DataFrame:
    """Events whose participant array holds one school."""
    return events.filter(F.array_contains("participants", F.lit(school_id)))


def events_for_county(events: DataFrame, participation: DataFrame, schools: DataFrame, county: str) -> DataFrame:
    """Events with a participant in the county, each once, newest first."""
    local = schools.filter(F.col("county") == county).select("school_id")
    ids = participation.join(local, "school_id", "left_semi").select("event_id").distinct()
    return events.join(ids, "event_id", "left_semi").orderBy(F.desc("date"), "event_id")


def recent_activity_feed(activities: DataFrame, schools: DataFrame, n: int = 12) -> DataFrame:
    """The n newest activities with their school. n rows are proven small, so they are broadcast."""
    newest = activities.orderBy(F.desc("date"), "activity_id").limit(n)
    named = schools.select("school_id", F.col("name").alias("school_name"))
    found = named.join(F.broadcast(newest.select("school_id").distinct()), "school_id", "left_semi")
    return newest.join(found, "school_id", "left").orderBy(F.desc("date"), "activity_id")


def county_cards(summary: DataFrame) -> DataFrame:
    """Cards of the counties with a name; ``summary`` holds the engaged schools (``metrics.county_school_summary``)."""
    pct = F.col("engagement_pct")
    band = F.when(pct >= 30, "success").when(pct >= 10, "warning").otherwise("error")
    return summary.filter("county <> ''").withColumn("band", band).orderBy("county")


def resolve_school_name(rows: DataFrame, schools: DataFrame, imported: DataFrame | None = None) -> DataFrame:
    """Add ``school_id`` for the lower-cased name in ``school_name``; imported names override.

    Among schools of one name the last (by id) wins; unmatched names give an empty id.
    """
    known = schools.select(F.lower("name").alias("_key"), "school_id", F.lit(0).alias("_prio"))
    if imported is not None:
        more = imported.select(F.lower("name").alias("_key"), "school_id", F.lit(1).alias("_prio"))
        known = known.unionByName(more)
    known = latest_per_key(known, ["_key"], "_prio", "school_id")
    known = known.select("_key", F.col("school_id").cast("string").alias("school_id"))
    # Rows without a name may be most of all: a salt spreads them, and they take the one id of
    # the empty name instead of a match.
    empty = F.coalesce(F.col("_key"), F.lit("")) == ""
    nothing = F.lit(0).cast("bigint")
    keyed = rows.withColumn("_key", F.lower("school_name")).withColumn("_salt", F.when(empty, F.xxhash64(*rows.columns)).otherwise(nothing))
    nameless = known.filter("_key = ''").agg(F.max("school_id"))
    joined = keyed.join(known.filter("_key <> ''").withColumn("_salt", nothing), ["_key", "_salt"], "left")
    found = F.when(empty, F.when(F.col("_key") == "", nameless.scalar())).otherwise(F.col("school_id"))
    return joined.withColumn("school_id", F.coalesce(found, F.lit(""))).drop("_key", "_salt")


KEY = "_facility_key"


def with_facility_key(schools_list: DataFrame) -> DataFrame:
    """The listed schools that have a key, with it in its normalised form (``KEY``)."""
    if KEY in schools_list.columns:
        return schools_list
    key = X.facility_key(
        F.col("FacilityKey"), F.col("County"), F.col("FacilityName"), F.col("City"), F.col("Zip"), F.col("NCES_ID")
    )
    return schools_list.filter(key.isNotNull()).withColumn(KEY, X.normalize_facility_key(key))


def facility_keys(schools_list: DataFrame) -> DataFrame:
    """Normalised name and key per listed school, last row of a name wins."""
    rows = with_facility_key(schools_list).select(
        X.normalize_text("FacilityName").alias("name_key"), F.col(KEY).alias("facility_key"), "seq"
    )
    return latest_per_key(rows.filter("name_key <> ''"), ["name_key"], "seq").drop("seq")


def link_scraped_contacts(completed: DataFrame, schools_list: DataFrame) -> DataFrame:
    """Named contacts of the result map with their facility key.

    ``completed`` (school_name, contacts array, seq). Contacts of unknown schools are left out;
    ``unknown_schools`` counts those.
    """
    return link_to_keys(completed, facility_keys(schools_list))


def link_to_keys(completed: DataFrame, keys: DataFrame) -> DataFrame:
    """``link_scraped_contacts`` for the rows of ``facility_keys``."""
    keyed = completed.withColumn("name_key", X.normalize_text("school_name"))
    rows = keyed.select(
        "name_key", "seq", F.posexplode(F.coalesce("contacts", F.array())).alias("pos", "c")
    )
    rows = rows.select(
        "name_key", "seq", "pos",
        X.clean_text("c.name").alias("name"),
        X.clean_text("c.phone").alias("phone"),
        X.clean_text("c.email").alias("email"),
        X.clean_text("c.title").alias("job_name"),
    ).filter("name is not null")
    joined = rows.join(keys, "name_key")
    return joined.select(
        "name", "phone", "email", "job_name", F.col("facility_key").alias("school_worked_at"), "seq", "pos"
    )


def unknown_schools(completed: DataFrame, schools_list: DataFrame) -> DataFrame:
    return without_key(completed, facility_keys(schools_list))


def without_key(completed: DataFrame, keys: DataFrame) -> DataFrame:
    """``unknown_schools`` for the rows of ``facility_keys``."""
    keyed = completed.withColumn("name_key", X.normalize_text("school_name"))
    return keyed.join(keys, "name_key", "left_anti")


def attach_district(schools: DataFrame, districts: DataFrame) -> DataFrame:
    """Left lookup of ``district_id`` by facility key (one district per key)."""
    return schools.join(districts.select("facility_key", "district_id"), "facility_key", "left")


def facility_match_key(name: str = "FacilityName", city: str = "City") -> list[F.Column]:
    return [
        X.normalize_facility_name(name).alias("name_key"),
        X.normalize_facility_name(city).alias("city_key"),
    ]


def resume_pending(rows: DataFrame, done: DataFrame) -> DataFrame:
    """Input rows whose (name, city) key is not in the progress table yet."""
    keyed = rows.select("*", *facility_match_key())
    finished = done.select(*facility_match_key()).distinct()
    return keyed.join(finished, ["name_key", "city_key"], "left_anti").drop("name_key", "city_key")
