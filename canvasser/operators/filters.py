"""Filters, searches and paged views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canvasser.functions import text as X
from canvasser.functions.dates import AsOf, at
from canvasser.functions.ordering import slice_of_order


def _keep(df: DataFrame, other: DataFrame, how: str) -> DataFrame:
    """Semi or anti join on the school, with the ids of the other side reduced first."""
    return df.join(other.select("school_id").distinct(), "school_id", how).select(*df.columns)


def schools_with_contacts(schools: DataFrame, contacts: DataFrame) -> DataFrame:
    return _keep(schools, contacts, "left_semi")


def schools_without_contacts(schools: DataFrame, contacts: DataFrame) -> DataFrame:
    return _keep(schools, contacts, "left_anti")


def filter_schools(
    schools: DataFrame,
    contacts: DataFrame | None = None,
    verified: bool | None = None,
    county: str | None = None,
    school_type: str | None = None,
    has_contacts: bool | None = None,
) -> DataFrame:
    """AND of the given predicates; None leaves one out."""
    out = schools
    if verified is not None:
        out = out.filter(F.coalesce("is_verified", F.lit(False)) == verified)
    if county:
        out = out.filter(F.col("county") == county)
    if school_type:
        out = out.filter(F.col("school_type") == school_type)
    if has_contacts is not None:
        keep = schools_with_contacts if has_contacts else schools_without_contacts
        out = keep(out, contacts)
    return out


def filter_contacts(
    contacts: DataFrame,
    verified: bool | None = None,
    role: str | None = None,
    school_id=None,
    active: bool | None = None,
) -> DataFrame:
    out = contacts
    if verified is not None:
        out = out.filter(F.coalesce("is_verified", F.lit(False)) == verified)
    if role:
        out = out.filter(F.col("role") == role)
    if school_id is not None:
        out = out.filter(F.col("school_id") == school_id)
    if active is not None:
        out = out.filter(F.col("is_active") == active)
    return out


def contacts_semi_school(contacts: DataFrame, schools: DataFrame, county: str | None = None, school_type: str | None = None) -> DataFrame:
    wanted = filter_schools(schools, county=county, school_type=school_type)
    return _keep(contacts, wanted, "left_semi")


def contacts_semi_event(contacts: DataFrame, participation: DataFrame, event_id) -> DataFrame:
    """Contacts of the schools taking part in one event."""
    return _keep(contacts, participation.filter(F.col("event_id") == event_id), "left_semi")


def target_list(
    contacts: DataFrame,
    schools: DataFrame,
    events: DataFrame,
    participation: DataFrame,
    active_only: bool = True,
    include_unverified: bool = False,
    role: str | None = None,
    county: str | None = None,
    school_type: str | None = None,
    event_id=None,
) -> DataFrame:
    """Contacts to address. An event id that does not exist leaves the list unfiltered.

    Whether it exists is part of the plan (a scalar subquery), so building it runs no job.
    """
    out = filter_contacts(
        contacts,
        verified=None if include_unverified else True,
        role=role,
        active=True if active_only else None,
    )
    if county or school_type:
        out = contacts_semi_school(out, schools, county, school_type)
    if event_id is not None:
        known = events.filter(F.col("event_id") == event_id).agg(F.count("*"))
        unknown = out.filter(known.scalar() == 0)
        out = contacts_semi_event(out, participation, event_id).filter(known.scalar() > 0).unionByName(unknown)
    return out


def filter_events(events: DataFrame, event_type: str | None = None) -> DataFrame:
    """Events of a type, newest first."""
    out = events.filter(F.col("type") == event_type) if event_type else events
    return out.orderBy(F.desc("date"), "event_id")


def _contains_any(columns: Sequence[Column], needle: str) -> Column:
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(needle))
    return hit


def global_search(schools: DataFrame, contacts: DataFrame, events: DataFrame, query: str, n: int = 5) -> DataFrame:
    """First n hits per entity of a case-insensitive substring; nothing for a blank query."""
    q = query.lower().strip()
    col = F.col
    who = F.concat_ws(" ", "first_name", "last_name")
    parts = [
        ("school", schools, "school_id", col("name"), [col("name"), col("county"), col("city"), col("district")]),
        ("contact", contacts, "contact_id", who, [who, col("email")]),
        ("event", events, "event_id", col("name"), [col("name"), col("location")]),
    ]
    out = None
    for entity, df, key, label, columns in parts:
        hits = df.filter(_contains_any(columns, q) if q else F.lit(False))
        hits = hits.select(
            F.lit(entity).alias("entity"), col(key).cast("string").alias("id"), label.alias("label"), col(key).alias("_k")
        )
        hits = hits.orderBy("label", "_k").limit(n).drop("_k")
        out = hits if out is None else out.unionByName(hits)
    return out


def table_view(df: DataFrame, search: str, columns: Sequence[str], sort: Column, key: str, page: int = 0, size: int = 25) -> DataFrame:
    """Searched, sorted page of a table; ``key`` breaks ties."""
    needle = search.lower().strip()
    hits = df.filter(_contains_any([F.col(c).cast("string") for c in columns], needle)) if needle else df
    return paginate(hits, [sort, F.col(key)], page, size)


def paginate(df: DataFrame, order: Sequence[Column], page: int, size: int) -> DataFrame:
    """A page of a totally ordered table; see ``slice_of_order`` for deep pages, ``keyset_page`` for runs of pages."""
    return slice_of_order(df, order, page * size, size)


def keyset_page(df: DataFrame, key: str, after, size: int) -> DataFrame:
    """Next page behind a key already seen: the scan is filtered, nothing is skipped over."""
    out = df if after is None else df.filter(F.col(key) > after)
    return out.orderBy(key).limit(size)


def has_county(df: DataFrame) -> DataFrame:
    return df.filter(X.has_text("county"))


def upcoming_events(events: DataFrame, as_of: AsOf, n: int = 6) -> DataFrame:
    return events.filter(F.col("date") > at(as_of)).orderBy("date", "event_id").limit(n)


def past_flag(events: DataFrame, as_of: AsOf) -> DataFrame:
    return events.withColumn("is_past", ~(F.col("date") > at(as_of)))


def filter_high_school_facilities(sheet: DataFrame, width: int = 13) -> DataFrame:
    """Rows whose 13th column names grade 12 and whose 2nd contains the word "sch"."""
    if len(sheet.columns) < width:
        return sheet.limit(0).select()
    type_col, grades = sheet.columns[1], sheet.columns[width - 1]
    quoted = lambda c: F.col(f"`{c}`")
    kept = sheet.filter(
        quoted(grades).rlike(r"(?:^|[^0-9])12(?:[^0-9]|$)") & quoted(type_col).rlike(r"(?i)\bsch\b")
    )
    # Spreadsheet heading to column name.
    kept = kept.withColumnsRenamed(
        {
            "Mailing Address": "MailingAddress",
            "Delivery Address": "DeliveryAddress",
            "NCES ID": "NCES_ID",
            "Region-2\nCounty-3\nDistrict-4": "RegionCountyDistrict",
        }
    )
    if "Affiliation" not in kept.columns:
        kept = kept.withColumn("Affiliation", F.lit(None).cast("string"))
    return kept


def month_calendar(events: DataFrame, month: str) -> DataFrame:
    """Events of a month (``yyyy-MM``) per calendar day, each day present.

    The events stay where they are; only days without any are added, so a day on which most
    events fall is not one task's work.
    """
    spark = events.sparkSession
    first = F.to_date(F.lit(f"{month}-01"))
    days = spark.range(1).select(F.explode(F.sequence(first, F.last_day(first))).alias("day"))
    begin = first.cast("timestamp_ntz")
    in_month = events.filter(
        (F.col("date") >= begin) & (F.col("date") < F.add_months(first, 1).cast("timestamp_ntz"))
    ).withColumn("day", F.to_date("date"))
    empty = days.join(in_month.select("day").distinct(), "day", "left_anti")
    return in_month.select("day", *events.columns).unionByName(empty, allowMissingColumns=True)


def facet_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct().orderBy(column)


def count_unverified(df: DataFrame) -> DataFrame:
    return df.agg(F.count_if(~F.coalesce("is_verified", F.lit(False))).alias("unverified"))


def catalog_search(rules: DataFrame, schools_list: DataFrame, term: str) -> DataFrame:
    """Rules whose school name contains the term, one row per list position of that name.

    ``rules`` (school, alt_urls); ``schools_list`` (name, pos). A name that is not listed
    keeps one row with a null position. Positions stay rows, so a name listed very often
    never has to fit into one value.
    """
    needle = term.strip().lower()
    hits = rules.filter(F.contains(F.lower("school"), F.lit(needle)) if needle else F.lit(False))
    hits = hits.select("school", F.size("alt_urls").alias("n_alt_urls"))
    listed = schools_list.select(F.trim("name").alias("school"), F.col("pos").alias("position"))
    # An inner join can be split where a name is listed very often; a left join could not.
    bare = hits.join(listed.select("school").distinct(), "school", "left_anti")
    return hits.join(listed, "school").unionByName(bare, allowMissingColumns=True)
