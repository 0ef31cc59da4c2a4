"""Keyed merges: upserts, imports, patches, deletes and change logs.

All of them are pure functions from tables to tables. Duplicates on the incoming side are
resolved before the join (window group limit), rows without a key never enter it, and both
sides of the join are unique per key, so no key can be hot there.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canvasser import schema as M
from canvasser.functions import text as X
from canvasser.functions.dates import AsOf, at, to_db_date, to_db_time
from canvasser.functions.ordering import (
    first_per_key,
    fold_preferred_website,
    latest_per_key,
    next_in_key,
)
from canvasser.operators.joins import KEY, facility_match_key, with_facility_key


def _complete(keys: Sequence[str]) -> Column:
    ok = F.lit(True)
    for k in keys:
        ok = ok & F.col(k).isNotNull()
    return ok


def merge_upsert(
    target: DataFrame,
    incoming: DataFrame,
    keys: Sequence[str],
    overlay: Sequence[str] | None = None,
    seq: str | None = None,
    defaults: Mapping[str, Column] | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    """New target plus ``_action`` (insert, update, keep).

    A match overlays the ``overlay`` columns (default: every incoming column) and keeps the
    others. An unmatched row is inserted with all its columns; columns it lacks take
    ``defaults`` or null. A row with a null key part always inserts. With ``seq`` the last
    incoming row per key wins; without it the incoming keys must be unique. ``carry`` names
    incoming columns that are added to the result, null where no incoming row came.

    One full outer join: a salt, 0 for complete keys and a hash of the row for others, keeps
    rows without a key apart and spreads them. Both sides are read once.
    """
    keys = list(keys)
    types = {f.name: f.dataType for f in target.schema.fields}
    columns = list(types)
    given = [c for c in incoming.columns if c in types]
    overlay = [c for c in (overlay if overlay is not None else given) if c not in keys]
    defaults = dict(defaults or {})

    def fresh(c: str) -> Column:
        if c in given:
            return F.col(f"_in_{c}")
        return defaults.get(c, F.lit(None)).cast(types[c])

    def salted(df: DataFrame) -> DataFrame:
        content = [f.name for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
        return df.withColumn("_salt", F.when(_complete(keys), F.lit(0).cast("bigint")).otherwise(F.xxhash64(*content)))

    match = [*keys, "_salt"]
    new = salted(incoming)
    if seq:
        new = latest_per_key(new, match, seq)
    new = new.select(*match, *[F.col(c).alias(f"_in_{c}") for c in given if c not in keys], *carry, F.lit(True).alias("_in"))
    joined = salted(target).withColumn("_old", F.lit(True)).join(new, match, "full_outer")
    is_new, is_hit = F.col("_old").isNull(), F.col("_in").isNotNull()

    def merged(c: str) -> Column:
        if c in keys:
            return F.col(c)
        value = F.when(is_new, fresh(c))
        if c in overlay:
            value = value.when(is_hit, F.col(f"_in_{c}"))
        return value.otherwise(F.col(c)).cast(types[c]).alias(c)

    action = F.when(is_new, "insert").when(is_hit, "update").otherwise("keep")
    return joined.select(*[merged(c) for c in columns], action.alias("_action"), *carry)


def change_counts(merged: DataFrame, table: str) -> DataFrame:
    """Rows per action of a merge result."""
    return merged.groupBy(F.lit(table).alias("table"), F.col("_action").alias("action")).agg(F.count("*").alias("rows"))


ACTIONS = ("insert", "update", "keep", "duplicate_in_batch")


def write_counted(merged: DataFrame, path: str, table: str) -> list[tuple[str, str, int]]:
    """Write a merge result and return (table, action, rows) of it, counted while it is written.

    The merge is evaluated once. Beside the actions, ``unique_incoming`` is the rows that came in
    with the batch, less repeats.
    """
    counts = Observation(f"load of {table}")
    seen = merged.observe(counts, *[F.count_if(F.col("_action") == a).alias(a) for a in ACTIONS])
    seen.drop("_action").write.parquet(path)
    found = [(table, a, int(counts.get[a])) for a in ACTIONS]
    came = sum(n for _, a, n in found if a in ("insert", "update"))
    return [(t, a, n) for t, a, n in [*found, (table, "unique_incoming", came)] if n]


# --- spreadsheet import -------------------------------------------------------------------


def _import_match(target: DataFrame, rows: DataFrame, value: str, row_id: str, seq: str) -> tuple[DataFrame, DataFrame]:
    """First row per lower-cased value with the id of the existing row, and the repeats."""
    rows = rows.withColumn("_m", F.lower(value))
    usable = rows.filter(X.has_text("_m"))
    first = first_per_key(usable, ["_m"], seq)
    repeats = usable.join(first.select(seq), seq, "left_anti")
    known = target.select(F.lower(value).alias("_m"), row_id).filter(X.has_text("_m"))
    known = latest_per_key(known, ["_m"], row_id)
    return first.join(known, "_m", "left"), repeats


def import_schools(target: DataFrame, rows: DataFrame, new_key: Column | None = None) -> DataFrame:
    """Import schools matched by lower-cased name; ``_action`` also reports repeats in the batch.

    ``rows`` (name, county, address, city, zip_code, school_type, seq); the first of equal
    names counts. Existing rows keep name, verification, notes and tier.
    """
    matched, repeats = _import_match(target, rows, "name", "facility_key", "seq")
    matched = matched.select(
        "facility_key", "name",
        F.col("county").alias("county_name"), "address", "city", F.col("zip_code").alias("zipcode"),
        X.format_school_type("school_type").alias("type_of_school"),
        F.lit("imported").alias("data_source"),
    )
    merged = merge_upsert(
        target, matched, ["facility_key"],
        overlay=["county_name", "address", "city", "zipcode", "type_of_school", "data_source"],
        defaults={"is_active": F.lit(True), "is_verified": F.lit(False), "priority_tier": F.lit("standard")},
    )
    # Names are unique by now, so their hash is; it is the same whenever a task is repeated.
    made = new_key if new_key is not None else F.concat(F.lit("imported|"), F.md5(F.lower("name")))
    merged = merged.withColumn("facility_key", F.coalesce("facility_key", made.cast("string")))
    extra = repeats.select("name").withColumn("_action", F.lit("duplicate_in_batch"))
    return merged.unionByName(extra, allowMissingColumns=True)


@dataclass
class ContactImport:
    staff: DataFrame
    junction: DataFrame


def import_contacts(staff: DataFrame, junction: DataFrame, rows: DataFrame) -> ContactImport:
    """Import contacts matched by lower-cased e-mail, and link them to their school.

    ``rows`` (first_name, last_name, email, phone, role, school_id, seq). New ids continue
    behind the highest existing one by ``seq``, so a recomputed task makes the same ids.
    Rows without an e-mail always insert. Links are added where absent.
    """
    matched, repeats = _import_match(staff, rows, "email", "staff_id", "seq")
    blank = rows.filter(~X.has_text("email")).withColumn("staff_id", F.lit(None).cast("bigint"))
    highest = staff.agg(F.coalesce(F.max("staff_id"), F.lit(0)).alias("m"))
    ready = matched.drop("_m").unionByName(blank)
    known = F.col("staff_id").isNotNull()
    ready = ready.withColumn("_known", known).withColumn(
        "staff_id", F.when(known, F.col("staff_id")).otherwise(F.col("seq") + 1 + highest.scalar()).cast("bigint")
    )
    changes = ready.select(
        "staff_id", X.full_name("first_name", "last_name").alias("name"),
        F.nullif("email", F.lit("")).alias("email"), "phone",
        F.col("role").alias("job_name"), F.col("school_id").alias("school_worked_at"),
        F.lit(True).alias("is_active"), F.lit("imported").alias("data_source"),
    )
    merged = merge_upsert(
        staff, changes, ["staff_id"],
        overlay=["name", "phone", "job_name", "school_worked_at", "is_active", "data_source"],
        defaults={"is_verified": F.lit(False)},
    )
    extra = repeats.select("email").withColumn("_action", F.lit("duplicate_in_batch"))
    links = ready.filter(X.has_text("school_id")).select("school_id", "staff_id").distinct()
    fresh = links.join(junction.select("school_id", "staff_id").distinct(), ["school_id", "staff_id"], "left_anti")
    return ContactImport(
        merged.unionByName(extra, allowMissingColumns=True),
        junction.select("school_id", "staff_id").unionByName(fresh),
    )


# --- pipeline loads -----------------------------------------------------------------------


def facility_rows(schools_list: DataFrame, districts: DataFrame | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """School rows of a listed file, last row per normalised key; rows without a key are dropped."""
    county = X.clean_text("County")
    rows = with_facility_key(schools_list).withColumn("facility_key", F.col(KEY))
    rows = latest_per_key(rows, ["facility_key"], "seq").select(
        "facility_key",
        F.coalesce(X.clean_text("FacilityName"), F.lit("Unknown School")).alias("name"),
        X.clean_text("Telephone").alias("phone_number"),
        X.clean_text("Administrator").alias("admin"),
        X.clean_text("City").alias("city"),
        X.clean_text("Zip").alias("zipcode"),
        X.clean_text("Website").alias("website"),
        F.when(county.isNotNull(), X.letter_title(X.normalize_text("County"))).alias("county_name"),
        *[F.lit(None).cast("string").alias(c) for c in ("address", "type_of_school", "grades_served")],
    )
    for lookup, column in ((districts, "district_id"), (sizes, "class_size")):
        if lookup is None:
            rows = rows.withColumn(column, F.lit(None).cast("int"))
        else:
            rows = rows.join(lookup.select("facility_key", column), "facility_key", "left")
    return rows


def upsert_facilities(target: DataFrame, schools_list: DataFrame, districts: DataFrame | None = None, sizes: DataFrame | None = None) -> DataFrame:
    return merge_upsert(target, facility_rows(schools_list, districts, sizes), ["facility_key"])


def _kept_contacts(limit: int = 2) -> Column:
    """The first two slots of a directory entry that carry a name, in slot order."""
    people = [
        F.struct(
            F.lit(slot).alias("slot"),
            X.clean_text(F.col("contacts")[slot]["name"]).alias("name"),
            X.clean_text(F.col("contacts")[slot]["title"]).alias("job_name"),
        )
        for slot in M.DIRECTORY_SLOTS[:limit]
    ]
    return F.filter(F.array(*people), lambda p: p["name"].isNotNull())


def city_school_rows(directory: DataFrame, seq: str = "seq") -> DataFrame:
    """Directory entries as school rows, last entry per key."""
    rows = directory.withColumn("name", X.clean_text("name")).filter("name is not null")
    rows = rows.withColumn("facility_key", X.city_school_key("name"))
    return latest_per_key(rows, ["facility_key"], seq).select(
        "facility_key", "name",
        X.clean_text("phone").alias("phone_number"),
        X.clean_text("website").alias("website"),
        F.get(_kept_contacts(), F.lit(0))["name"].alias("admin"),
        *[F.lit(None).cast("string").alias(c) for c in ("city", "zipcode", "county_name", "address")],
    )


def upsert_city_schools(target: DataFrame, directory: DataFrame, seq: str = "seq") -> DataFrame:
    return merge_upsert(target, city_school_rows(directory, seq), ["facility_key"])


def contact_rank(directory: DataFrame) -> DataFrame:
    """The kept contacts of each directory school with their 1-based rank as text."""
    rows = directory.withColumn("name", X.clean_text("name")).filter("name is not null")
    rows = rows.select(
        F.col("name").alias("school_name"), X.city_school_key("name").alias("facility_key"),
        X.clean_text("phone").alias("phone"), X.clean_text("website").alias("website"),
        F.posexplode(_kept_contacts()).alias("_i", "p"),
    )
    return rows.select(
        "school_name", "facility_key", (F.col("_i") + 1).cast("string").alias("contact_rank"),
        F.col("p.name").alias("contact_name"), F.col("p.job_name").alias("job_name"), "phone", "website",
    )


STAFF_KEY = ["name", "email", "job_name", "school_worked_at"]


def _staff_key(df: DataFrame) -> DataFrame:
    return df.withColumns({f"_k_{c}": X.normalize_text(c) for c in STAFF_KEY})


_SALTS = 64


def upsert_staff(staff: DataFrame, incoming: DataFrame, seq: Sequence[str], reset_verification: bool = False) -> DataFrame:
    """Merge staff on the normalised (name, email, job, school); the last incoming row wins.

    A row found takes over the existing id (the highest, should several share a key), others
    insert with a null id for the table to number. ``reset_verification`` clears the verified
    flag and date of rows whose phone changed.

    The target is read once. Of the stored rows of a key only the one of the highest id can
    change, and it is found in two steps: the highest in each of ``_SALTS`` parts of the key,
    then among those. Rows that are not the highest of their part go on in partitions of their
    own, so neither step gathers a hot key in one task.
    """
    keys = [f"_k_{c}" for c in STAFF_KEY]
    types = {f.name: f.dataType for f in staff.schema.fields}
    overlay = [c for c in ("phone", *STAFF_KEY) if c in types]
    unique = latest_per_key(_staff_key(incoming), keys, *seq)
    new = unique.select(*keys, F.lit(0).cast("bigint").alias("_salt"), F.struct(*[F.col(c).cast(types[c]).alias(c) for c in overlay]).alias("_in"), F.lit(True).alias("_new"))

    part = F.pmod(F.xxhash64("staff_id"), F.lit(_SALTS))
    old = _staff_key(staff).withColumn("_salt", part)
    highest = F.rank().over(W.partitionBy(*keys, "_salt").orderBy(F.desc_nulls_last("staff_id"))) == 1
    may_change = highest & F.col("staff_id").isNotNull() & _complete(keys)
    old = old.withColumn("_salt", F.when(may_change, F.lit(0).cast("bigint")).otherwise(1 + F.pmod(F.xxhash64("staff_id", *overlay), F.lit(2**40))))

    key = W.partitionBy(*keys, "_salt")
    both = old.withColumn("_new", F.lit(False)).unionByName(new, allowMissingColumns=True)
    both = both.withColumns({"_best": F.max("staff_id").over(key), "_row": F.max("_in").over(key)})
    is_new = F.col("_new")
    hit = ~is_new & (F.col("_salt") == 0) & F.coalesce(F.col("staff_id") == F.col("_best"), F.lit(False)) & F.col("_row").isNotNull()
    rows = both.filter(~is_new | F.col("_best").isNull())
    changed = hit & ~F.col("_row")["phone"].eqNullSafe(F.col("phone")) if "phone" in overlay else F.lit(False)
    reset = {"is_verified": F.lit(False), "last_verified_at": F.lit(None)} if reset_verification else {}

    def value(c: str) -> Column:
        if c in overlay:
            return F.when(hit | is_new, F.col("_row")[c]).otherwise(F.col(c))
        return F.when(changed, reset[c]).otherwise(F.col(c)) if c in reset else F.col(c)

    action = F.when(is_new, "insert").when(hit, "update").otherwise("keep")
    return rows.select(*[value(c).alias(c) for c in types], action.alias("_action"))


def city_staff_rows(directory: DataFrame, seq: str = "seq") -> DataFrame:
    """Kept directory contacts as staff rows: school phone, no e-mail."""
    rows = directory.withColumn("name", X.clean_text("name")).filter("name is not null")
    rows = rows.select(
        X.city_school_key("name").alias("school_worked_at"), X.clean_text("phone").alias("phone"),
        F.col(seq).alias("seq"), F.posexplode(_kept_contacts()).alias("pos", "p"),
    )
    return rows.select(
        F.col("p.name").alias("name"), "phone", F.lit(None).cast("string").alias("email"),
        F.col("p.job_name").alias("job_name"), "school_worked_at", "seq", "pos",
    )


def county_rows(schools_list: DataFrame) -> DataFrame:
    """Distinct normalised counties in title case; blank ones dropped."""
    rows = schools_list.select(X.normalize_text("County").alias("_c")).filter("_c <> ''").distinct()
    return rows.select(X.letter_title("_c").alias("county_name"))


def upsert_counties(target: DataFrame, schools_list: DataFrame) -> DataFrame:
    return merge_upsert(target, county_rows(schools_list).distinct(), ["county_name"])


def upsert_by_optional_id(target: DataFrame, rows: DataFrame, row_id: str, seq: str) -> DataFrame:
    """Rows with a usable whole-number id are merged on it, the others appended."""
    typed = rows.withColumn(row_id, X.safe_int(row_id))
    return merge_upsert(target, typed, [row_id], seq=seq)


# --- list files ---------------------------------------------------------------------------


def merge_school_list(existing: DataFrame, incoming: DataFrame, fields: Sequence[str], seq: str = "seq") -> DataFrame:
    """Merge lists by trimmed lower-case (FacilityName, City).

    Of equal existing rows the first stays. Every incoming row overlays the fields it has
    (null means absent, blank counts). Per field that is the last value present, so each one
    is a single aggregate over the key and no list of rows is built. ``_action`` tells
    inserted from updated and kept rows; ``_incoming`` counts the incoming rows of a key.
    """
    def keyed(df: DataFrame, source: int) -> DataFrame:
        return df.withColumns(
            {
                "_name": F.lower(X.strip(F.coalesce("FacilityName", F.lit("")))),
                "_city": F.lower(X.strip(F.coalesce("City", F.lit("")))),
                "_src": F.lit(source),
            }
        )

    keys = ["_name", "_city"]
    base = first_per_key(keyed(existing, 0), keys, seq)
    rows = base.unionByName(keyed(incoming, 1))
    at_ = F.struct("_src", seq)
    merged = rows.groupBy(*keys).agg(
        *[F.max_by(f, F.when(F.col(f).isNotNull(), at_)).alias(f) for f in fields],
        F.min("_src").alias("_first"),
        F.sum("_src").alias("_incoming"),
    )
    action = F.when(F.col("_first") == 1, "insert").when(F.col("_incoming") > 0, "update").otherwise("keep")
    return merged.withColumn("_action", action).drop("_first")


def merge_school_list_counts(merged: DataFrame) -> DataFrame:
    """inserted, updated, total; a later new row of the same key counts as an update."""
    new = F.col("_action") == "insert"
    return merged.agg(
        F.count_if(new).alias("inserted"),
        (F.coalesce(F.sum("_incoming"), F.lit(0)) - F.count_if(new)).alias("updated"),
        F.count("*").alias("total"),
    )


def _dedupe_sites(rows: DataFrame, keys: list[str], seq: str, site: str) -> DataFrame:
    first = first_per_key(rows, keys, seq).drop(site)
    kept = fold_preferred_website(rows, keys, seq, site, site)
    out = first.join(kept, keys, "left")
    return out.withColumn(site, F.coalesce(site, F.lit("")))


def dedupe_facilities(rows: DataFrame, seq: str = "seq") -> DataFrame:
    """First row per spelled-out (name, city), with the preferred website of all its rows."""
    keyed = rows.select("*", *facility_match_key())
    return _dedupe_sites(keyed, ["name_key", "city_key"], seq, "Website")


def dedupe_url_rows(rows: DataFrame, seq: str = "seq") -> DataFrame:
    """First row per squeezed lower-case (School Name, City), with the preferred homepage."""
    names = {"School Name": "school_name", "City": "city", "Homepage": "homepage"}
    rows = rows.withColumnsRenamed(names)
    clean = rows.withColumns({c: F.coalesce(X.strip(c), F.lit("")) for c in names.values()})
    clean = clean.filter("school_name <> '' or city <> '' or homepage <> ''")
    keyed = clean.withColumns({"name_key": X.normalize_text("school_name"), "city_key": X.normalize_text("city")})
    return _dedupe_sites(keyed, ["name_key", "city_key"], seq, "homepage")


CONTACT_IDENTITY = ["name", "title", "dept", "phone", "email"]


def dedupe_contacts(rows: DataFrame, scope: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First record per normalised contact inside each scope (page or school)."""
    parts = {
        f"_k_{c}": F.coalesce(X.strip(c) if c == "phone" else F.lower(X.strip(c)), F.lit("")) for c in CONTACT_IDENTITY
    }
    keyed = rows.withColumns(parts)
    return first_per_key(keyed, [*scope, *parts], *order).drop(*parts)


# --- edits --------------------------------------------------------------------------------


@dataclass
class SchoolTables:
    schools: DataFrame
    staff: DataFrame
    junction: DataFrame
    deleted_staff: DataFrame


def cascade_delete_school(schools: DataFrame, staff: DataFrame, junction: DataFrame, doomed: DataFrame) -> SchoolTables:
    """Delete the schools listed in ``doomed`` (school_id) with their staff and links."""
    ids = doomed.select("school_id").distinct()
    by_inline = ids.withColumnRenamed("school_id", "school_worked_at")
    gone = staff.join(by_inline, "school_worked_at", "left_semi").select("staff_id")
    links = junction.join(gone, "staff_id", "left_anti").join(ids, "school_id", "left_anti")
    by_key = ids.withColumnRenamed("school_id", "facility_key")
    return SchoolTables(
        schools.join(by_key, "facility_key", "left_anti").select(*schools.columns),
        staff.join(gone, "staff_id", "left_anti").select(*staff.columns),
        links.select(*junction.columns),
        gone,
    )


def delete_contacts(staff: DataFrame, junction: DataFrame, doomed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Staff and links without the contacts listed in ``doomed`` (staff_id); unknown ids change nothing."""
    ids = doomed.select("staff_id").distinct()
    return tuple(df.join(ids, "staff_id", "left_anti").select(*df.columns) for df in (staff, junction))


def mark_verified(target: DataFrame, ids: DataFrame, key: str, as_of: AsOf) -> DataFrame:
    """Set the verified flag and date of the rows listed in ``ids`` (key)."""
    marks = ids.select(key).distinct().withColumn("_mark", F.lit(True))
    joined = target.join(marks, key, "left")
    hit = F.col("_mark").isNotNull()
    return joined.withColumns(
        {
            "is_verified": hit | F.coalesce("is_verified", F.lit(False)),
            "last_verified_at": F.when(hit, at(as_of)).otherwise(F.col("last_verified_at")),
        }
    ).select(*target.columns)


def patch_rows(target: DataFrame, patches: DataFrame, key: str, fields: Sequence[str], seq: str = "seq") -> DataFrame:
    """Partial updates: only fields named in ``provided`` (array) change, also to null.

    Several patches of a row fold per field: the last one providing it counts.
    """
    named = lambda f: F.array_contains("provided", f)
    last = patches.groupBy(key).agg(
        *[F.max_by(F.struct(F.col(f).alias("v")), F.when(named(f), F.col(seq))).alias(f"_p_{f}") for f in fields]
    )
    joined = target.join(last, key, "left")
    changed = {
        f: F.when(F.col(f"_p_{f}").isNotNull(), F.col(f"_p_{f}.v")).otherwise(F.col(f)) for f in fields
    }
    return joined.withColumns(changed).select(*target.columns)


def patch_contacts(staff: DataFrame, junction: DataFrame, patches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Patch staff by parts of the name and other fields; a new school replaces all links.

    ``patches`` (staff_id, first_name, last_name, email, school_id, provided, seq).
    """
    split = staff.withColumn("_n", X.split_name("name"))
    split = split.withColumns(
        {"first_name": F.col("_n.first"), "last_name": F.col("_n.last"), "school_id": F.col("school_worked_at")}
    ).drop("_n")
    fields = ["first_name", "last_name", "email", "school_id"]
    done = patch_rows(split, patches, "staff_id", fields)
    touched = patches.groupBy("staff_id").agg(
        F.max(F.array_contains("provided", "first_name") | F.array_contains("provided", "last_name")).alias("_name"),
        F.max(F.array_contains("provided", "school_id")).alias("_school"),
    )
    done = done.join(touched, "staff_id", "left")
    renamed = F.when(F.col("_name"), X.full_name("first_name", "last_name")).otherwise(F.col("name"))
    out = done.withColumns({"name": renamed, "school_worked_at": F.col("school_id")})
    moved = out.filter("_school").select("school_id", "staff_id")
    links = junction.join(moved.select("staff_id"), "staff_id", "left_anti").select("school_id", "staff_id")
    return out.select(*staff.columns), links.unionByName(moved)


def append_rows(target: DataFrame, rows: DataFrame, defaults: Mapping[str, Column] | None = None) -> DataFrame:
    """Append rows, absent columns taking their default or null."""
    given = {c: v for c, v in (defaults or {}).items() if c not in rows.columns}
    filled = {c: F.coalesce(F.col(c), v) for c, v in (defaults or {}).items() if c in rows.columns}
    return target.unionByName(rows.withColumns({**given, **filled}), allowMissingColumns=True)


def append_contacts(staff: DataFrame, junction: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Create contacts; only those with a school get a link row. ``rows`` carry their new ids."""
    new = rows.select(
        "staff_id", X.full_name("first_name", "last_name").alias("name"), "email", "phone",
        F.col("role").alias("job_name"), F.col("school_id").alias("school_worked_at"),
        F.coalesce("is_active", F.lit(True)).alias("is_active"), F.lit("manual").alias("data_source"),
    )
    links = rows.filter(X.has_text("school_id")).select("school_id", "staff_id")
    return append_rows(staff, new), junction.select("school_id", "staff_id").unionByName(links)


def calendar_events(records: DataFrame) -> DataFrame:
    """Flat (external_id, name, city, date, start_time, end_time, note) rows of calendar records."""
    when = "field_1_raw"
    return records.select(
        F.col("id").alias("external_id"),
        F.col("field_2").alias("name"),
        F.col("field_3").alias("city"),
        to_db_date(F.col(f"{when}.date")).alias("date"),
        to_db_time(F.col(f"{when}.time_formatted")).alias("start_time"),
        to_db_time(F.col(f"{when}.to.time_formatted")).alias("end_time"),
        F.col("field_38").alias("note"),
    )


def upsert_calendar_events(target: DataFrame, records: DataFrame, seq: str = "seq") -> DataFrame:
    return merge_upsert(target, latest_per_key_records(records, seq), ["external_id"])


def latest_per_key_records(records: DataFrame, seq: str) -> DataFrame:
    """Last record per id, flattened; records without an id all stay."""
    named = latest_per_key(records.filter("id is not null"), ["id"], seq)
    return calendar_events(named.unionByName(records.filter("id is null")))


# --- action log ---------------------------------------------------------------------------


def apply_changes(base: DataFrame, changes: DataFrame, key: str, verify: bool = True) -> DataFrame:
    """Table after an ordered action log.

    ``changes`` (seq, op, key, payload struct of the table's other columns, at). ADD puts a
    row, UPDATE replaces a row that is there, DELETE removes it, VERIFY marks a row that is
    there, SET clears the table (its rows follow as ADD with higher numbers). The state of a
    key needs only the last number of each kind and the last payload, so the log is one
    partial aggregate per key, whatever the number of actions on it.
    """
    others = [c for c in base.columns if c != key]
    last_set = changes.agg(F.max(F.when(F.col("op") == "SET", F.col("seq"))).alias("s"))
    cleared = last_set.scalar()
    live = changes.filter(F.col("op") != "SET").filter(cleared.isNull() | (F.col("seq") > cleared))
    start = base.filter(cleared.isNull())

    def last(*ops: str) -> Column:
        return F.max(F.when(F.col("op").isin(*ops), F.col("seq")))

    is_content, is_verify = F.col("op").isin("ADD", "UPDATE"), F.col("op") == "VERIFY"
    state = live.groupBy(key).agg(
        last("ADD").alias("_add"),
        last("DELETE").alias("_del"),
        last("ADD", "UPDATE").alias("_content"),
        last("VERIFY").alias("_verify"),
        F.max_by("payload", F.when(is_content, F.col("seq"))).alias("_row"),
        F.max_by("at", F.when(is_verify, F.col("seq"))).alias("_at"),
    )
    before = start.select(key, F.struct(*others).alias("_base"))
    joined = before.join(state, key, "full_outer")
    none = F.lit(-1)
    add, gone = F.coalesce("_add", none), F.coalesce("_del", none)
    there = F.when((add < 0) & (gone < 0), F.col("_base").isNotNull()).otherwise(add > gone)
    kept = joined.filter(there)
    # Content written before the last delete was removed with it: an ADD follows it here.
    row = F.coalesce("_row", "_base")
    out = kept.select(key, *[row[c].alias(c) for c in others], "_verify", "_content", "_at")
    if verify and "is_verified" in others:
        marked = F.coalesce(F.col("_verify") > F.coalesce("_content", none), F.lit(False))
        stamp = {c: F.when(marked, F.col("_at")).otherwise(F.col(c)) for c in ("last_verified_at", "updated_at") if c in others}
        out = out.withColumns({"is_verified": marked | F.col("is_verified"), **stamp})
    return out.select(*base.columns)


def cascade_changes(base: DataFrame, changes: DataFrame, key: str, parent: str, parent_deletes: DataFrame) -> DataFrame:
    """DELETE rows for children whose parent is deleted while they belong to it.

    ``parent_deletes`` (parent, seq). Every version of a child is valid from its own number to
    the next one of the same child; a delete of its parent in between removes it.
    """
    written = changes.filter(F.col("op").isin("ADD", "UPDATE", "DELETE")).select(
        key,
        F.col("seq").cast("bigint").alias("seq"),
        F.when(F.col("op") != "DELETE", F.col(f"payload.{parent}")).alias("_parent"),
    )
    written = next_in_key(written, [key], "seq", "_next")
    # Stored children: the first delete of their parent, if nothing was written before it.
    first_write = written.groupBy(key).agg(F.min("seq").alias("_next"))
    first_cut = parent_deletes.groupBy(F.col(parent).alias("_parent")).agg(F.min("seq").alias("_cut_seq"))
    stored = base.select(key, F.col(parent).alias("_parent")).join(first_cut, "_parent").join(first_write, key, "left")
    # Logged versions: the next delete of their parent behind them, as numbers of one sequence.
    cuts = parent_deletes.select(
        F.lit(None).cast(base.schema[key].dataType).alias(key),
        F.col("seq").cast("bigint").alias("seq"),
        F.col(parent).alias("_parent"),
        F.lit(None).cast("bigint").alias("_next"),
        F.lit(True).alias("_is_cut"),
    )
    line = written.filter("_parent is not null").withColumn("_is_cut", F.lit(False)).unionByName(cuts)
    line = next_in_key(line, ["_parent"], "seq", "_cut_seq", marked=F.col("_is_cut"))
    logged = line.filter("not _is_cut and _cut_seq is not null")
    hit = stored.select(key, "_cut_seq", "_next").unionByName(logged.select(key, "_cut_seq", "_next"))
    hit = hit.filter("_next is null or _cut_seq < _next")
    return hit.select(key, F.col("_cut_seq").alias("seq")).distinct()


def apply_school_changes(
    schools: DataFrame, contacts: DataFrame, school_log: DataFrame, contact_log: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Schools and contacts after their action logs; deleting a school deletes its contacts.

    Both logs share one numbering. Keys are ``school_id`` and ``contact_id``; contacts (and
    their payloads) carry the ``school_id`` they belong to.
    """
    cuts = school_log.filter("op = 'DELETE'").select("school_id", "seq")
    gone = cascade_changes(contacts, contact_log, "contact_id", "school_id", cuts)
    payload = F.lit(None).cast(contact_log.schema["payload"].dataType)
    removed = gone.select("seq", F.lit("DELETE").alias("op"), "contact_id", payload.alias("payload"), F.lit(None).cast("timestamp_ntz").alias("at"))
    return (
        apply_changes(schools, school_log, "school_id"),
        apply_changes(contacts, contact_log.select(*removed.columns).unionByName(removed), "contact_id"),
    )
