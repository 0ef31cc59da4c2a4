"""Import mapping, validation, plausibility checks and quarantine."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canvasser import schema as M
from canvasser.functions import text as X

ERROR, WARNING = "error", "warning"


def auto_map_columns(headers: Sequence[str], entity: str) -> dict[str, str]:
    """Header to field by the synonym list; unknown headers are left out."""
    synonyms = {**M.HEADER_SYNONYMS, "name": "name" if entity == "schools" else "firstName"}
    found = {h: synonyms.get(h.lower().strip()) for h in headers}
    return {h: f for h, f in found.items() if f}


def map_row(rows: DataFrame, mapping: Mapping[str, str], keep: Sequence[str] = ()) -> DataFrame:
    """Mapped columns, trimmed; a later header of the same field wins, others are dropped."""
    source = {field: header for header, field in mapping.items() if header in rows.columns}
    return rows.select(*keep, *[X.strip(F.col(f"`{h}`").cast("string")).alias(f) for f, h in source.items()])


def _issue(when: Column, field: str, message: Column | str, severity: str) -> Column:
    text = message if isinstance(message, Column) else F.lit(message)
    return F.when(
        when,
        F.struct(F.lit(field).alias("field"), text.alias("message"), F.lit(severity).alias("severity")),
    )


def _issues(rows: DataFrame, row: str, checks: Sequence[Column]) -> DataFrame:
    return rows.select(F.col(row).alias("row"), F.inline(F.array_compact(F.array(*checks))))


def _flag(rows: DataFrame, column: str, known: DataFrame, known_column: str, name: str) -> DataFrame:
    """Add whether the lower-cased value occurs among the lower-cased known values."""
    values = known.select(F.lower(known_column).alias("_v"))
    nothing = F.lit(0).cast("bigint")
    seen = values.filter("_v <> ''").distinct().withColumns({"_salt": nothing, name: F.lit(True)})
    # Empty values may be most of all: a salt spreads them, and whether one is known is one number.
    empty = F.coalesce(F.col("_v"), F.lit("")) == ""
    keyed = rows.withColumn("_v", F.lower(column)).withColumn("_salt", F.when(empty, F.xxhash64(*rows.columns)).otherwise(nothing))
    some = values.filter("_v = ''").agg(F.count("*"))
    joined = keyed.join(seen, ["_v", "_salt"], "left")
    known_empty = (F.col("_v") == "") & (some.scalar() > 0)
    return joined.withColumn(name, F.coalesce(F.when(empty, known_empty).otherwise(F.col(name)), F.lit(False))).drop("_v", "_salt")


def validate_contacts(rows: DataFrame, contacts: DataFrame, schools: DataFrame, row: str = "row") -> DataFrame:
    """Issues (row, field, message, severity) of mapped contact rows; only errors drop a row."""
    fields = ["firstName", "lastName", "email", "schoolId"]
    rows = rows.withColumns({c: F.coalesce(c, F.lit("")) for c in fields})
    rows = _flag(rows, "email", contacts, "email", "_dup")
    rows = _flag(rows, "schoolId", schools, "name", "_school")
    empty = lambda c: F.col(c) == ""
    # Fixed texts.
    checks = [
        _issue(empty("firstName"), "firstName", "Missing first name", ERROR),
        _issue(empty("lastName"), "lastName", "Missing last name", ERROR),
        _issue(empty("email"), "email", "Missing email", ERROR),
        _issue(~empty("email") & ~X.is_valid_email("email"), "email", "Invalid email format", ERROR),
        _issue(F.col("_dup"), "email", "Duplicate email (already exists)", WARNING),
        _issue(
            ~empty("schoolId") & ~F.col("_school"),
            "schoolId",
            F.concat(F.lit('School "'), F.col("schoolId"), F.lit('" not found — row will be skipped')),
            ERROR,
        ),
    ]
    return _issues(rows, row, checks)


def validate_schools(rows: DataFrame, schools: DataFrame, row: str = "row") -> DataFrame:
    rows = rows.withColumns({c: F.coalesce(c, F.lit("")) for c in ("name", "county")})
    rows = _flag(rows, "name", schools, "name", "_dup")
    # Fixed texts.
    checks = [
        _issue(F.col("name") == "", "name", "Missing school name", ERROR),
        _issue(F.col("county") == "", "county", "Missing county", ERROR),
        _issue(F.col("_dup"), "name", "School already exists — will be skipped", WARNING),
    ]
    return _issues(rows, row, checks)


def clean_rows(rows: DataFrame, issues: DataFrame, row: str = "row") -> DataFrame:
    """Rows without an error."""
    bad = issues.filter(F.col("severity") == ERROR).select(F.col("row").alias(row)).distinct()
    return rows.join(bad, row, "left_anti")


def duplicate_names(rows: DataFrame, schools: DataFrame) -> DataFrame:
    known = schools.select(F.lower("name").alias("_v")).distinct()
    return rows.withColumn("_v", F.lower("name")).join(known, "_v", "left_semi").drop("_v")


def contact_unlikely_reasons(name: Column, title: Column) -> Column:
    """Array of reasons why a scraped contact is implausible; empty if it is fine."""
    who = F.coalesce(X.strip(name), F.lit(""))
    low = F.lower(who)
    organisation = F.lit(False)
    for word in M.ORGANISATION_WORDS:
        organisation = organisation | low.contains(word)
    letters = F.length(F.regexp_replace(who, r"[^\p{L}]", ""))
    words = F.split(X.strip(F.regexp_replace(who, r"\.", " ")), X.BLANK)
    # Fixed texts.
    named = F.array(
        F.when(letters < 3, "name has too few letters"),
        F.when(who.rlike(r"\p{Nd}"), "name contains digits"),
        F.when(organisation, "name looks like organization text"),
        F.when(F.size(words) > 4, "name has too many tokens"),
    )
    untitled = F.array(F.when(F.coalesce(X.strip(title), F.lit("")) == "", "missing title"))
    reasons = F.when(who == "", F.array(F.lit("name is empty"))).otherwise(named)
    return F.array_compact(F.concat(reasons, untitled))


def school_unlikely_reasons(error: Column, contacts: Column, pages: Column, has_urls: Column) -> Column:
    """Array of reasons for a result record; records that carry an error are skipped.

    ``contacts`` is null where the record holds no list.
    """
    some = F.coalesce(F.array_size(contacts), F.lit(0)) > 0
    paged = F.coalesce(F.array_size(pages), F.lit(0)) > 0
    # Fixed texts.
    reasons = F.array_compact(
        F.array(
            F.when(contacts.isNull(), "contacts is not a list"),
            F.when(some & ~has_urls, "school_urls is missing"),
            F.when(some & has_urls & ~paged, "contacts found but pages_with_contacts is empty"),
        )
    )
    return F.when(X.has_text(error), F.array().cast("array<string>")).otherwise(reasons)


def quarantine(flagged: DataFrame, decisions: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Split rows into (kept, errors) by a decisions table (keys, decision 'keep' or 'error').

    Only flagged rows (non-empty ``reasons``) decided as errors move.
    """
    marks = decisions.filter("decision = 'error'").select(*keys).distinct().withColumn("_moved", F.lit(True))
    joined = flagged.join(marks, list(keys), "left")
    moved = F.col("_moved").isNotNull() & (F.size("reasons") > 0)
    return joined.filter(~moved).drop("_moved"), joined.filter(moved).drop("_moved")


def quarantine_results(schools: DataFrame, contacts: DataFrame, key: Sequence[str], place: str, school_decisions: DataFrame, contact_decisions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Review of whole results: (schools kept, contacts kept, errors).

    Both tables come with ``reasons``; decisions are 'keep' or 'error' by key (contacts by key
    and ``place``). A moved school takes its contacts along. An error has its flag type, the
    addresses and pages of the school, the reasons, and the record (JSON) of what was moved.
    """
    key = list(key)
    kept_schools, moved = quarantine(schools, school_decisions, key)
    rest = contacts.join(moved.select(*key).distinct(), key, "left_anti")
    kept_contacts, flagged = quarantine(rest, contact_decisions, [*key, place])
    where = ["base_url", "alt_url", "pages_with_contacts"]

    def record(df: DataFrame, leave: Sequence[str] = ()) -> Column:
        columns = [c for c in df.columns if c not in ("reasons", *leave)]
        return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("record")

    nowhere = F.lit(None).cast(contacts.schema[place].dataType).alias(place)
    first = moved.select(F.lit("school_result").alias("flag_type"), *key, nowhere, *where, "reasons", record(moved))
    own = flagged.select(*key, place, "reasons", record(flagged, key)).join(schools.select(*key, *where), key, "left")
    second = own.select(F.lit("contact").alias("flag_type"), *key, place, *where, "reasons", "record")
    return kept_schools, kept_contacts, first.unionByName(second)


def _absent(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit("")) == ""


def school_form_errors() -> Column:
    """Fields of a school form that are missing or too short."""
    required = ["name", "county", "address", "city", "state"]
    checks = [F.when(_absent(c), c) for c in required]
    checks.append(F.when(F.length(F.coalesce(F.col("zip_code"), F.lit(""))) < 5, "zip_code"))
    return F.array_compact(F.array(*checks))


def contact_form_errors() -> Column:
    checks = [F.when(_absent(c), c) for c in ("first_name", "last_name")]
    checks.append(F.when(~X.is_valid_email("email"), "email"))
    checks.append(F.when(F.col("school_id").isNull(), "school_id"))
    return F.array_compact(F.array(*checks))


def event_form_errors() -> Column:
    checks = [F.when(_absent(c), c) for c in ("name", "location")]
    checks.append(F.when(F.col("date").isNull(), "date"))
    return F.array_compact(F.array(*checks))


def program_form_errors(categories: Sequence[str] = tuple(M.PROGRAM_CATEGORIES)) -> Column:
    known = F.coalesce(F.col("category").isin(list(categories)), F.lit(False))
    return F.array_compact(F.array(F.when(_absent("name"), "name"), F.when(~known, "category")))
