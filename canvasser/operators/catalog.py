"""Set operations and merges over keyed lists, result maps and site rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvasser.functions import text as X
from canvasser.functions.ordering import latest_per_key


def _keyed(df: DataFrame, key: str, seq: str) -> DataFrame:
    """Last row per trimmed lower-case key, remembering the first position of the key."""
    rows = df.withColumn("_key", F.lower(X.strip(F.col(key).cast("string")))).filter("_key <> ''")
    best = rows.groupBy("_key").agg(F.max_by(F.struct(*df.columns), seq).alias("_row"), F.min(seq).alias("_pos"))
    return best.select("_key", "_row.*", "_pos")


def keyed_union(a: DataFrame, b: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """Keys of both lists; on shared keys A's row. ``_src`` and ``_pos`` give the list order."""
    left, right = _keyed(a, key, seq), _keyed(b, key, seq)
    extra = right.join(left.select("_key"), "_key", "left_anti")
    return left.withColumn("_src", F.lit(0)).unionByName(extra.withColumn("_src", F.lit(1)))


def keyed_intersect(a: DataFrame, b: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    return _keyed(a, key, seq).join(_keyed(b, key, seq).select("_key"), "_key", "left_semi")


def keyed_difference(a: DataFrame, b: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    return _keyed(a, key, seq).join(_keyed(b, key, seq).select("_key"), "_key", "left_anti")


def row_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Without a key the whole row is the key."""
    return a.unionByName(b).distinct()


def row_intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def row_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def map_union(a: DataFrame, b: DataFrame, key: str = "key") -> DataFrame:
    """Entries of both maps; on shared keys B's value (the opposite of the list form)."""
    return b.unionByName(a.join(b.select(key), key, "left_anti"))


def map_intersect(a: DataFrame, b: DataFrame, key: str = "key") -> DataFrame:
    return a.join(b.select(key), key, "left_semi").orderBy(key)


def map_difference(a: DataFrame, b: DataFrame, key: str = "key") -> DataFrame:
    return a.join(b.select(key), key, "left_anti").orderBy(key)


def build_facilities(rows: DataFrame, int_columns: tuple[str, ...] = ()) -> DataFrame:
    """Add ``FacilityKey`` (a null part reads "None") and cast the given columns to whole numbers."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in ("CountyName", "FacilityName", "City", "Zip")]
    whole = lambda c: F.when(~F.contains(F.col(c).cast("string"), F.lit("_")), X.number(c)).try_cast("bigint")
    numbers = {c: whole(c) for c in int_columns if c in rows.columns}
    return rows.withColumns({"FacilityKey": F.concat_ws("|", *parts), **numbers})


def combine_results(still_working: DataFrame, completed: DataFrame) -> DataFrame:
    """Result maps combined, completed entries replacing the others (one row per school each)."""
    return map_union(still_working, completed, "school_name")


def with_counts(results: DataFrame) -> DataFrame:
    """Add ``n_contacts`` and ``n_pages`` of the arrays, 0 for null."""
    size = lambda c: F.coalesce(F.array_size(c), F.lit(0))
    return results.withColumns({"n_contacts": size("contacts"), "n_pages": size("pages_with_contacts")})


def scrape_coverage(combined: DataFrame) -> DataFrame:
    """Totals of a combined result table."""
    missing = F.coalesce(F.col("error") == "missing website", F.lit(False))
    rows = with_counts(combined)
    return rows.agg(
        F.count("*").alias("total"),
        F.count_if(missing).alias("missing_website"),
        F.count_if(~missing & (F.col("n_contacts") == 0)).alias("no_contacts"),
        F.count_if(~missing & (F.col("n_contacts") > 0)).alias("with_contacts"),
    )


def list_classification(combined: DataFrame) -> DataFrame:
    rows = with_counts(combined)
    return rows.withColumns(
        {
            "no_contacts": F.col("n_contacts") == 0,
            "with_contacts": F.col("n_contacts") > 0,
            "no_staff_page": F.col("n_pages") == 0,
        }
    )


def merge_catalog(rules: DataFrame, still_working: DataFrame, completed: DataFrame, ordered: bool = True) -> DataFrame:
    """One row per school name over rules, unfinished and finished results.

    Later sources overlay non-empty fields; the spelling of the name comes from the first.
    """
    empty_pages = F.array().cast("array<string>")
    rule_rows = rules.select(
        F.col("school").alias("school_name"),
        F.lit(None).cast("string").alias("base_url"),
        F.get(X.normalize_urls("alt_urls"), F.lit(0)).alias("alt_url"),
        empty_pages.alias("pages_with_contacts"),
        F.lit(0).alias("n_contacts"),
        F.lit(None).cast("string").alias("error"),
        F.lit(0).alias("_prio"),
        F.col("school").alias("_ord"),
    )

    def results(df: DataFrame, prio: int) -> DataFrame:
        return with_counts(df).select(
            "school_name", "base_url", "alt_url",
            F.coalesce("pages_with_contacts", empty_pages).alias("pages_with_contacts"),
            "n_contacts", "error", F.lit(prio).alias("_prio"), F.col("school_name").alias("_ord"),
        )

    rows = rule_rows.unionByName(results(still_working, 1)).unionByName(results(completed, 2))
    rows = rows.withColumn("_key", F.lower(X.strip("school_name"))).filter("_key <> ''")
    rank = F.struct("_prio", "_ord")

    def last(value: F.Column, usable: F.Column) -> F.Column:
        return F.max_by(value, F.when(usable, rank))

    filled = lambda c: X.has_text(c)
    merged = rows.groupBy("_key").agg(
        F.min_by("school_name", rank).alias("school_name"),
        last(F.col("base_url"), filled("base_url")).alias("base_url"),
        last(F.col("alt_url"), filled("alt_url")).alias("alt_url"),
        last(F.col("pages_with_contacts"), F.size("pages_with_contacts") > 0).alias("pages_with_contacts"),
        last(F.col("n_contacts"), F.col("n_contacts") > 0).alias("n_contacts"),
        last(F.col("error"), filled("error")).alias("error"),
    )
    merged = merged.withColumns(
        {
            "pages_with_contacts": F.coalesce("pages_with_contacts", empty_pages),
            "n_contacts": F.coalesce("n_contacts", F.lit(0)),
        }
    )
    return (merged.orderBy("_key") if ordered else merged).drop("_key")


def export_lists(rules: DataFrame, still_working: DataFrame, completed: DataFrame) -> DataFrame:
    """The five lists as rows: list_type, school_name, base_url, alt_url, pages_with_contacts, n_contacts, error."""
    combined = list_classification(combine_results(still_working, completed))
    flags = F.array_compact(
        F.array(
            F.when(F.col("no_contacts"), F.lit("schools_with_no_results")),
            F.when(F.col("with_contacts"), F.lit("schools_with_results")),
            F.when(F.col("no_staff_page"), F.lit("schools_with_no_staff_page")),
        )
    )
    no_pages, nothing = F.array().cast("array<string>"), F.lit(None).cast("string")
    fields = ["base_url", "alt_url", F.coalesce("pages_with_contacts", no_pages).alias("pages_with_contacts"), F.col("n_contacts").cast("int").alias("n_contacts"), "error"]
    lists = combined.select(F.explode(flags).alias("list_type"), "school_name", *fields)
    bare = rules.filter(F.coalesce(F.array_size("alt_urls"), F.lit(0)) == 0)
    bare = bare.select(
        F.lit("schools_with_empty_alt_urls").alias("list_type"), F.col("school").alias("school_name"), nothing.alias("base_url"),
        nothing.alias("alt_url"), no_pages.alias("pages_with_contacts"), F.lit(0).alias("n_contacts"), nothing.alias("error"),
    )
    names = merge_catalog(rules, still_working, completed, ordered=False)
    names = names.select(F.lit("all_school_names").alias("list_type"), "school_name", *fields)
    return lists.unionByName(bare).unionByName(names)


_OBJECT, _LIST = "map<string,string>", "array<string>"  # nested values stay JSON text


def _item_name(item: F.Column) -> F.Column:
    """First text of the usual name fields of an object."""
    fields = F.from_json(item, _OBJECT)
    return F.coalesce(*[X.clean_text(F.try_element_at(fields, F.lit(k))) for k in ("SchoolName", "FacilityName", "school")])


def _named_entries(text: F.Column) -> F.Column:
    """Array of (key, value) of a document: rules by name, results by name, or a list of items."""
    top = F.from_json(text, _OBJECT)
    rules = F.from_json(F.try_element_at(top, F.lit("school_rules")), _OBJECT)
    entry = lambda key, value: F.struct(key.alias("key"), value.alias("value"))
    listed = F.transform(F.from_json(text, _LIST), lambda x: entry(_item_name(x), x))
    return (
        F.when(rules.isNotNull(), F.map_entries(rules))
        .when(top.isNotNull(), F.filter(F.map_entries(top), lambda e: X.has_text(e["key"])))
        .otherwise(F.filter(listed, lambda e: e["key"].isNotNull()))
    )


def rules_from_json(documents: DataFrame, text: str, keep: Sequence[str] = ()) -> DataFrame:
    """Rules (keep..., school, alt_urls) of JSON documents, one document per row, in any of the known shapes.

    An object with ``school_rules``, an object of results by school, or a list of items that name
    their school. The last item of a name counts. Anything else gives no rule.
    """
    rows = documents.select(*keep, F.posexplode(_named_entries(F.col(text))).alias("_ord", "_e"))
    rows = latest_per_key(rows.withColumn("school", F.col("_e.key")), [*keep, "school"], "_ord")
    payload = F.from_json("_e.value", _OBJECT)
    rows = rows.withColumn("_p", payload)
    at = lambda k: F.try_element_at("_p", F.lit(k))
    has = lambda k: F.coalesce(F.map_contains_key("_p", F.lit(k)), F.lit(False))
    one = lambda u: F.array(u)
    listed, site = F.from_json(at("alt_urls"), _LIST), F.from_json(at("school_urls"), _OBJECT)
    urls = (
        F.when(listed.isNotNull(), listed)
        .when(F.col("_p").isNull(), F.array().cast(_LIST))
        .when(~has("school_urls") | site.isNotNull(), one(F.try_element_at(site, F.lit("alt_url"))))
        .when(has("AltUrl"), one(at("AltUrl")))
        .when(has("alt_url"), one(at("alt_url")))
        .otherwise(F.array().cast(_LIST))
    )
    return rows.select(*keep, "school", X.normalize_urls(urls).alias("alt_urls"))


def names_from_json(documents: DataFrame, text: str, keep: Sequence[str] = ()) -> DataFrame:
    """Distinct school names (keep..., school) of JSON documents in any of the known shapes, matches included."""
    top = F.from_json(F.col(text), _OBJECT)
    matches = F.from_json(F.try_element_at(top, F.lit("matches")), _LIST)
    is_rules = F.from_json(F.try_element_at(top, F.lit("school_rules")), _OBJECT).isNotNull()
    matched = F.transform(matches, lambda m: X.clean_text(F.try_element_at(F.from_json(m, _OBJECT), F.lit("school"))))
    keys = F.transform(_named_entries(F.col(text)), lambda e: e["key"])
    names = F.when(matches.isNotNull() & ~is_rules, F.array_compact(matched)).otherwise(keys)
    return documents.select(*keep, F.explode(names).alias("school")).distinct()


def bulk_add_rules(rules: DataFrame, incoming: DataFrame) -> DataFrame:
    """Union of alternative addresses per school, first-seen order (one row per school each)."""
    new = incoming.select("school", F.col("alt_urls").alias("_new"))
    joined = rules.join(new, "school", "full_outer")
    old = F.coalesce("alt_urls", F.array().cast("array<string>"))
    more = F.coalesce("_new", F.array().cast("array<string>"))
    merged = X.normalize_urls(F.concat(old, more))
    untouched = F.col("_new").isNull()
    return joined.select("school", F.when(untouched, F.col("alt_urls")).otherwise(merged).alias("alt_urls"))


def bulk_delete_by_names(rules: DataFrame, names: DataFrame) -> DataFrame:
    """Drop the rules whose exact name is listed in ``names`` (school)."""
    return rules.join(names.select("school").distinct(), "school", "left_anti")


def rename_or_edit_rules(rules: DataFrame, edits: DataFrame) -> DataFrame:
    """Apply at most one edit per school: (school, action, urls, new_name).

    Actions: ``replace``, ``add``, ``remove`` addresses, ``rename``. A rename is refused where
    the new name is already a rule or blank, or another rule of the batch takes it first.
    """
    taken = rules.select(F.col("school").alias("new_name"), F.lit(True).alias("_taken"))
    wanted = edits.withColumn("new_name", X.clean_text("new_name")).join(taken, "new_name", "left")
    claim = wanted.filter("action = 'rename' and new_name is not null and _taken is null")
    winners = claim.join(rules.select("school"), "school", "left_semi")
    winners = winners.groupBy("new_name").agg(F.min("school").alias("school"))
    winners = winners.select("school", F.col("new_name").alias("_renamed"))
    plain = edits.select("school", "action", "urls").join(winners, "school", "left")
    joined = rules.join(plain, "school", "left")
    clean = X.normalize_urls(F.coalesce("urls", F.array().cast("array<string>")))
    old = F.coalesce("alt_urls", F.array().cast("array<string>"))
    action = F.col("action")
    edited = (
        F.when(action == "replace", clean)
        .when(action == "add", X.normalize_urls(F.concat(old, clean)))
        .when(action == "remove", F.filter(old, lambda u: ~F.array_contains(clean, u)))
        .otherwise(F.col("alt_urls"))
    )
    return joined.select(F.coalesce("_renamed", "school").alias("school"), edited.alias("alt_urls"))
