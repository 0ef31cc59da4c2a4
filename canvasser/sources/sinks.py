"""Writers and report shapes. Every writer leaves one part file per task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canvasser import schema as M
from canvasser.functions import text as X
from canvasser.operators.joins import contacts_with_school


_CSV = {"escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def csv_field(c: Column | str) -> Column:
    """A value as it stands in the CSV: quoted only if it holds a comma, quote or line break."""
    text = F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[,"\r\n]'), quoted).otherwise(text)


def contact_csv_columns(contacts: DataFrame, schools: DataFrame) -> DataFrame:
    """The export columns of a contact list."""
    rows = contacts_with_school(contacts, schools)
    return rows.select(
        F.col("first_name").alias("firstName"), F.col("last_name").alias("lastName"), "email",
        F.coalesce("phone", F.lit("")).alias("phone"),
        X.labels("role", M.ROLE_LABELS).alias("role"),
        F.col("school_name").alias("school"), F.col("school_county").alias("county"),
        F.col("school_address").alias("address"), F.col("school_city").alias("city"),
        F.col("school_state").alias("state"), F.col("school_zip_code").alias("zipCode"),
    )


def csv_lines(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(F.concat_ws(",", *[csv_field(c) for c in columns]).alias("line"))


def write_contact_csv(df: DataFrame, columns: Sequence[str], path: str) -> None:
    df.select(*columns).write.csv(path, header=True, emptyValue="", nullValue="", **_CSV)


def mailing_labels(contacts: DataFrame, schools: DataFrame) -> DataFrame:
    """One label text per contact."""
    rows = contacts_with_school(contacts, schools)
    place = F.concat(F.col("school_city"), F.lit(", "), F.col("school_state"), F.lit(" "), F.col("school_zip_code"))
    who = F.concat_ws(" ", "first_name", "last_name")
    return rows.select("contact_id", F.concat_ws("\n", who, "school_name", "school_address", place).alias("label"))


def write_mailing_labels(labels: DataFrame, path: str) -> None:
    labels.select("label").write.text(path, lineSep="\n\n---\n\n")


def email_list(contacts: DataFrame, group: str, order: str, span: int = 1000) -> DataFrame:
    """E-mails joined by ", " per group, in pieces.

    A piece holds the contacts of one stretch of ``span`` ids (``order`` is a unique whole
    number), so no value grows with the data; the pieces of a group in order are its list.
    """
    rows = contacts.withColumn("piece", F.floor(F.col(order) / span).cast("bigint"))
    entries = F.array_sort(F.collect_list(F.struct(order, "email")))
    return rows.groupBy(group, "piece").agg(
        F.count("*").alias("contacts"),
        F.array_join(F.transform(entries, lambda e: e["email"]), ", ").alias("emails"),
    )


def write_email_list(contacts: DataFrame, order: str, path: str) -> None:
    """All e-mails joined by ", " as text files."""
    contacts.orderBy(order).select("email").write.text(path, lineSep=", ")


def engagement_report(summary: DataFrame, top: DataFrame, attention: DataFrame, as_of: str, title: str = "Outreach Report") -> DataFrame:
    """Report as (section, k1, k2, line) rows: metrics, top schools, schools needing attention.

    Each section has a heading, the last two a line of column names. Rows of a section sort by
    (k1, k2); no global numbering is needed.
    """
    generated = F.concat(F.lit("Generated: "), F.date_format(F.lit(as_of).cast("timestamp_ntz"), "MMMM d, yyyy"))

    def entry(section: Column, k: int, line: Column) -> Column:
        return F.struct(section.alias("section"), F.lit(f"{k:03d}").alias("k1"), F.lit("").alias("k2"), line.alias("line"))

    heads = [entry(F.lit("1 heading"), k, x) for k, x in enumerate([F.lit(title), generated])]
    heads += [entry(F.lit(f"{s} heading"), k + (2 if s == 1 else 0), F.lit(x)) for s, lines in M.REPORT_HEADINGS.items() for k, x in enumerate(lines)]
    headings = summary.select(F.inline(F.array(*heads)))
    entries = F.array(
        *[
            F.struct(F.lit(f"{i:03d}").alias("k1"), F.concat(F.lit(f"{label}: "), F.col(c).cast("string")).alias("line"))
            for i, (label, c) in enumerate(M.REPORT_METRICS)
        ]
    )
    head = summary.select(F.lit("1 summary").alias("section"), F.inline(entries))
    head = head.select("section", "k1", F.lit("").alias("k2"), "line")
    quote = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    best = top.select(
        F.lit("2 top engaged schools").alias("section"),
        F.lpad((F.lit(10**12) - F.col("score")).cast("string"), 13, "0").alias("k1"),
        F.concat_ws("|", "name", F.col("school_id").cast("string")).alias("k2"),
        F.concat_ws(
            ",", quote(F.col("name")), *[F.col(c).cast("string") for c in ("score", "activities", "active_contacts", "appearances")]
        ).alias("line"),
    )
    need = attention.select(
        F.lit("3 schools needing attention").alias("section"),
        F.col("name").alias("k1"),
        F.col("school_id").cast("string").alias("k2"),
        F.concat_ws(
            ",", quote(F.col("name")), "county", F.col("total_contacts").cast("string"), "last_activity", "priority",
            quote(F.array_join("issues", "; ")),
        ).alias("line"),
    )
    return headings.unionByName(head).unionByName(best).unionByName(need)


def write_report(report: DataFrame, path: str) -> None:
    report.orderBy("section", "k1", "k2").select("line").write.text(path)


def export_snapshot(tables: Mapping[str, DataFrame], path: str) -> None:
    """One JSON folder per table."""
    for name, df in tables.items():
        df.write.json(f"{path}/{name}", ignoreNullFields=False)


def import_snapshot(spark: SparkSession, path: str, schemas: Mapping[str, T.StructType]) -> dict[str, DataFrame]:
    return {name: spark.read.schema(s).json(f"{path}/{name}") for name, s in schemas.items()}


def append_records(df: DataFrame, path: str, run_id: str) -> None:
    """Append the rows of one run; repeating a run replaces its own folder only."""
    df.write.mode("overwrite").csv(f"{path}/run_id={run_id}", header=True, **_CSV)


def write_lists(lists: DataFrame, path: str) -> None:
    lists.write.partitionBy("list_type").json(path)


def save_by_key(df: DataFrame, table: str, key: str, buckets: int, path: str) -> None:
    """Save a table in hash buckets of the key.

    Entity tables saved by school with equal bucket counts are counted and joined per school
    without any exchange. Rebalancing first keeps a hot bucket from being one task's work.
    """
    bucket = F.pmod(F.hash(key), F.lit(buckets))
    rows = df.withColumn("_bucket", bucket).hint("rebalance", "_bucket").drop("_bucket")
    rows.write.mode("overwrite").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(table)
