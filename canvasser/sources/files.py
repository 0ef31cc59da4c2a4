"""Readers for CSV, JSON and remote tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canvasser import schema as M
from canvasser.functions import text as X


def read_csv_records(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """CSV with a header row, every value as text, empty lines skipped.

    ``multi_line`` accepts line breaks inside quotes but reads each file in one task; leave
    it off for large files.
    """
    df = spark.read.csv(path, header=True, escape='"', multiLine=multi_line, encoding="UTF-8")
    return df.withColumnsRenamed({c: c.lstrip("﻿") for c in df.columns})


def union_sheets(sheets: Mapping[int, DataFrame], positions: Sequence[int] = (1, 5)) -> DataFrame:
    """High-school rows of the sheets at the given positions, concatenated by column name."""
    from canvasser.operators.filters import filter_high_school_facilities

    kept = [filter_high_school_facilities(sheets[p]) for p in positions if p in sheets]
    kept = [k for k in kept if k.columns]
    if not kept:
        raise ValueError("no sheet at the wanted positions has the facility columns")
    out = kept[0]
    for more in kept[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def pick_sheet(names: Sequence[str], word: str, fallback: int) -> int:
    """Position of the sheet whose name contains ``word``, else ``fallback``."""
    return next((i for i, n in enumerate(names) if word in n.lower()), fallback)


def read_json_records(spark: SparkSession, path: str, schema: T.StructType, lines: bool = False) -> DataFrame:
    """JSON array of objects (or one object per line); elements that are no object are dropped.

    A document is read as a whole by one task per file, so large data should come as many files
    or as lines. Any other top-level type is an error.
    """
    if lines:
        parsed = spark.read.text(path).select(F.from_json("value", schema).alias("r"))
        return parsed.filter("r is not null").select("r.*")
    return _json_objects(spark, path).select(F.from_json("item", schema).alias("r")).select("r.*")


def _documents(spark: SparkSession, path: str, opening: str, kind: str) -> DataFrame:
    """The files at ``path`` as whole texts; one that does not begin with ``opening`` is an error."""
    whole = spark.read.text(path, wholetext=True)
    wrong = F.raise_error(F.lit(f"a JSON {kind} is expected"))
    return whole.select(F.when(F.ltrim(F.regexp_replace("value", r"^[\s\uFEFF]+", "")).startswith(opening), F.col("value")).otherwise(wrong).alias("value"))


def _json_objects(spark: SparkSession, path: str) -> DataFrame:
    """The objects of the JSON arrays at ``path``, as JSON texts."""
    whole = _documents(spark, path, "[", "array")
    items = whole.select(F.explode(F.from_json("value", T.ArrayType(T.StringType()))).alias("item"))
    return items.filter(F.col("item").startswith("{"))


def keyed_entries(documents: DataFrame, column: str, document: Sequence[str] = ()) -> DataFrame:
    """One row (key, value) per entry of the JSON objects in ``column``; the value is a VARIANT.

    Entries may be of any type, each one its own. Of equal keys of a document (its columns are
    ``document``; without them, its text) the last one counts, as JSON readers have it.
    """
    own = list(document) or [F.xxhash64(column).alias("_text")]
    entries = documents.select(*own, F.posexplode(F.from_json(column, "map<string,variant>")).alias("_at", "key", "value"))
    names = [c if isinstance(c, str) else "_text" for c in own]
    last = entries.groupBy(*names, "key").agg(F.max_by("value", "_at").alias("value"))
    return last.drop("_text")


def explode_keyed_json(documents: DataFrame, column: str, value_type: T.DataType, document: Sequence[str] = ()) -> DataFrame:
    """``keyed_entries`` with values of one type; a value of another type is null."""
    text = F.to_json("value") if not isinstance(value_type, T.StringType) else F.col("value").cast("string")
    rows = keyed_entries(documents, column, document)
    return rows.withColumn("value", F.from_json(text, value_type) if not isinstance(value_type, T.StringType) else text)


def read_keyed_json(spark: SparkSession, path: str, value_type: T.DataType | None = None) -> DataFrame:
    """One row (key, value) per entry of the JSON object of each file; without a type the value is a VARIANT."""
    documents = _documents(spark, path, "{", "object").withColumn("file", F.input_file_name())
    if value_type is None:
        return keyed_entries(documents, "value", ["file"]).drop("file")
    return explode_keyed_json(documents, "value", value_type, ["file"]).drop("file")


def school_list_fields(item: str = "value", key: str | None = "key") -> list[F.Column]:
    """FacilityName, City and Website of a loosely named school object, first usable wins.

    The object is a map, as its field names may differ in case only.
    """

    def first(*names: str) -> F.Column:
        return F.coalesce(*[X.blank_to_null(F.col(item)[n]) for n in names])

    fallback = [F.col(key)] if key else []
    urls = F.from_json(F.col(item)["school_urls"], M.LOOSE_OBJECT)
    nested = [X.blank_to_null(urls[n]) for n in ("base_url", "alt_url")]
    name = F.coalesce(first("FacilityName", "SchoolName", "School Name"), *fallback, F.lit(""))
    city = F.coalesce(first("City", "city"), F.lit(""))
    site = F.coalesce(first("Website", "website", "Homepage", "base_url"), *nested, F.lit(""))
    return [
        X.strip(name).alias("FacilityName"),
        X.strip(city).alias("City"),
        X.strip(site).alias("Website"),
    ]


def read_school_list(spark: SparkSession, path: str, keyed: bool) -> DataFrame:
    if keyed:
        rows = read_keyed_json(spark, path, M.LOOSE_OBJECT)
        return rows.filter("value is not null").select(*school_list_fields())
    rows = _json_objects(spark, path).select(F.from_json("item", M.LOOSE_OBJECT).alias("value"))
    return rows.select(*school_list_fields(key=None))


def read_table_partitioned(
    spark: SparkSession,
    url: str,
    table: str,
    columns: Sequence[str],
    partition_column: str,
    lower: int,
    upper: int,
    partitions: int,
    **options: str,
) -> DataFrame:
    """Remote table over JDBC, read in parallel ranges of a numeric column."""
    reader = spark.read.format("jdbc").options(
        url=url,
        dbtable=table,
        partitionColumn=partition_column,
        lowerBound=str(lower),
        upperBound=str(upper),
        numPartitions=str(partitions),
        **options,
    )
    return reader.load().select(*columns)


def read_key_ranges(df: DataFrame, key: str, page: int, columns: Sequence[str]) -> DataFrame:
    """Projected scan with the page each row falls into; pages never share a row."""
    return df.select(F.floor(F.col(key) / page).cast("bigint").alias("page"), *columns)
