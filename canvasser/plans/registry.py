"""Named queries with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from canvasser.plans.bindings import Views, views, with_views

Builder = Callable[[Views], DataFrame]
QUERIES: dict[str, Builder] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None) -> Callable[[Builder], Builder]:
    """Register a query under its name; ``check`` is the equal SQL over the same views."""

    def add(build: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = build
        if check is not None:
            CHECKS[name] = check
        return build

    return add


def callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(build: Builder) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: build(views(spark, sf_dir))

    return {name: bind(build) for name, build in QUERIES.items()}


def checks() -> dict[str, str]:
    return {name: with_views(sql) for name, sql in CHECKS.items()}
