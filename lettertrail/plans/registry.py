"""Named queries and, where SQL can say the same, the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .. import fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


class Inputs:
    """Lazy access to tables and views of one data directory: `inputs.documents`, `inputs.fx_emails`."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in fixtures.VIEWS:
            return fixtures.view(self.spark, self.sf_dir, name)
        if name in fixtures.TABLES:
            fixtures.prepare(self.spark)
            return fixtures.table(self.spark, self.sf_dir, name)
        raise AttributeError(name)


def query(name: str, check: str | None = None):
    def register(build: Callable[[Inputs], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(Inputs(spark, sf_dir))
        if check is not None:
            CHECKS[name] = fixtures.check_sql(check)
        return build

    return register


def load_all() -> None:
    from . import (  # noqa: F401
        dedup_queries,
        maintain_queries,
        search_queries,
        source_queries,
        span_queries,
        text_queries,
        thread_queries,
    )
