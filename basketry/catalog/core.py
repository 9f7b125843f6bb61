"""Core of the query registry: the table of queries and the edge types."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DecimalType

from basketry import oracle as O
from basketry.plans.filters import Filters, all_filters, default_filters
from basketry.plans.warehouse import open_warehouse
from basketry.profile import TEST_PROFILE

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}

DEF = default_filters(TEST_PROFILE)
ALL = all_filters(TEST_PROFILE)
# Fixed values for the filtered variants (states and categories of the test binding).
SOME_STATES = ("NATION_2", "NATION_7", "NATION_11")
SOME_CATEGORIES = ("cat_11", "cat_23", "cat_35", "others")
RJ = Filters(DEF.start, DEF.end, (TEST_PROFILE.origin_states[0],), ())
RJ_SELLER_STATE = TEST_PROFILE.origin_states[1]
FILTERED = Filters(DEF.start, DEF.end, SOME_STATES, SOME_CATEGORIES)


def edge(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, DateType):
            c = c.cast("timestamp_ntz")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def register(name: str, sql: str | None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return edge(fn(spark, sf_dir))

        run.__name__ = name
        QUERIES[name] = (run, sql)
        return fn

    return deco


def wh(spark: SparkSession, sf_dir: str):
    return open_warehouse(spark, sf_dir, TEST_PROFILE)


def _sales_sql(f: Filters, body: str, extra: str = "") -> str:
    ctes = O.sales_cte(f.start, f.end, f.states, f.categories) + ("," + extra if extra else "")
    return O.with_models(body, ctes)


def _rfm_sql(f: Filters, body: str, extra: str = "") -> str:
    ctes = O.rfm_cte(f.states) + ("," + extra if extra else "")
    return O.with_models(body, ctes)




def sql_of(name: str) -> str:
    """Reference SQL of an already registered query (for nesting)."""
    sql = QUERIES[name][1]
    assert sql is not None, name
    return sql


def from_query(name: str, alias: str = "q") -> str:
    return f"(\n{sql_of(name)}\n) {alias}"
