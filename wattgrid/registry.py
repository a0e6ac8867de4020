"""The register of queries, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattgrid.plans.adaptors import SQL, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
AS_OF = "2001-08-01"


def query(sql: str | None):
    """Registers a function of Tables under its name, with SQL that follows the views of the tariff schema; SQL that begins with + adds views of its own, with ++ recursive ones."""

    def add(f: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            out = f(Tables(spark, folder))
            return out.withColumns({c: F.col(c).cast("double") for c, kind in out.dtypes if kind.startswith("decimal")})

        QUERIES[f.__name__] = run
        if sql:
            own = sql.lstrip()
            ORACLES[f.__name__] = f"with {'recursive ' if own.startswith('++') else ''}{SQL}{',' if own.startswith('+') else ''}\n{own.lstrip('+')}"
        return f

    return add
