"""Registry of check queries: each is a function of (spark, sf_dir), most with the same result in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _wide(df: DataFrame) -> DataFrame:
    """Whole numbers as BIGINT and floats as DOUBLE, the types of the check."""
    wide = {"tinyint": "bigint", "smallint": "bigint", "int": "bigint", "float": "double"}
    kinds = dict(df.dtypes)
    return df.select(*[F.col(c).cast(wide[kinds[c]]) if kinds[c] in wide else F.col(c) for c in df.columns])


def query(name: str, oracle: str | None = None):
    """Register a query under its inventory name."""

    def add(fn: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: _wide(fn(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add
