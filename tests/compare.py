"""Run check queries in Spark and DuckDB side by side and compare rows.

``python -m tests.compare SF [name-prefix …]`` prints one line per query.
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, list):
        return tuple(plain(v) for v in value)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, query, oracle, sf_dir):
    """An empty string when both sides agree, else what differs."""
    df = query(spark, sf_dir)
    got_names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if oracle is None:
        return "" if got else "no rows"
    result = con.execute(oracle)
    kinds = [(d[0], str(d[1])) for d in result.description]
    want_names, want = rows_of([k[0] for k in kinds], result.fetchall())
    if got_names != want_names:
        return f"columns {got_names} <> {want_names}"
    spark_kinds = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "int": "INTEGER"}
    mine = sorted((n, spark_kinds.get(t, t)) for n, t in df.dtypes)
    odd = [(a, b) for a, b in zip(mine, sorted(kinds)) if a != b]
    if got != want:
        return (
            f"{sum(got.values())} rows, oracle {sum(want.values())}; "
            f"only here {list((got - want).items())[:3]}; only there {list((want - got).items())[:3]}"
        )
    if odd:
        return f"types {odd}"
    return "" if got else "no rows on either side"


def main(sf: str, *prefixes: str) -> int:
    from treespark.plans.catalogue import ORACLES, QUERIES
    from treespark.session import local_session

    spark = local_session("8")
    sf_dir = f"/root/testdata/sf{sf}"
    con = connect(sf_dir)
    bad = 0
    for name, query in QUERIES.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            problem = compare(spark, con, query, ORACLES.get(name), sf_dir)
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        bad += bool(problem)
        mark = "ok" if name in ORACLES else "rows"
        print(f"{name:28s} {time.time() - start:6.1f}s {problem or mark}", flush=True)
    print(f"{bad} differ")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(*sys.argv[1:]) else 0)
