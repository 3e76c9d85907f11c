"""Compare a Spark query with its DuckDB SQL: columns, types, row count and values, in any order."""

from __future__ import annotations

import glob
import os
from collections import Counter

import duckdb

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN",
         "double": "DOUBLE"}


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"create view {name} as select * from '{path}'")
    return con


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(row[i] for i in order) for row in rows)


def difference(df, con, sql: str) -> str | None:
    """What differs, or None."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    kinds = {name: str(kind) for name, kind, *_ in result.description}
    mine = {name: TYPES.get(kind, kind) for name, kind in df.dtypes}
    if mine != kinds:
        return f"types {mine} != {kinds}"
    mine, theirs = _rows(df.columns, df.collect()), _rows(names, result.fetchall())
    if mine != theirs:
        extra, missing = list((mine - theirs).items()), list((theirs - mine).items())
        return (f"{sum(mine.values())} rows != {sum(theirs.values())}; {len(extra)} extra, "
                f"{len(missing)} missing; extra {extra[:2]}; missing {missing[:2]}")
    return None
