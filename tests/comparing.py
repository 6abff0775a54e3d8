"""Compare a Spark result with what DuckDB says, as sets of rows with repetitions."""

from __future__ import annotations

import math
import os
from collections import Counter
from pathlib import Path

import duckdb


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in sorted(Path(sf).iterdir()):
        where = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"CREATE VIEW {p.name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{where}')")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.9g}"
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if isinstance(x, dict):
        return tuple((k, plain(v)) for k, v in sorted(x.items()))
    if hasattr(x, "asDict"):
        return plain(x.asDict())
    if isinstance(x, bool) or x is None:
        return x
    if hasattr(x, "as_integer_ratio"):
        return f"{float(x):.9g}"
    return str(x)


def rows(columns: list[str], data) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in data)


def difference(df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    said = con.execute(sql)
    names = [d[0] for d in said.description]
    want, got = rows(names, said.fetchall()), rows(df.columns, df.collect())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} but SQL has {sorted(names)}"
    if want != got:
        return f"{sum(got.values())} rows, SQL {sum(want.values())}; only here {list((got - want).items())[:3]}; only SQL {list((want - got).items())[:3]}"
    return ""


SF = os.environ.get("SUITELENS_SF", "/root/testdata/sf0.001")
