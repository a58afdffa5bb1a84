"""Run a query and its SQL side by side. Also a script: python tests/oracle.py SF [key ...]"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = os.path.join(folder, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def kind(dtype: str) -> str:
    d = str(dtype)
    for k in ("int", "float", "bool", "datetime"):
        if d.lower().startswith(k):
            return k
    return "object"


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    out = []
    for row in df.itertuples(index=False):
        vals = []
        for x in row:
            if x is None or x is pd.NaT or (isinstance(x, float) and x != x):
                vals.append("~")
            elif isinstance(x, float):
                vals.append(repr(x))
            else:
                vals.append(str(x))
        out.append(tuple(vals))
    return sorted(out)


def loose(a: str, b: str) -> bool:
    try:
        return a == b or abs(float(a) - float(b)) <= 1e-9 * max(1.0, abs(float(a)))
    except ValueError:
        return a == b


def compare(spark_df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    got = spark_df.toPandas()
    res = con.execute(sql)
    want_types = {d[0]: str(d[1]) for d in res.description}
    want = res.df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} vs {sorted(want.columns)}"
    types = dict(spark_df.dtypes)
    names = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
             "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}
    bad = {c: (types[c], want_types[c]) for c in types if names.get(types[c], types[c]) != want_types[c].upper()}
    a, b = rows(got), rows(want)
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}; types {bad}"
    diff = [(x, y) for x, y in zip(a, b) if x != y]
    if diff:
        near = all(all(loose(p, q) for p, q in zip(x, y)) for x, y in diff)
        return f"{len(diff)} of {len(a)} rows differ{' (last digits only)' if near else ''}: {sorted(got.columns)} {diff[:2]}; types {bad}"
    return f"types {bad}" if bad else None


def main() -> None:
    import __spark_entry__ as entry
    from ledgerlens.session import get_session

    folder = f"/root/testdata/sf{sys.argv[1]}"
    spark = get_session("oracle", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    oracles, queries = entry.oracle_sql(), entry.queries()
    keys = sys.argv[2:] or list(queries)
    failed = 0
    for key in keys:
        start = time.time()
        try:
            df = queries[key](spark, folder)
            if key in oracles:
                problem = compare(df, con, oracles[key])
            else:
                problem = None if df.count() else "no rows"
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {key} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{len(keys) - failed} of {len(keys)} ok")


if __name__ == "__main__":
    main()
