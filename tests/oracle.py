"""Runs registered queries beside their check SQL in DuckDB.

    python tests/oracle.py [--sf DIR] [name-part ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

SPARK_TO_SQL = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "date": "DATE", "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN",
}


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def _key(v):
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    return "" if v is None else repr(v)


def compare(spark, con, sf: str, name: str, fn, sql: str | None) -> str:
    df = fn(spark, sf)
    rows = [tuple(r) for r in df.collect()]
    if sql is None:
        return f"rows {len(rows)}" if rows else "BAD no rows"
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    types = {d[0]: str(d[1]) for d in rel.description}
    want = rel.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"BAD columns {sorted(df.columns)} != {sorted(names)}"
    for f in df.schema.fields:
        mine = SPARK_TO_SQL.get(f.dataType.simpleString(), f.dataType.simpleString())
        if mine != types[f.name]:
            return f"BAD type {f.name}: {mine} != {types[f.name]}"
    pick = [names.index(c) for c in df.columns]
    a = sorted(tuple(_key(v) for v in r) for r in rows)
    b = sorted(tuple(_key(r[i]) for i in pick) for r in want)
    if len(a) != len(b):
        return f"BAD rows {len(a)} != {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"BAD {len(bad)} of {len(a)} rows differ: {df.columns} {bad[0]}"
    return f"ok {len(a)}" if a else "BAD no rows"


if __name__ == "__main__":
    args = sys.argv[1:]
    sf = "/root/testdata/sf0.01"
    if "--sf" in args:
        i = args.index("--sf")
        sf = args[i + 1]
        del args[i : i + 2]
    from __spark_entry__ import oracle_sql, queries
    from ampertide.session import local_session

    spark = local_session(8)
    con = connect(sf)
    qs, checks = queries(), oracle_sql()
    failed = 0
    for name, fn in qs.items():
        if args and not any(a in name for a in args):
            continue
        t = time.time()
        try:
            res = compare(spark, con, sf, name, fn, checks.get(name))
        except Exception as e:
            res = "BAD " + str(e).split("JVM stacktrace")[0][:600]
        failed += res.startswith("BAD")
        print(f"{name:34s} {time.time() - t:6.2f}s {res}", flush=True)
    print("failed", failed)
