"""Compare registered queries with their SQL twins. Also a command:

python -m tests.oracle [--sf DIR] [--hot N] [names...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

from timelane.plans import REGISTRY
from timelane.session import HOT_ROWS, TABLES


def connect(folder: str):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    return con


def _norm(v):
    if v is None or isinstance(v, (str, bool)):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def compare(spark, con, folder, name):
    """Returns (problem or None, row count, seconds)."""
    q = REGISTRY[name]
    began = time.time()
    df = q.run(spark, folder)
    names = sorted(df.columns)
    got = [tuple(_norm(v) for v in r) for r in df.select(*names).collect()]
    took = time.time() - began
    bad = [f for f in df.schema.fields if f.dataType.typeName() in ("array", "map", "struct")]
    if bad:
        return f"nested columns {bad}", len(got), took
    if q.sql is None:
        return None, len(got), took
    cur = con.execute(q.sql)
    cols = [c[0] for c in cur.description]
    types = {c[0]: str(c[1]) for c in cur.description}
    if sorted(cols) != names:
        return f"columns {names} != {sorted(cols)}", len(got), took
    place = [cols.index(n) for n in names]
    want = [tuple(_norm(r[i]) for i in place) for r in cur.fetchall()]
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}", len(got), took
    for f in df.schema.fields:
        if _kind(f.dataType.simpleString()) != _kind(types[f.name]):
            return f"type of {f.name}: {f.dataType.simpleString()} != {types[f.name]}", len(got), took
    for a, b in zip(_sorted(got), _sorted(want)):
        if a != b:
            return f"{names}: {a} != {b}", len(got), took
    return None, len(got), took


def _kind(t: str) -> str:
    t = t.lower()
    return {
        "bigint": "bigint", "int": "int", "integer": "int", "string": "string",
        "varchar": "string", "str": "string", "boolean": "bool", "bool": "bool", "double": "double",
        "timestamp_ntz": "ts", "timestamp": "ts", "smallint": "smallint", "float": "float",
    }.get(t, t)


def main(argv):
    from timelane.session import build_session

    folder, hot, names = "/root/testdata/sf0.01", None, []
    it = iter(argv)
    for a in it:
        if a == "--sf":
            folder = next(it)
        elif a == "--hot":
            hot = next(it)
        else:
            names.append(a)
    spark = build_session(
        "oracle", master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
           "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    if hot:
        spark.conf.set(HOT_ROWS, hot)
    con = connect(folder)
    failed = 0
    for name in names or list(REGISTRY):
        try:
            problem, rows, took = compare(spark, con, folder, name)
        except Exception as e:  # keep going, report at the end
            problem, rows, took = f"{type(e).__name__}: {str(e)[:300]}", -1, 0.0
        mark = "ok  " if problem is None else "FAIL"
        oracle = "" if REGISTRY[name].sql else " (no sql)"
        print(f"{mark} {name}{oracle} rows={rows} {took:.2f}s {problem or ''}", flush=True)
        failed += problem is not None
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
