"""Run registered queries next to their oracle statements and report differences."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb

from tablewise.plans.registry import TABLE_NAMES


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLE_NAMES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v) if not v.is_integer() else ("-0" if v == 0 and math.copysign(1, v) < 0 else str(int(v)))
    if isinstance(v, int):
        return str(v)
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(str(plain(x)) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{plain(x)}" for k, x in sorted(v.items())) + "}"
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str(tuple(plain(r[i]) for i in order)) for r in rows)


def difference(spark, con, folder, fn, sql):
    """None when equal, else a short description."""
    df = fn(spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None, len(got)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}", len(got)
    if not want:
        return "oracle gives no rows", 0
    if got != want:
        sg, sw = set(got), set(want)
        a = [x for x in got if x not in sw][:3]
        b = [x for x in want if x not in sg][:3]
        return f"rows {len(got)} vs {len(want)}\n   spark {a}\n   sql   {b}", len(got)
    return None, len(got)


def main(argv):
    import __spark_entry__ as entry
    from tablewise.session import local_session

    folder = "/root/testdata/sf0.01"
    pats = argv or [""]
    spark = local_session()
    con = connect(folder)
    qs, orc = entry.queries(), entry.oracle_sql()
    bad = 0
    for k, fn in qs.items():
        if not any((k.startswith(p) if not p.endswith("!") else k == p[:-1]) for p in pats):
            continue
        t = time.time()
        try:
            diff, n = difference(spark, con, folder, fn, orc.get(k))
        except Exception as e:  # noqa: BLE001
            diff, n = f"{type(e).__name__}: {str(e)[:700]}", -1
        mark = "ok " if diff is None else "BAD"
        bad += diff is not None
        print(f"{mark} {k:6} rows={n:6} {time.time()-t:5.1f}s {'sql' if k in orc else 'rows'} {diff or ''}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
