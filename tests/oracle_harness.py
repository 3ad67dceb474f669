"""Run queries() against oracle_sql() on DuckDB and compare, like the driver.

Usable as a script:  python tests/oracle_harness.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 9)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 9)
    if isinstance(v, (pd.Timestamp, dt.datetime)):
        ts = pd.Timestamp(v)
        return ts.date().isoformat() if ts == ts.normalize() else ts.isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(df: pd.DataFrame):
    cols = sorted(df.columns)
    out = []
    for rec in df[cols].itertuples(index=False, name=None):
        out.append(tuple(_norm(x) for x in rec))
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def compare(spark, name, fn, sql, sf_dir):
    t0 = time.time()
    sp = fn(spark, sf_dir)
    sp_schema = {f.name: f.dataType.simpleString() for f in sp.schema.fields}
    spd = pd.DataFrame(sp.collect(), columns=sp.columns)
    t1 = time.time()
    con = duck(sf_dir)
    rel = con.execute(sql)
    ddf = rel.fetchdf()
    dtypes = {d[0]: str(d[1]) for d in rel.description} if rel.description else {}
    res = {"name": name, "spark_rows": len(spd), "oracle_rows": len(ddf),
           "spark_sec": round(t1 - t0, 2)}
    res["cols_match"] = sorted(spd.columns) == sorted(ddf.columns)
    if not res["cols_match"]:
        res["detail"] = f"cols spark={sorted(spd.columns)} oracle={sorted(ddf.columns)}"
        res["match"] = False
        return res
    a, b = _rows(spd), _rows(ddf)
    res["match"] = a == b
    if not res["match"]:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        res["detail"] = f"first diffs: {diff}" if diff else "row count differs"
    res["types"] = {c: (sp_schema.get(c), dtypes.get(c)) for c in spd.columns}
    return res


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not a.startswith("/")]
    import __spark_entry__ as E
    from cohortlens.session import get_session
    spark = get_session("local[8]", shuffle_partitions=8)
    qs, oracle = E.queries(), E.oracle_sql()
    bad = 0
    for name in sorted(qs):
        if names and name not in names:
            continue
        if name not in oracle:
            df = qs[name](spark, sf_dir)
            print(f"{name:32s} rows-only {df.count()} rows")
            continue
        try:
            r = compare(spark, name, qs[name], oracle[name], sf_dir)
        except Exception as e:  # report and continue
            bad += 1
            print(f"{name:32s} ERROR {type(e).__name__}: {str(e)[:300]}")
            continue
        flag = "OK " if r["match"] else "BAD"
        bad += not r["match"]
        mism = {c: t for c, t in r.get("types", {}).items() if t[0] and t[1] and _kind(t[0]) != _kind(t[1])}
        print(f"{name:32s} {flag} rows {r['spark_rows']}/{r['oracle_rows']} {r['spark_sec']}s"
              + (f" types {mism}" if mism else "") + (f" {r.get('detail', '')}" if not r["match"] else ""))
    print("mismatches:", bad)
    return bad


def _kind(t: str) -> str:
    t = t.lower()
    if t in ("bigint", "int", "integer", "smallint", "tinyint", "hugeint", "int32", "int64"):
        return "int"
    if t in ("double", "float", "real"):
        return "float"
    if t.startswith("decimal"):
        return "decimal"
    if t in ("string", "varchar"):
        return "str"
    if t in ("date",):
        return "date"
    if t.startswith("timestamp"):
        return "ts"
    if t in ("boolean", "bool"):
        return "bool"
    return t


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
