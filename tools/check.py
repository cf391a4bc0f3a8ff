"""Run the registered queries against their SQL: python tools/check.py [name-part ...] [--sf 0.01]."""

from __future__ import annotations

import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

from tidewatch.plans import catalogue, fixtures  # noqa: E402
from tidewatch.session import local_session  # noqa: E402


def cell(v):
    if v is None or v is pd.NaT:
        return "~"
    if isinstance(v, float):
        return "~" if math.isnan(v) else repr(round(v, 10) + 0.0)
    if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
        return "[" + ",".join(cell(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{cell(x)}" for k, x in sorted(v.items())) + "}"
    if hasattr(v, "asDict"):
        return cell(v.asDict())
    if isinstance(v, pd.Timestamp):
        return v.isoformat()
    if type(v).__name__ == "Decimal":
        return repr(round(float(v), 10) + 0.0)
    if hasattr(v, "item"):
        return cell(v.item())
    return str(v)


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted("|".join(cell(r[i]) for i in order) for r in records)


def main(argv):
    sf = "0.01"
    if "--sf" in argv:
        i = argv.index("--sf")
        sf = argv[i + 1]
        argv = argv[:i] + argv[i + 2:]
    sf_dir = f"/root/testdata/sf{sf}"
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in fixtures.RAW:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    spark = local_session()
    bad = 0
    for name, run in catalogue.QUERIES.items():
        if argv and not any(a in name for a in argv):
            continue
        t0 = time.time()
        try:
            df = run(spark, sf_dir)
            got = rows_of(df.columns, [tuple(r) for r in df.collect()])
            t1 = time.time() - t0
            sql = catalogue.ORACLES.get(name)
            if sql is None:
                print(f"rows  {name}: {len(got)} rows {t1:.1f}s", flush=True)
                continue
            rel = con.sql(sql)
            types = dict(zip(rel.columns, [str(x) for x in rel.types]))
            want = rows_of(rel.columns, rel.fetchall())
            problems = []
            if sorted(df.columns) != sorted(rel.columns):
                problems.append(f"columns {sorted(df.columns)} / {sorted(rel.columns)}")
            if got != want:
                in_got, in_want = set(got), set(want)
                only_g = [r for r in got if r not in in_want][:3]
                only_w = [r for r in want if r not in in_got][:3]
                problems.append(f"rows {len(got)}/{len(want)}\n   cols {sorted(df.columns)}\n   spark {only_g}\n   sql   {only_w}")
            kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
            pairs = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
                     "timestamp_ntz": "TIMESTAMP", "date": "DATE"}
            odd = {c: (k, types.get(c)) for c, k in kinds.items() if k in pairs and types.get(c) != pairs[k]}
            if odd:
                problems.append(f"types {odd}")
            if len(got) == 0:
                problems.append("no rows")
            if problems:
                bad += 1
                print(f"BAD   {name} {t1:.1f}s: " + "\n  ".join(problems), flush=True)
            else:
                print(f"ok    {name}: {len(got)} rows {t1:.1f}s", flush=True)
        except Exception as e:  # report and go on with the next query
            bad += 1
            print(f"FAIL  {name}: {type(e).__name__}: {str(e)[:1500]}", flush=True)
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
