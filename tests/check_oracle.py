"""Run registered queries beside their SQL twin: python tests/check_oracle.py [sf] [name ...]"""

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

import __spark_entry__ as entry
from folioframe.session import get_session


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return None if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return str([norm(x) for x in v])
    return str(v)


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:]
    folder = f"/root/testdata/sf{sf}"
    spark = get_session("check", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "16g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.sql(f"create view {f[:-8]} as select * from '{folder}/{f}'")
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = []
    for name, plan in queries.items():
        if names and not any(name.startswith(n) for n in names):
            continue
        t = time.time()
        try:
            df = plan(spark, folder)
            cols = sorted(df.columns)
            got = [tuple(norm(r[c]) for c in cols) for r in df.collect()]
        except Exception as e:
            print(f"ERR  {name}: {str(e)[:600]}", flush=True)
            bad.append(name)
            continue
        t1 = time.time() - t
        if name not in oracles:
            print(f"rows {name}: {len(got)} rows {t1:.1f}s", flush=True)
            continue
        try:
            t = time.time()
            rel = con.sql(oracles[name])
            types = dict(zip(rel.columns, [str(x) for x in rel.types]))
            ocols = sorted(rel.columns)
            rows = rel.fetchall()
            idx = [rel.columns.index(c) for c in ocols]
            want = [tuple(norm(r[i]) for i in idx) for r in rows]
        except Exception as e:
            print(f"SQLERR {name}: {str(e)[:600]}", flush=True)
            bad.append(name)
            continue
        t2 = time.time() - t
        key = lambda r: tuple("" if x is None else "\x01" + x for x in r)
        got.sort(key=key)
        want.sort(key=key)
        huge = [c for c, ty in types.items() if "HUGEINT" in ty or "DECIMAL" in ty or "[]" in ty or "STRUCT" in ty]
        spark_odd = [f.name for f in df.schema if f.dataType.simpleString().startswith(("decimal", "array", "struct", "map"))]
        note = (f" TYPES sql={huge}" if huge else "") + (f" spark={spark_odd}" if spark_odd else "")
        if cols != ocols:
            print(f"COLS {name}: {cols} vs {ocols}", flush=True)
            bad.append(name)
        elif got != want:
            a, b = set(got), set(want)
            print(f"DIFF {name}: {len(got)} vs {len(want)}; only spark {list(a - b)[:3]}; only sql {list(b - a)[:3]}", flush=True)
            bad.append(name)
        else:
            print(f"ok   {name}: {len(got)} rows spark {t1:.1f}s sql {t2:.1f}s{note}", flush=True)
            if len(got) == 0:
                print(f"     ^ EMPTY {name}")
    print("BAD:", bad)


if __name__ == "__main__":
    main()
