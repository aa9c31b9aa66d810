"""Compare registered queries with their SQL in DuckDB: check_oracle.py DIR [name-part ...]"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (float, decimal.Decimal)):
        f = float(v)
        return "nan" if math.isnan(f) else f"{f:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(norm(x) for x in v.values()) + "}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(norm(r[i]) for i in order) for r in rows)


def spark_rows(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(con, sql):
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    return rows_of(columns, cur.fetchall())


def main() -> int:
    import __spark_entry__ as entry
    from flatcel.session import local_session

    sf_dir, parts = sys.argv[1], sys.argv[2:]
    spark = local_session("check")
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = duck(sf_dir), entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if parts and not any(p in name for p in parts):
            continue
        t0 = time.time()
        try:
            cols, got = spark_rows(fn(spark, sf_dir))
        except Exception as e:  # report and go on
            bad += 1
            print(f"{name:32s} SPARK ERROR {str(e)[:1500]}", flush=True)
            continue
        t1 = time.time()
        if name not in sqls:
            print(f"{name:32s} rows={len(got):7d} no oracle  spark {t1 - t0:5.1f}s", flush=True)
            continue
        try:
            dcols, want = duck_rows(con, sqls[name])
        except Exception as e:
            bad += 1
            print(f"{name:32s} SQL ERROR {str(e)[:900]}", flush=True)
            continue
        ok = cols == dcols and got == want
        bad += not ok
        print(f"{name:32s} {'ok ' if ok else 'BAD'} rows={len(got):7d}/{len(want)} spark {t1 - t0:5.1f}s sql {time.time() - t1:5.1f}s", flush=True)
        if not ok:
            if cols != dcols:
                print("   columns", cols, dcols)
            a, b = set(got), set(want)
            print("   only spark", sorted(a - b)[:4], "\n   only sql  ", sorted(b - a)[:4])
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
