"""Compare each registered Spark query with its DuckDB oracle SQL.

    python tests/oracle_check.py [sf_dir] [key ...]

Prints one line per key: row counts, column names, and whether the
order-insensitive multiset of rows is equal exactly and within 1e-9.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v, digits=None):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, digits) if digits is not None else v
    if isinstance(v, decimal.Decimal):
        return _norm(float(v), digits)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x, digits) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x, digits)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _norm(v.asDict(recursive=True), digits)
    if hasattr(v, "tolist"):
        return _norm(v.tolist(), digits)
    return v


def _key(row):
    return tuple((x is None, str(type(x)), str(x)) for x in row)


def compare(spark_rows, spark_cols, duck_rows, duck_cols, digits=None):
    order_s = sorted(range(len(spark_cols)), key=lambda i: spark_cols[i])
    order_d = sorted(range(len(duck_cols)), key=lambda i: duck_cols[i])
    a = sorted((tuple(_norm(r[i], digits) for i in order_s) for r in spark_rows), key=_key)
    b = sorted((tuple(_norm(r[i], digits) for i in order_d) for r in duck_rows), key=_key)
    return a == b, a, b


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    keys = [k for k in argv[1:] if not k.startswith("/")]
    from scorelens.session import get_spark
    import __spark_entry__ as E
    spark = get_spark("local[8]", 8, extra={"spark.driver.memory": "8g"})
    con = duck(sf_dir)
    qs, sql = E.queries(), E.oracle_sql()
    keys = keys or list(qs)
    bad = []
    for k in keys:
        t0 = time.time()
        try:
            df = qs[k](spark, sf_dir)
            rows = [tuple(r) for r in df.collect()]
            cols = df.columns
        except Exception as e:  # noqa: BLE001
            print(f"{k:28s} SPARK-ERROR {type(e).__name__}: {str(e)[:300]}")
            bad.append(k)
            continue
        ts = time.time() - t0
        if k not in sql:
            print(f"{k:28s} rows={len(rows):7d} (no oracle) {ts:.1f}s")
            continue
        try:
            res = con.execute(sql[k])
            dcols = [d[0] for d in res.description]
            drows = res.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"{k:28s} DUCK-ERROR {type(e).__name__}: {str(e)[:300]}")
            bad.append(k)
            continue
        same_cols = sorted(cols) == sorted(dcols)
        exact, a, b = compare(rows, cols, drows, dcols)
        near = exact or compare(rows, cols, drows, dcols, 9)[0]
        status = "OK" if (same_cols and exact) else ("NEAR" if same_cols and near else "DIFF")
        if status != "OK":
            bad.append(k)
        print(f"{k:28s} {status:4s} rows spark={len(rows)} duck={len(drows)} cols_ok={same_cols} "
              f"{ts:.1f}s")
        if status == "DIFF":
            if not same_cols:
                print("   spark cols", cols, "\n   duck cols ", dcols)
            sa, sb = set(a), set(b)
            print("   only spark:", list(sa - sb)[:3])
            print("   only duck: ", list(sb - sa)[:3])
    print("BAD:", bad)
    spark.stop()


if __name__ == "__main__":
    main(sys.argv)
