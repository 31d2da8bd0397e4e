"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

Usage: python tests/oracle_check.py [sf_dir] [key ...]
Prints one line per key: rows spark/duckdb, schema match, value match.
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if hasattr(v, "isoformat"):
        return str(v)
    if isinstance(v, (list, tuple)):
        return str([norm(x) for x in v])
    return v if isinstance(v, (int, str, bool)) else str(v)


def rows_of(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in records), key=repr)


def duck_connect(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = Path(sf_dir) / f"{t}.parquet"
        if p.exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def compare(spark, sf_dir, keys=None, verbose=True):
    import __spark_entry__ as E
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck_connect(sf_dir)
    results = {}
    for k in (keys or list(qs)):
        t0 = time.time()
        try:
            df = qs[k](spark, sf_dir)
            scols = df.columns
            srows = [tuple(r) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            results[k] = ("spark-error", str(e)[:400])
            if verbose:
                print(f"{k:40s} SPARK ERROR {str(e)[:400]}")
            continue
        t1 = time.time()
        if k not in sqls:
            results[k] = ("no-oracle", len(srows))
            if verbose:
                print(f"{k:40s} spark={len(srows):7d} (no oracle) {t1 - t0:.1f}s")
            continue
        try:
            rel = con.sql(sqls[k])
            dcols = rel.columns
            drows = rel.fetchall()
        except Exception as e:  # noqa: BLE001
            results[k] = ("duck-error", str(e)[:400])
            if verbose:
                print(f"{k:40s} DUCK ERROR {str(e)[:600]}")
            continue
        schema_ok = sorted(scols) == sorted(dcols)
        a, b = rows_of(scols, srows), rows_of(dcols, drows)
        ok = schema_ok and a == b
        results[k] = ("ok" if ok else "mismatch", len(srows), len(drows))
        if verbose:
            print(f"{k:40s} spark={len(srows):7d} duck={len(drows):7d} schema={'ok' if schema_ok else 'BAD'} "
                  f"values={'ok' if a == b else 'DIFF'} {t1 - t0:.1f}s")
            if not schema_ok:
                print("   spark cols", scols, "\n   duck cols ", dcols)
            elif a != b:
                sa, sb = set(a), set(b)
                print("   only spark:", list(sa - sb)[:3])
                print("   only duck: ", list(sb - sa)[:3])
    return results


if __name__ == "__main__":
    from auditlake.session import get_spark
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    ks = sys.argv[2:] or None
    sp = get_spark("local[8]")
    res = compare(sp, sf, ks)
    bad = [k for k, v in res.items() if v[0] not in ("ok", "no-oracle")]
    print("BAD:", bad)
