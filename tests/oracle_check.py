"""Run registered queries in Spark and their SQL oracles in DuckDB; compare.

    python -m tests.oracle_check [sf_dir] [key ...]

Compares row count, column names and an order-insensitive hash of the values
(doubles rounded to 6 places).  Prints one line per key and a summary.
"""

from __future__ import annotations

import hashlib
import math
import sys
import time

import duckdb

from tidepool.sources.tables import TABLES


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NULL"
        return f"{round(v, 6):.6f}"
    if isinstance(v, bool):
        return "true" if v else "false"
    if hasattr(v, "item"):
        return _norm(v.item())
    return str(v)


def digest(columns, rows) -> str:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted("\x1f".join(_norm(r[i]) for i in order) for r in rows)
    h = hashlib.sha256()
    for ln in lines:
        h.update(ln.encode())
        h.update(b"\n")
    return h.hexdigest()


SPARK_TYPES = {"int": "int32", "bigint": "int64", "double": "float64", "string": "string",
               "boolean": "bool", "smallint": "int16", "tinyint": "int8", "float": "float32",
               "timestamp": "timestamp", "timestamp_ntz": "timestamp", "date": "date"}
DUCK_TYPES = {"INTEGER": "int32", "BIGINT": "int64", "DOUBLE": "float64", "VARCHAR": "string",
              "BOOLEAN": "bool", "SMALLINT": "int16", "TINYINT": "int8", "FLOAT": "float32",
              "TIMESTAMP": "timestamp", "DATE": "date", "HUGEINT": "int128"}


def type_diffs(spark_dtypes, duck_desc):
    s = {n: SPARK_TYPES.get(t, t) for n, t in spark_dtypes}
    d = {x[0]: DUCK_TYPES.get(str(x[1]), str(x[1])) for x in duck_desc}
    return {n: (s[n], d.get(n)) for n in s if n in d and s[n] != d[n]}


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, sf_dir: str, keys=None, verbose=True):
    sys.path.insert(0, ".")
    import __spark_entry__ as E

    qs, os_ = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    results = {}
    for k in keys or sorted(qs):
        t0 = time.time()
        try:
            df = qs[k](spark, sf_dir)
            cols = df.columns
            rows = [tuple(r) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            results[k] = ("spark-error", repr(e)[:800])
            if verbose:
                print(f"{k:28s} SPARK ERROR {repr(e)[:800]}", flush=True)
            continue
        ts = time.time() - t0
        if k not in os_:
            results[k] = ("rows-only", len(rows))
            if verbose:
                print(f"{k:28s} rows-only  rows={len(rows)}  {ts:.1f}s", flush=True)
            continue
        try:
            rel = con.sql(os_[k])
            ocols = rel.columns
            otypes = list(zip(rel.columns, rel.types))
            orows = rel.fetchall()
        except Exception as e:  # noqa: BLE001
            results[k] = ("sql-error", repr(e)[:800])
            if verbose:
                print(f"{k:28s} SQL ERROR {repr(e)[:800]}", flush=True)
            continue
        ok_cols = sorted(cols) == sorted(ocols)
        ok_n = len(rows) == len(orows)
        ok_h = ok_cols and digest(cols, rows) == digest(ocols, orows)
        tdiff = type_diffs(df.dtypes, otypes)
        status = "OK" if (ok_cols and ok_n and ok_h) else "MISMATCH"
        results[k] = (status, len(rows), len(orows), tdiff)
        if verbose:
            extra = "" if ok_cols else f" cols spark={sorted(cols)} sql={sorted(ocols)}"
            extra += f" TYPES {tdiff}" if tdiff else ""
            print(f"{k:28s} {status:8s} rows={len(rows)}/{len(orows)} hash={ok_h} {ts:.1f}s{extra}",
                  flush=True)
    return results


def main(argv):
    from tidepool.session import build_session

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    keys = argv[2:] or None
    spark = build_session("local[8]", 8)
    res = compare(spark, sf_dir, keys)
    bad = [k for k, v in res.items() if v[0] not in ("OK", "rows-only")]
    print(f"SUMMARY ok={sum(v[0] == 'OK' for v in res.values())} "
          f"rows_only={sum(v[0] == 'rows-only' for v in res.values())} bad={bad}")


if __name__ == "__main__":
    main(sys.argv)
