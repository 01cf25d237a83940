"""Local stand-in for the driver's correctness gate.

Runs a registered Spark query and its DuckDB oracle on the same parquet
tables and compares row count, column names and an order-insensitive hash of
the values (columns sorted by name, rows sorted).
"""

from __future__ import annotations

import datetime as dt
import hashlib
import math
import sys
import time

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v)
    if isinstance(v, (list, tuple)):
        return [_norm(x) for x in v]
    if isinstance(v, dict):
        return {k: _norm(x) for k, x in v.items()}
    if isinstance(v, (dt.date, dt.datetime)):
        return v.isoformat()
    if hasattr(v, "asDict"):
        return _norm(v.asDict())
    return v


def _digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    keyed = sorted(repr([_norm(r[i]) for i in order]) for r in rows)
    return hashlib.sha256("\n".join(keyed).encode()).hexdigest(), keyed


_SPARK2DUCK = {"IntegerType": "INTEGER", "LongType": "BIGINT", "DoubleType": "DOUBLE", "StringType": "VARCHAR",
               "BooleanType": "BOOLEAN", "DateType": "DATE", "FloatType": "FLOAT", "ShortType": "SMALLINT",
               "ByteType": "TINYINT", "TimestampNTZType": "TIMESTAMP", "TimestampType": "TIMESTAMP WITH TIME ZONE"}


def spark_type_name(dt_) -> str:
    n = type(dt_).__name__
    if n == "ArrayType":
        return spark_type_name(dt_.elementType) + "[]"
    if n == "DecimalType":
        return f"DECIMAL({dt_.precision},{dt_.scale})"
    return _SPARK2DUCK.get(n, n)


def compare(spark, sf_dir: str, q, con=None, verbose: bool = False) -> dict:
    con = con or duck(sf_dir)
    t0 = time.time()
    sdf = q.fn(spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    scols = list(sdf.columns)
    t1 = time.time()
    res = {"name": q.name, "spark_rows": len(srows), "spark_sec": round(t1 - t0, 2)}
    if q.sql is None:
        res["status"] = "rows-only"
        return res
    rel = con.sql(q.sql)
    dcols = list(rel.columns)
    drows = rel.fetchall()
    res["oracle_rows"] = len(drows)
    if sorted(scols) != sorted(dcols):
        res["status"] = f"COLUMNS {sorted(scols)} vs {sorted(dcols)}"
        return res
    stypes = {f.name: spark_type_name(f.dataType) for f in sdf.schema.fields}
    dtypes = {c: str(t) for c, t in zip(dcols, rel.types)}
    tdiff = {c: (stypes[c], dtypes[c]) for c in scols if stypes[c] != dtypes[c]}
    hs, ks = _digest(scols, srows)
    hd, kd = _digest(dcols, drows)
    if len(srows) != len(drows):
        res["status"] = "ROWCOUNT"
    elif hs != hd:
        res["status"] = "VALUES"
    else:
        res["status"] = "ok"
    if tdiff:
        res["types"] = tdiff
    if res["status"] != "ok" and verbose:
        diff_s = [k for k in ks if k not in set(kd)][:3]
        diff_d = [k for k in kd if k not in set(ks)][:3]
        res["spark_only"] = diff_s
        res["oracle_only"] = diff_d
    return res


def main(argv):
    sys.path.insert(0, ".")
    from nazar.session import build_session
    from nazar.plans.catalog import all_queries
    sf_dir = "/root/testdata/sf0.01"
    names = argv[1:]
    spark = build_session("local[8]", 8)
    con = duck(sf_dir)
    qs = all_queries()
    bad = 0
    for name, q in qs.items():
        if names and not any(name.startswith(n) for n in names):
            continue
        try:
            r = compare(spark, sf_dir, q, con, verbose=True)
        except Exception as e:  # noqa: BLE001
            r = {"name": name, "status": f"ERROR {type(e).__name__}: {str(e)[:300]}"}
        if r["status"] not in ("ok", "rows-only"):
            bad += 1
        print(r, flush=True)
    print(f"{bad} failing", flush=True)


if __name__ == "__main__":
    main(sys.argv)
