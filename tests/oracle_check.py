"""Run registered queries on Spark and their oracle SQL on DuckDB; compare
row count, column names and an order-insensitive hash of the values.

Usage: python tests/oracle_check.py [sf_dir] [name-substring ...]
"""

from __future__ import annotations

import datetime as dt
import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


EXACT = bool(os.environ.get("EXACT_FLOATS"))


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return v if EXACT else round(v, 6)
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            v = v.item()
        except Exception:
            pass
    if isinstance(v, float):
        return v if EXACT else round(v, 6)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


SPARK_TO_DUCK = {"IntegerType": "INTEGER", "LongType": "BIGINT", "DoubleType": "DOUBLE", "StringType": "VARCHAR",
                 "DateType": "DATE", "TimestampNTZType": "TIMESTAMP", "BooleanType": "BOOLEAN",
                 "TimestampType": "TIMESTAMP WITH TIME ZONE", "ShortType": "SMALLINT", "FloatType": "FLOAT"}


def duck_type(dtype):
    kind = type(dtype).__name__
    return duck_type(dtype.elementType) + "[]" if kind == "ArrayType" else SPARK_TO_DUCK.get(kind, kind)


def spark_types(sdf):
    return {f.name: duck_type(f.dataType) for f in sdf.schema}


def digest(rows):
    h = hashlib.sha256()
    for r in rows:
        h.update(repr(r).encode())
    return h.hexdigest()[:16]


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    pats = argv[2:]
    import __spark_entry__ as E
    if os.environ.get("PLAIN_SESSION"):
        # what a driver might build: no civicflow settings, non-UTC JVM zone
        from pyspark.sql import SparkSession
        spark = (SparkSession.builder.master("local[*]").config("spark.sql.shuffle.partitions", "8")
                 .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
                 .config("spark.driver.extraJavaOptions", "-Duser.timezone=America/Los_Angeles")
                 .getOrCreate())
    else:
        from civicflow.session import get_session
        spark = get_session("local[8]", 8)
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for name, fn in qs.items():
        if pats and not any(p in name for p in pats):
            continue
        t0 = time.time()
        try:
            sdf = fn(spark, sf_dir)
            srows = [tuple(r) for r in sdf.collect()]
            scols, srows = rows_of(sdf.columns, srows)
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"FAIL  {name}: spark error {type(e).__name__}: {str(e)[:400]}")
            continue
        ts = time.time() - t0
        if name not in sqls:
            print(f"ROWS  {name}: {len(srows)} rows (no oracle) {ts:.1f}s")
            continue
        try:
            res = con.execute(sqls[name])
            dcols = [d[0] for d in res.description]
            dtypes = {d[0]: str(d[1]) for d in res.description}
            dcols, drows = rows_of(dcols, res.fetchall())
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"FAIL  {name}: duckdb error {str(e)[:400]}")
            continue
        ok = scols == dcols and len(srows) == len(drows) and digest(srows) == digest(drows)
        st = spark_types(sdf)
        tdiff = {c: (st.get(c), dtypes.get(c)) for c in dtypes if st.get(c) != dtypes.get(c)}
        if ok and tdiff:
            print(f"TYPE  {name}: {tdiff}")
        if ok:
            print(f"OK    {name}: {len(srows)} rows {ts:.1f}s")
        else:
            bad += 1
            print(f"DIFF  {name}: cols {scols} vs {dcols}; rows {len(srows)} vs {len(drows)}")
            sset, dset = set(srows), set(drows)
            for r in list(sset - dset)[:3]:
                print("   spark only:", r)
            for r in list(dset - sset)[:3]:
                print("   duck  only:", r)
    print(f"{bad} problems")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
