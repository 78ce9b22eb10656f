"""Run registered queries on Spark and their SQL on DuckDB and compare the rows.

usage: python tools/check.py [sf] [name-part ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from netlens.contract import ORACLES, QUERIES  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if hasattr(value, "as_tuple"):
        return float(value)
    return value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in data], key=repr)


def main(sf: str, parts: list[str]) -> int:
    sf_dir = f"/root/testdata/sf{sf}"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    duck = duckdb.connect()
    for table in TABLES:
        duck.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    bad = 0
    for name, run in QUERIES.items():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            df = run(spark, sf_dir)
            got = rows(df.columns, df.collect())
        except Exception as exc:  # report and go on
            print(f"{name:34} SPARK ERROR {str(exc)[:400]}")
            bad += 1
            continue
        took = time.time() - start
        if name not in ORACLES:
            print(f"{name:34} {len(got):6} rows {took:5.1f}s (no SQL)")
            continue
        try:
            res = duck.execute(ORACLES[name])
            cols = [d[0] for d in res.description]
            want = rows(cols, res.fetchall())
        except Exception as exc:
            print(f"{name:34} DUCKDB ERROR {str(exc)[:400]}")
            bad += 1
            continue
        ok = sorted(cols) == sorted(df.columns) and got == want
        if not ok:
            bad += 1
            print(f"{name:34} MISMATCH spark={len(got)} duckdb={len(want)} {sorted(df.columns)} {sorted(cols)}")
            print("   only spark :", [r for r in got if r not in want][:3])
            print("   only duckdb:", [r for r in want if r not in got][:3])
        else:
            print(f"{name:34} {len(got):6} rows {took:5.1f}s ok" + ("" if got else "  EMPTY"))
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1] if len(sys.argv) > 1 else "0.01", sys.argv[2:]))
