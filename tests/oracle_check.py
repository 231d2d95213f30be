"""Run registered queries next to their SQL in DuckDB and compare whole results."""

import importlib
import math
import os
import sys
import time

import duckdb
import numpy as np
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duck(sf_dir):
    con = duckdb.connect()
    for name in ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
                 "conversations").split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if value is None or value is pd.NaT:
        return None
    if isinstance(value, (bool, np.bool_)):
        return bool(value)
    if isinstance(value, (int, np.integer)):
        return int(value)
    if isinstance(value, (float, np.floating)):
        if math.isnan(value):
            return None
        return round(float(value), 6)
    if isinstance(value, (list, tuple, np.ndarray)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name, query, sql, sf_dir):
    started = time.time()
    df = query(spark, sf_dir)
    spark_types = dict(df.dtypes)
    spark_rows = [tuple(r) for r in df.collect()]
    seconds = time.time() - started
    if sql is None:
        return ("rows", len(spark_rows), seconds, "")
    result = con.execute(sql)
    duck_columns = [c[0] for c in result.description]
    duck_types = {c[0]: str(c[1]) for c in result.description}
    duck_rows = result.fetchall()
    if sorted(df.columns) != sorted(duck_columns):
        return ("COLUMNS", len(spark_rows), seconds, f"{sorted(df.columns)} vs {sorted(duck_columns)}")
    left, right = rows_of(df.columns, spark_rows), rows_of(duck_columns, duck_rows)
    note = ""
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    odd = [f"{c}:{spark_types[c]}/{duck_types[c]}" for c in df.columns if kinds.get(spark_types[c], "?") != duck_types[c]]
    if odd:
        note = "types " + ",".join(odd)
    if left != right:
        extra = [r for r in left if r not in set(right)][:2] if len(left) < 200000 else []
        lacking = [r for r in right if r not in set(left)][:2] if len(left) < 200000 else []
        return ("DIFF", len(left), seconds, f"{len(left)} vs {len(right)} rows; spark {extra} duck {lacking}")
    return ("ok", len(left), seconds, note)


def main():
    from vellum.session import build_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    bindings = importlib.import_module("vellum.bindings")
    wanted = sys.argv[1:]
    spark = build_session("oracle-check", "8")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    bad = 0
    for name, query in bindings.QUERIES.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            state, n, seconds, note = compare(spark, con, name, query, bindings.ORACLES.get(name), sf_dir)
        except Exception as error:  # report every query, then fail
            state, n, seconds, note = "ERROR", 0, 0.0, str(error)[:700]
        if state not in ("ok", "rows"):
            bad += 1
        if state != "ok" or note or seconds > 5 or n == 0 or os.environ.get("VERBOSE"):
            print(f"{state:8} {name:34} rows={n:<8} {seconds:6.2f}s {note}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
