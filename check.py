"""Run every query and its checking SQL side by side: python check.py [name ...] (CHECK_DIR, default sf0.01)."""

import importlib.util
import os
import sys
import time
import warnings

import duckdb

warnings.filterwarnings("ignore")
here = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, here)
from feedloom.session import build_session  # noqa: E402

spec = importlib.util.spec_from_file_location("entry", os.path.join(here, "__spark_entry__.py"))
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)

NAMES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
         "conversations").split()


def cell(v):
    return repr(round(v, 6)) if isinstance(v, float) else repr(v)


def rows_of(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def main():
    folder = os.environ.get("CHECK_DIR", "/root/testdata/sf0.01")
    spark = build_session("check", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    db = duckdb.connect()
    for name in NAMES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    queries, checks = entry.queries(), entry.oracle_sql()
    wanted = sys.argv[1:] or list(queries)
    bad = []
    for name in wanted:
        start = time.time()
        try:
            df = queries[name](spark, folder)
            got = df.collect()
            took = time.time() - start
            if name not in checks:
                print(f"ROWS  {name:28s} {len(got):7d} rows {took:6.2f}s", flush=True)
                continue
            cursor = db.execute(checks[name])
            columns = [c[0] for c in cursor.description]
            want = cursor.fetchall()
            if sorted(columns) != sorted(df.columns):
                bad.append(name)
                print(f"FAIL  {name}: columns {sorted(df.columns)} vs {sorted(columns)}", flush=True)
                continue
            a, b = rows_of(got, df.columns), rows_of(want, columns)
            if a == b:
                print(f"OK    {name:28s} {len(a):7d} rows {took:6.2f}s", flush=True)
                continue
            bad.append(name)
            only_a, only_b = sorted(set(a) - set(b))[:2], sorted(set(b) - set(a))[:2]
            print(f"FAIL  {name}: {len(a)} vs {len(b)} rows {took:.2f}s; columns {sorted(columns)}\n"
                  f"  spark {str(only_a)[:1500]}\n  check {str(only_b)[:1500]}", flush=True)
        except Exception as error:  # noqa: BLE001
            bad.append(name)
            print(f"ERROR {name}: {type(error).__name__} {str(error)[:900]}", flush=True)
    print(f"{len(wanted) - len(bad)} of {len(wanted)} fine; bad: {bad}")
    spark.stop()


if __name__ == "__main__":
    main()
