"""Run bound queries on Spark and DuckDB and compare them as bags of rows."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _cell(v):
    if v is None:
        return "~"
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 9) + 0.0)
    if isinstance(v, bool):
        return str(v)
    return str(v)


def bag(rows, names, order):
    idx = [names.index(n) for n in order]
    return sorted(tuple(_cell(r[i]) for i in idx) for r in rows)


def compare(spark, con, name, binding, folder):
    """(rows, message); an empty message means equal."""
    t0 = time.time()
    df = binding.run(spark, folder)
    got = [tuple(r) for r in df.collect()]
    compare.spark_seconds = time.time() - t0
    if binding.sql is None:
        return len(got), ""
    cur = con.execute(binding.oracle())
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    order = sorted(names)
    if sorted(df.columns) != order:
        return len(got), f"columns {df.columns} vs {names}"
    a, b = bag(got, df.columns, order), bag(want, names, order)
    if a == b:
        return len(got), ""
    sa, sb = set(a), set(b)
    return len(got), f"rows {len(a)} vs {len(b)}; only spark {sorted(sa - sb)[:3]}; only sql {sorted(sb - sa)[:3]}"


if __name__ == "__main__":
    from daymart.bindings import all_bindings
    from daymart.session import build_session

    folder = f"/root/testdata/{sys.argv[1] if len(sys.argv) > 1 else 'sf0.01'}"
    only = sys.argv[2:]
    spark = build_session("oracle", "local[8]", 8, {"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name, b in all_bindings().items():
        if only and not any(name.startswith(o) for o in only):
            continue
        t0 = time.time()
        try:
            n, msg = compare(spark, con, name, b, folder)
        except Exception as e:  # report and go on
            n, msg = -1, f"{type(e).__name__}: {str(e)[:600]}"
        bad += bool(msg)
        print(f"{'BAD ' if msg else 'ok  '} {name:32s} rows={n:7d} {time.time() - t0:6.2f}s spark={getattr(compare, 'spark_seconds', 0):6.2f}s {'' if b.sql else '(no sql)'} {msg}", flush=True)
    print("bad:", bad)
