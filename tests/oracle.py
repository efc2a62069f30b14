"""Compare registered queries with their SQL on the generated tables (also a command line tool)."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else (int(v) if v == int(v) and abs(v) < 1e15 else v)
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def compare(df, con, sql: str):
    """(ok, message) after an order-insensitive comparison of all rows."""
    s_cols, s_rows = _rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    o_cols, o_rows = _rows(names, cur.fetchall())
    if s_cols != o_cols:
        return False, f"columns {s_cols} != {o_cols}"
    if s_rows != o_rows:
        only_s = [r for r in s_rows if r not in set(o_rows)][:2] if len(s_rows) < 200000 else []
        only_o = [r for r in o_rows if r not in set(s_rows)][:2] if len(s_rows) < 200000 else []
        return False, f"{len(s_rows)} vs {len(o_rows)} rows\n   spark only {str(only_s)[:700]}\n   sql only   {str(only_o)[:700]}"
    return True, f"{len(s_rows)} rows"


def main(sf: str, names: list[str]):
    from pyspark.sql import SparkSession

    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry

    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{sf}"
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = []
    for name in names or queries:
        t0 = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in oracles:
                ok, msg = compare(df, con, oracles[name])
            else:
                ok, msg = True, f"{len(df.collect())} rows (no SQL)"
        except Exception as e:  # report and go on with the next query
            ok, msg = False, f"{type(e).__name__}: {str(e)[:900]}"
        if not ok:
            bad.append(name)
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - t0:.2f}s {msg}", flush=True)
    print(f"{len(bad)} failing: {bad}")


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
