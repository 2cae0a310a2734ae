"""Runs registered queries on Spark and their SQL on DuckDB and compares the results.

    python tests/oracle_check.py /root/testdata/sf0.01 dq_ src_csv ...
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def canonical(value):
    """A form in which equal results of both engines are equal."""
    if value is None:
        return ("null",)
    if isinstance(value, bool):
        return ("bool", value)
    if isinstance(value, int):
        return ("int", value)
    if isinstance(value, float):
        return ("null",) if math.isnan(value) else ("float", repr(value + 0.0))
    if isinstance(value, (list, tuple)):
        return ("list", tuple(canonical(v) for v in value))
    if isinstance(value, dict):
        return ("map", tuple(sorted((str(k), canonical(v)) for k, v in value.items())))
    return (type(value).__name__, str(value))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(canonical(r[i]) for i in order) for r in rows)


def compare(spark, con, sf: str, query, oracle: str | None) -> str | None:
    """None if both sides agree, else what differs."""
    df = query(spark, sf)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if oracle is None:
        return None if got_cols else "no columns"
    res = con.execute(oracle)
    want_cols, want = rows_of([d[0] for d in res.description], res.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}\n  got {got[:2]}\n  want {want[:2]}"
    if not got:
        return "no rows on either side"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        g, w = bad[0]
        diff = [(c, x, y) for c, x, y in zip(got_cols, g, w) if x != y]
        return f"{len(bad)} of {len(got)} rows differ, first: {diff}"
    return None


def main(argv):
    import __spark_entry__ as entry
    from veriloom.session import build_session

    sf, wanted = argv[0], argv[1:]
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g",
                                                "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, oracles = connect(sf), entry.queries(), entry.oracle_sql()
    failed = []
    for name, fn in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            problem = compare(spark, con, sf, fn, oracles.get(name))
        except Exception as e:
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        kind = "sql" if name in oracles else "rows"
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} [{kind}] {time.time() - start:.1f}s", flush=True)
        if problem:
            failed.append(name)
            print("   ", problem, flush=True)
    print(f"{len(failed)} failed: {' '.join(failed)}")


if __name__ == "__main__":
    main(sys.argv[1:])
