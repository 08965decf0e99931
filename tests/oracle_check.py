"""Run registered queries against their SQL on DuckDB: python tests/oracle_check.py [sf_dir] [prefix ...]"""

import pathlib
import sys
import time
import traceback

ROOT = pathlib.Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def rows_of(cols, data):
    """Rows as sorted text, columns by name."""
    order = sorted(range(len(cols)), key=lambda i: cols[i])

    def text(x):
        return "NULL" if x is None or x != x else repr(float(x)) if isinstance(x, float) else repr(x)

    return [cols[i] for i in order], sorted(tuple(text(r[i]) for i in order) for r in data)


def compare(spark, con, sf, run, sql):
    start = time.time()
    df = run(spark, sf)
    data = [tuple(r) for r in df.collect()]
    took = time.time() - start
    mine = rows_of(df.columns, data)
    print(f"  spark {took:5.2f}s", end="", flush=True)
    if sql is None:
        return len(mine[1]), None
    start = time.time()
    res = con.execute(sql)
    theirs = rows_of([c[0] for c in res.description], res.fetchall())
    print(f"  sql {time.time() - start:5.2f}s", end=" ", flush=True)
    if mine[0] != theirs[0]:
        return len(mine[1]), f"columns {mine[0]} / {theirs[0]}"
    if mine[1] != theirs[1]:
        a, b = set(mine[1]), set(theirs[1])
        return len(mine[1]), (
            f"{len(mine[1])} / {len(theirs[1])} rows, only here {len(a - b)}, only there {len(b - a)}\n"
            f"   {mine[0]}\n   {sorted(a - b)[:3]}\n   {sorted(b - a)[:3]}"
        )
    return len(mine[1]), None


def main():
    from barscope.session import local_session
    from __spark_entry__ import oracle_sql, queries

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    want = sys.argv[2:]
    spark, con, sqls, bad = local_session(), connect(sf), oracle_sql(), 0
    for name, run in queries().items():
        if want and not any(name.startswith(w) for w in want):
            continue
        t = time.time()
        try:
            n, err = compare(spark, con, sf, run, sqls.get(name))
        except Exception as e:  # noqa: BLE001
            n, err = -1, "".join(traceback.format_exception_only(e))[:300]
        bad += err is not None
        kind = "ok  " if err is None else "FAIL"
        print(f"{kind} {name:34s} {n:7d} rows {time.time() - t:6.2f}s {'' if name in sqls else '(rows only)'}", flush=True)
        if err:
            print("   ", err, flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
