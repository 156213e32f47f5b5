"""Run registered queries in Spark and their SQL in DuckDB, and compare all cells.

Usage: python -m checks.compare SF_DIR [query ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def _cell(x):
    if x is None:
        return (0, "")
    if isinstance(x, bool):
        return (1, str(x))
    if isinstance(x, int):
        return (1, str(x))
    if isinstance(x, float):
        return (1, str(int(x)) if x == math.floor(x) else f"{x:.9g}")
    return (1, str(x))


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, sf: str, name: str, query, sql: str | None) -> tuple[bool, str]:
    start = time.time()
    df = query(spark, sf)
    got = rows_of(df.columns, df.collect())
    spent = time.time() - start
    if sql is None:
        return True, f"{len(got)} rows, no SQL, {spent:.1f}s"
    start = time.time()
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = rows_of(cols, cur.fetchall())
    note = f"{len(got)} / {len(want)} rows, spark {spent:.1f}s duckdb {time.time() - start:.1f}s"
    if sorted(cols) != sorted(df.columns):
        return False, f"{note}; columns {sorted(df.columns)} vs {sorted(cols)}"
    if got != want:
        names = sorted(cols)
        a, b = [r for r in got if r not in set(want)], [r for r in want if r not in set(got)]
        text = f"{note}; {len(a)} only in spark, {len(b)} only in duckdb"
        for x, y in list(zip(a, b))[:2]:
            text += "".join(f"\n    {n}: {p[1][:150]!r} | {w[1][:150]!r}" for n, p, w in zip(names, x, y) if p != w)
        if not (a and b):
            text += f"\n    {str((a or b)[:1])[:400]}"
        return False, text
    return True, note


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def main(sf: str, names: list[str]) -> int:
    from checks.oracles import ORACLES
    from checks.queries import QUERIES
    from listmill.session import build_session

    spark = build_session("local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    bad = 0
    for name in names or QUERIES:
        try:
            ok, note = compare(spark, con, sf, name, QUERIES[name], ORACLES.get(name))
        except Exception as exc:  # noqa: BLE001
            ok, note = False, f"{type(exc).__name__}: {str(exc)[:500]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name}: {note}", flush=True)
    print(f"{bad} failed")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
