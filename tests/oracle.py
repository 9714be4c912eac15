"""Side-by-side check of the registered queries against their SQL in DuckDB."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return 0.0 if v == 0 else float(f"{v:.12g}")
    if isinstance(v, (datetime.date, datetime.datetime)):
        return str(v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(cell(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(spark, con, name, fn, sql, sf_dir):
    """None if equal, else what differs."""
    df = fn(spark, sf_dir)
    mine_cols, mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    their_cols, theirs = rows_of(cols, cur.fetchall())
    if mine_cols != their_cols:
        return f"columns {mine_cols} vs {their_cols}"
    if len(mine) != len(theirs):
        only = [r for r in mine if r not in set(theirs)][:2], [r for r in theirs if r not in set(mine)][:2]
        return f"{len(mine)} rows vs {len(theirs)}: {only}"
    if not mine:
        return "no rows"
    diff = [(a, b) for a, b in zip(mine, theirs) if a != b]
    return f"{len(diff)} of {len(mine)} rows differ, e.g. {diff[0]}" if diff else None


def main(sf_dir="/root/testdata/sf0.01", *only):
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry
    from tests.conftest import make_session

    spark = make_session()
    con = connect(sf_dir)
    sqls = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if only and not any(name.startswith(o) for o in only):
            continue
        t = time.time()
        try:
            if name in sqls:
                verdict = compare(spark, con, name, fn, sqls[name], sf_dir)
            else:
                n = fn(spark, sf_dir).count()
                verdict = None if n else "no rows"
        except Exception as e:  # noqa: BLE001
            verdict = f"{type(e).__name__}: {str(e)[:900]}"
        bad += verdict is not None
        print(f"{'ok ' if verdict is None else 'BAD'} {name} {time.time() - t:.2f}s {verdict or ''}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(*sys.argv[1:])
