"""Runs a query on Spark and its SQL on DuckDB over the same tables and compares the rows."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, decimal.Decimal):
        return round(float(x), 6)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, datetime.date):
        return x.isoformat()
    return x


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def compare(spark, sf_dir, query, sql):
    """None if names and rows agree, else what differs."""
    df = query(spark, sf_dir)
    a_names, a = rows_of(df.columns, [tuple(r) for r in df.collect()])
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    res = con.execute(sql)
    b_names, b = rows_of([d[0] for d in res.description], res.fetchall())
    if a_names != b_names:
        return f"columns {a_names} against {b_names}"
    if len(a) != len(b):
        return f"{len(a)} rows against {len(b)}; only left {sorted(set(a) - set(b), key=str)[:2]}; only right {sorted(set(b) - set(a), key=str)[:2]}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} of {len(a)} rows differ, as {bad[0]} in {a_names}" if bad else None


if __name__ == "__main__":
    import __spark_entry__ as entry
    from airstrata.session import build

    spark = build()
    spark.sparkContext.setLogLevel("ERROR")
    names, sf = [x for x in sys.argv[1:] if "/" not in x], next((x for x in sys.argv[1:] if "/" in x), "/root/testdata/sf0.01")
    sqls, qs = entry.oracle_sql(), entry.queries()
    names = [q for q in qs if not names or any(q == n or n.endswith("*") and q.startswith(n[:-1]) for n in names)]
    bad = 0
    for n in names:
        began = time.time()
        try:
            said = compare(spark, sf, qs[n], sqls[n]) if n in sqls else f"no SQL; {qs[n](spark, sf).count()} rows"
        except Exception as e:  # noqa: BLE001
            said = f"{type(e).__name__}: {str(e)[:1500]}"
        bad += bool(said) and n in sqls
        print(f"{n}: {said or 'equal'} ({time.time() - began:.1f} s)", flush=True)
    print(f"{len(names)} queries, {bad} wrong")
