"""Run registered queries against their SQL twins: ``python -m checks.compare [sf_dir] [name part ...]``."""

import math
import sys
import time

import duckdb

from checks import all_queries
from licensum.session import local_session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return repr(v)
    if isinstance(v, (list, tuple)):
        return str([_plain(x) for x in v])
    if isinstance(v, dict):
        return str({k: _plain(x) for k, x in v.items()})
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=lambda r: [(x is None, x or "") for x in r])


def twin(con, sql):
    cur = con.execute(sql)
    return rows_of([d[0] for d in cur.description], cur.fetchall())


def main(folder="/root/testdata/sf0.01", *parts):
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    bad = []
    for name, fn in all_queries.QUERIES.items():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            df = fn(spark, folder)
            columns, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
            spent = time.time() - start
            if name not in all_queries.ORACLES:
                print(f"rows  {name} {len(got)} {spent:.1f}s", flush=True)
                continue
            want_columns, want = twin(con, all_queries.ORACLES[name])
        except Exception as e:
            bad.append(name)
            print(f"ERROR {name} {str(e)[:700]}", flush=True)
            continue
        if (columns, got) == (want_columns, want):
            print(f"ok    {name} {len(got)} {spent:.1f}s (sql {time.time() - start - spent:.1f}s)", flush=True)
        else:
            bad.append(name)
            diff = next(((a, b) for a, b in zip(got, want) if a != b), None)
            print(f"DIFF  {name} rows {len(got)}/{len(want)} columns {columns == want_columns or (columns, want_columns)} first {str(diff)[:900]}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(*sys.argv[1:])
