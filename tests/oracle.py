"""Compare registered queries with their SQL on DuckDB: ``python tests/oracle.py [sf_dir] [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, bool) or v is None:
        return str(v)
    return repr(float(v)) if isinstance(v, int) else str(v)


def normalised(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def differences(df, con, sql: str) -> str | None:
    """None when equal, else what differs first."""
    got = normalised(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want = normalised([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns differ: spark only {set(got[0]) - set(want[0])}, sql only {set(want[0]) - set(got[0])}"
    if got[1] == want[1]:
        return None
    only_got, only_want = sorted(set(got[1]) - set(want[1]))[:3], sorted(set(want[1]) - set(got[1]))[:3]
    return f"{len(got[1])} vs {len(want[1])} rows; columns {got[0]}; spark only {only_got}; sql only {only_want}"


def main() -> None:
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry
    from lakepulse.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con = local_session(), connect(sf_dir)
    if os.environ.get("HOT_ROWS"):
        spark.conf.set("lakepulse.hotRows", os.environ["HOT_ROWS"])
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = []
    for name in sys.argv[2:] or queries:
        began = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in oracles:
                diff = differences(df, con, oracles[name])
            else:
                diff = None if df.count() else "no rows"
        except Exception as e:  # noqa: BLE001
            diff = f"{type(e).__name__}: {str(e)[:1500]}"
        print(f"{'ok  ' if diff is None else 'FAIL'} {name} {time.time() - began:.1f}s {diff or ''}", flush=True)
        if diff:
            bad.append(name)
    print(f"{len(bad)} of {len(sys.argv[2:] or queries)} differ: {bad}")


if __name__ == "__main__":
    main()
