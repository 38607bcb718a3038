"""Runs queries and their SQL side by side: python -m driver.check [sf] [names...]."""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

import duckdb

from driver import base


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (float, decimal.Decimal)):
        return round(float(value), 6)
    if isinstance(value, (datetime.date, datetime.datetime)):
        return str(value)
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((repr([plain(r[i]) for i in order]) for r in rows))


def duck(sf_dir):
    con = duckdb.connect()
    for name in base.TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def compare(spark, con, sf_dir, name):
    started = time.time()
    frame = base.QUERIES[name](spark, sf_dir)
    got = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    spent = time.time() - started
    if name not in base.ORACLES:
        return "rows-only", len(got[1]), spent, ""
    started = time.time()
    done = con.execute(base.ORACLES[name])
    want = rows_of([d[0] for d in done.description], done.fetchall())
    oracle = time.time() - started
    if got == want:
        return "ok", len(got[1]), spent, f"oracle {oracle:.1f}s"
    if got[0] != want[0]:
        return "COLUMNS", len(got[1]), spent, f"{got[0]} vs {want[0]}"
    mine, theirs = set(got[1]) - set(want[1]), set(want[1]) - set(got[1])
    detail = f"{len(got[1])} vs {len(want[1])} rows; {len(mine)}/{len(theirs)} differ\n"
    detail += "   spark  " + " ".join(sorted(mine)[:2])[:700] + "\n   oracle " + " ".join(sorted(theirs)[:2])[:700]
    return "DIFF", len(got[1]), spent, detail


def main():
    from ledgerline.session import local_session

    import driver.catalog  # noqa: F401

    scale = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{scale}"
    names = sys.argv[2:] or list(base.QUERIES)
    spark = local_session(os.environ.get("CPUS", "8"))
    con = duck(sf_dir)
    bad = 0
    for name in names:
        try:
            status, count, spent, detail = compare(spark, con, sf_dir, name)
        except Exception as error:  # noqa: BLE001
            status, count, spent, detail = "ERROR", 0, 0.0, str(error)[:1500]
        bad += status not in ("ok", "rows-only")
        flag = " EMPTY" if count == 0 else ""
        print(f"{status:9} {name:28} {count:8} rows {spent:6.1f}s {detail}{flag}", flush=True)
    print("failures:", bad)
    spark.stop()


if __name__ == "__main__":
    main()
