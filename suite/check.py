"""Run registered queries and their oracles side by side: python -m suite.check [sf] [names...]."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

from meterstone.session import build_session
from suite.queries import load

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def close(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or (math.isnan(a) and math.isnan(b))
    return type(a) is type(b) and a == b


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        ([r[i] for i in order] for r in rows), key=lambda r: [(x is None, str(x)) for x in r]
    )


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = build_session(
        "check", "local[8]", **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    bad = 0
    for name, (run, sql) in load().items():
        if names and not any(name.startswith(n) for n in names):
            continue
        began = time.time()
        try:
            frame = run(spark, sf)
            got = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
            took = time.time() - began
            if sql is None:
                print(f"{name:28s} no oracle rows={len(got)} {took:.2f}s", flush=True)
                continue
            cursor = con.execute(sql)
            columns = [d[0] for d in cursor.description]
            want = rows_of(columns, cursor.fetchall())
        except Exception as error:  # report and go on with the next query
            bad += 1
            print(f"{name:28s} ERROR {str(error)[:1500]}", flush=True)
            continue
        if sorted(columns) != sorted(frame.columns):
            bad += 1
            print(f"{name:28s} COLUMNS {sorted(columns)} / {sorted(frame.columns)}", flush=True)
        elif len(got) != len(want) or any(
            not all(map(close, a, b)) for a, b in zip(got, want, strict=True)
        ):
            bad += 1
            print(f"{name:28s} DIFFERENT spark={len(got)} duckdb={len(want)}", flush=True)
            shown = 0
            for a, b in zip(got, want):
                if not all(map(close, a, b)) and shown < 2:
                    shown += 1
                    print("   cols", sorted(columns), "\n   spark", a, "\n   duck ", b, flush=True)
        else:
            print(f"{name:28s} ok rows={len(got)} {took:.2f}s", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
