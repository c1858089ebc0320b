"""Run registered queries beside their SQL and compare all rows.

usage: python tools/check_oracle.py [sf_dir] [name prefix ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from docledger.session import local_session  # noqa: E402
from docledger.workload import ORACLES, QUERIES  # noqa: E402
from docledger.workload.fixtures import TABLES  # noqa: E402


def cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "~"
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, bool):
        return f"b{value}"
    if isinstance(value, int):
        return f"n{float(value)!r}"
    if isinstance(value, float):
        return f"n{value!r}"
    return f"{type(value).__name__[0]}{value}"


def table(frame):
    names = sorted(frame.columns)
    return names, sorted(tuple(cell(v) for v in row) for row in frame[names].astype(object).itertuples(index=False))


def main(argv: list[str]) -> int:
    sf = argv[0] if argv else "/root/testdata/sf0.01"
    wanted = argv[1:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    bad = 0
    for name, run in QUERIES.items():
        if wanted and not any(name.startswith(prefix) for prefix in wanted):
            continue
        started = time.time()
        try:
            left = run(spark, sf).toPandas()
            took = time.time() - started
            if name not in ORACLES:
                print(f"rows {name}: {len(left)} rows {took:.1f}s", flush=True)
                continue
            started = time.time()
            right = db.execute(ORACLES[name]).df()
            took2 = time.time() - started
            a, b = table(left), table(right)
            if a == b:
                print(f"ok   {name}: {len(left)} rows {took:.1f}s sql {took2:.1f}s", flush=True)
            else:
                bad += 1
                print(f"BAD  {name}: {len(left)} vs {len(right)} rows, columns {a[0]} vs {b[0]}")
                only_a, only_b = sorted(set(a[1]) - set(b[1])), sorted(set(b[1]) - set(a[1]))
                print("   spark only", len(only_a), only_a[:3], "\n   sql only  ", len(only_b), only_b[:3], flush=True)
        except Exception as error:  # noqa: BLE001 - report and go on
            bad += 1
            print(f"FAIL {name}: {str(error)[:600]}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
