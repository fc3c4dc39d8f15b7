"""Compare registered queries with their SQL: ``python tools/check.py <sf_dir> [name prefix ...]``."""

from __future__ import annotations

import math
import os
import sys
import tempfile
import time
from importlib import import_module

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from logsieve.plans.registry import REGISTRY  # noqa: E402
from logsieve.plans.views import TABLES  # noqa: E402
from logsieve.session import build_session  # noqa: E402


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, bool) or value is None:
        return str(value)
    return repr(float(value)) if type(value).__name__ == "Decimal" else str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(normal(row[i]) for i in order) for row in rows)


def main() -> None:
    sf_dir, prefixes = sys.argv[1], sys.argv[2:]
    from logsieve.plans import _MODULES
    for name in _MODULES:
        try:
            import_module(f"logsieve.plans.{name}")
        except ModuleNotFoundError as missing:
            print("skipped", missing)
    spark = build_session(
        master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="8g",
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="check-"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    duck = duckdb.connect()
    for name in TABLES:
        duck.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    bad = 0
    for name, q in REGISTRY.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        try:
            start = time.time()
            df = q.build(spark, sf_dir)
            got = rows_of(df.columns, df.collect())
            took = time.time() - start
            if q.sql is None:
                print(f"ROWS  {name}: {len(got)} rows {took:.1f}s {got[:2]}")
                continue
            start = time.time()
            names = list(duck.sql(q.sql).columns)
            want = rows_of(names, duck.execute(q.sql).fetchall())
            duck_took = time.time() - start
            if sorted(names) != sorted(df.columns):
                bad += 1
                print(f"COLS  {name}: {sorted(df.columns)} != {sorted(names)}")
            elif got != want:
                bad += 1
                odd = [(a, b) for a, b in zip(got, want) if a != b][:2]
                print(f"DIFF  {name}: {len(got)} / {len(want)} rows, {str(odd)[:1500]}")
            else:
                print(f"ok    {name}: {len(got)} rows spark {took:.1f}s duck {duck_took:.1f}s {str(got[:1])[:160]}")
        except Exception as failure:  # report all of them, not the first
            bad += 1
            print(f"FAIL  {name}: {type(failure).__name__}: {str(failure)[:900]}")
    print("bad:", bad)
    sys.exit(1 if bad else 0)


if __name__ == "__main__":
    main()
