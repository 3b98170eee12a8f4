"""Run registered queries and compare them with their DuckDB statements.

    python tools/check_queries.py [--sf 0.01] [key ...]
"""

from __future__ import annotations

import argparse
import sys
import time
import traceback
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from terrascope.plans import catalog  # noqa: E402
from terrascope.plans.inputs import BASE_TABLES  # noqa: E402
from terrascope.session import local_session  # noqa: E402


def canonical(table) -> list[tuple]:
    names = sorted(table.column_names)
    columns = [table.column(n).to_pylist() for n in names]
    key = lambda row: tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)
    return sorted(zip(*columns), key=key) if columns else []


def close(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or abs(a - b) <= 1.5e-6 or (a != a and b != b)
    return a == b


def compare(spark_table, duck_table) -> str:
    a_schema = {f.name: str(f.type) for f in spark_table.schema}
    b_schema = {f.name: str(f.type) for f in duck_table.schema}
    if a_schema != b_schema:
        return f"schema {a_schema} != {b_schema}"
    if spark_table.num_rows != duck_table.num_rows:
        return f"rows {spark_table.num_rows} != {duck_table.num_rows}"
    left, right = canonical(spark_table), canonical(duck_table)
    if left == right:
        return "ok"
    wrong = [(x, y) for x, y in zip(left, right) if x != y]
    near = all(all(close(p, q) for p, q in zip(x, y)) for x, y in wrong)
    names = sorted(spark_table.column_names)
    return f"{'near' if near else 'VALUES'} {len(wrong)} of {len(left)} rows differ, columns {names}, e.g. {wrong[0][0]} vs {wrong[0][1]}"


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("keys", nargs="*")
    args = parser.parse_args()
    folder = f"/root/testdata/sf{args.sf}"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    db = duckdb.connect()
    for name in BASE_TABLES:
        db.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    bad = 0
    for key, q in catalog.REGISTRY.items():
        if args.keys and not any(key == k or (k.endswith("*") and key.startswith(k[:-1])) for k in args.keys):
            continue
        start = time.time()
        try:
            mine = q.run(spark, folder).toArrow()
            spark_s = time.time() - start
            if q.check is None:
                print(f"rows  {key:28s} {mine.num_rows:8d} rows {spark_s:6.2f}s", flush=True)
                continue
            start = time.time()
            theirs = db.execute(q.check).to_arrow_table()
            verdict = compare(mine, theirs)
            print(f"{'ok   ' if verdict == 'ok' else 'FAIL '} {key:28s} {mine.num_rows:8d} rows {spark_s:6.2f}s duck {time.time() - start:5.2f}s {'' if verdict == 'ok' else verdict}", flush=True)
            bad += verdict != "ok"
        except Exception as error:  # noqa: BLE001
            bad += 1
            text = str(error).split("\nJVM stacktrace")[0]
            print(f"ERROR {key}: {type(error).__name__}: {text[:900]}", flush=True)
            if args.keys:
                traceback.print_exc(limit=-4)
    print(f"{bad} problems")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
