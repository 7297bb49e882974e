"""Run registered queries beside their SQL and report differences.

    python tests/check.py [--sf DIR] [name-prefix ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def _plain(value):
    if value is None:
        return None
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, _plain(v)) for k, v in value.items()))
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    return value


def rows_of(table) -> list:
    names = sorted(table.column_names)
    columns = [table.column(n).to_pylist() for n in names]
    return sorted(
        (tuple(_plain(v) for v in row) for row in zip(*columns)),
        key=lambda row: tuple((v is not None, type(v).__name__, v) if v is not None else (False, '', 0) for v in row),
    )


def compare(name, spark_table, duck_table) -> str | None:
    left, right = sorted(spark_table.column_names), sorted(duck_table.column_names)
    if left != right:
        return f"columns {left} vs {right}"
    if spark_table.num_rows != duck_table.num_rows:
        return f"rows {spark_table.num_rows} vs {duck_table.num_rows}"
    types = [
        (n, str(spark_table.schema.field(n).type), str(duck_table.schema.field(n).type))
        for n in left
        if str(spark_table.schema.field(n).type) != str(duck_table.schema.field(n).type)
        and "string" not in str(spark_table.schema.field(n).type)
        and "list" not in str(spark_table.schema.field(n).type)
    ]
    a, b = rows_of(spark_table), rows_of(duck_table)
    different = [(x, y) for x, y in zip(a, b) if x != y]
    if different:
        return f"{len(different)} of {len(a)} rows differ, first {different[0]}"
    return f"types {types}" if types else None


def main() -> int:
    import duckdb

    import __spark_entry__ as entry
    from drillspectra.session import local_session

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    options = parser.parse_args()
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    duck = duckdb.connect()
    for table in TABLES:
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{options.sf}/{table}.parquet'")
    texts = entry.oracle_sql()
    bad = 0
    for name, run in entry.queries().items():
        if options.names and not any(name.startswith(p) for p in options.names):
            continue
        started = time.time()
        try:
            got = run(spark, options.sf).toArrow()
            spent = time.time() - started
            if name not in texts:
                print(f"rows  {name} {got.num_rows} {spent:.1f}s", flush=True)
                continue
            started = time.time()
            problem = compare(name, got, duck.execute(texts[name]).to_arrow_table())
            duck_spent = time.time() - started
        except Exception as error:  # report and go on to the next query
            print(f"ERROR {name}: {str(error)[:700]}", flush=True)
            bad += 1
            continue
        if problem:
            bad += 1
            print(f"DIFF  {name}: {problem[:600]}", flush=True)
        else:
            print(f"ok    {name} {got.num_rows} {spent:.1f}s sql {duck_spent:.1f}s", flush=True)
    print(f"{bad} problems")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
