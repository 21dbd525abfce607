"""Run registered queries next to their DuckDB statements and report differences.

usage: python tools/check.py [--sf DIR] [name-prefix ...]
"""

from __future__ import annotations

import math
import sys
import time
import traceback
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from framesift.plans import load_all  # noqa: E402
from framesift.session import TABLES, local_session  # noqa: E402


def normal(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else (0.0 if v == 0 else v)
    return v


def fetch_spark(df):
    table = df.toArrow()
    return table.column_names, {n: str(t.type) for n, t in zip(table.column_names, table.columns)}, table


def rows_of(table):
    names = sorted(table.column_names)
    cols = [table.column(n).to_pylist() for n in names]
    return sorted((tuple(normal(v) for v in r) for r in zip(*cols)), key=lambda r: repr(r)) if cols else []


def close(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6)
    return a == b


def main(argv):
    sf = "/root/testdata/sf0.01"
    if argv[:1] == ["--sf"]:
        sf, argv = argv[1], argv[2:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    bad = 0
    for q in load_all().values():
        if argv and not any(q.name.startswith(a) for a in argv):
            continue
        began = time.time()
        try:
            names, types, left = fetch_spark(q.build(spark, sf))
            took = time.time() - began
        except Exception as error:  # noqa: BLE001
            bad += 1
            text = str(error) or traceback.format_exc()
            print(f"FAIL {q.name}: spark: {text[:700]}", flush=True)
            continue
        if q.sql is None:
            print(f"ok   {q.name}: rows only {left.num_rows} ({took:.1f}s)", flush=True)
            continue
        try:
            began = time.time()
            right = con.execute(q.sql).to_arrow_table()
            duck = time.time() - began
        except Exception as error:  # noqa: BLE001
            bad += 1
            print(f"FAIL {q.name}: duckdb: {str(error)[:500]}", flush=True)
            continue
        rt = {n: str(t.type) for n, t in zip(right.column_names, right.columns)}
        loose = {"large_string": "string", "string_view": "string"}
        lt = {k: loose.get(v, v) for k, v in types.items()}
        rt = {k: loose.get(v, v) for k, v in rt.items()}
        a, b = rows_of(left), rows_of(right)
        problems = []
        if sorted(names) != sorted(right.column_names):
            problems.append(f"columns {sorted(names)} vs {sorted(right.column_names)}")
        elif lt != rt:
            problems.append(f"types {[(k, lt[k], rt[k]) for k in lt if lt[k] != rt[k]]}")
        if len(a) != len(b):
            problems.append(f"rows {len(a)} vs {len(b)}")
        if a != b and not problems:
            diff = [(x, y) for x, y in zip(a, b) if x != y]
            near = all(all(close(p, q2) for p, q2 in zip(x, y)) for x, y in diff)
            problems.append(f"{len(diff)} rows differ{' (near)' if near else ''}: {diff[:2]}")
        elif a != b:
            only = [x for x in a if x not in set(b)][:2], [y for y in b if y not in set(a)][:2]
            problems.append(f"e.g. {only}")
        if not a:
            problems.append("EMPTY")
        if problems:
            bad += 1
            print(f"DIFF {q.name}: {'; '.join(problems)[:900]}", flush=True)
        else:
            print(f"ok   {q.name}: {len(a)} rows ({took:.1f}s spark, {duck:.1f}s duckdb)", flush=True)
    print(f"bad: {bad}", flush=True)
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
