"""Runs registered queries beside their SQL twins: `python -m stainframe.verify.check [sf] [key ...]`."""

from __future__ import annotations

import math
import sys
import time

import duckdb

from stainframe.session import local_session
from stainframe.verify import all_queries, all_oracles
from stainframe.verify.views import GIVEN


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def clean(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(v + 0.0)
        if isinstance(v, (list, tuple)):
            return "[" + ",".join(clean(x) for x in v) + "]"
        return repr(v)

    return sorted(tuple(clean(r[i]) for i in order) for r in rows)


def compare(spark, con, key: str, folder: str) -> tuple[bool, str]:
    start = time.time()
    df = all_queries()[key](spark, folder)
    table = df.toArrow()
    took = time.time() - start
    sql = all_oracles().get(key)
    if sql is None:
        return True, f"rows only: {table.num_rows} rows, {took:.1f}s"
    start = time.time()
    twin = con.sql(sql).to_arrow_table()
    took2 = time.time() - start
    note = f"{table.num_rows} rows, {took:.1f}s / {took2:.1f}s"
    if sorted(table.column_names) != sorted(twin.column_names):
        return False, f"{note} columns {sorted(table.column_names)} != {sorted(twin.column_names)}"
    types = [(n, str(table.schema.field(n).type), str(twin.schema.field(n).type)) for n in table.column_names
             if str(table.schema.field(n).type).replace("large_", "").replace("element", "l").replace("item", "l")
             != str(twin.schema.field(n).type).replace("large_", "").replace("element", "l").replace("item", "l")]
    a = _rows(table.column_names, zip(*[c.to_pylist() for c in table.columns]))
    b = _rows(twin.column_names, zip(*[c.to_pylist() for c in twin.columns]))
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
        return False, f"{note} vs {len(b)}: {sorted(table.column_names)} {diff}"
    return not types, f"{note} {'types ' + str(types) if types else ''}"


def main(argv: list[str]) -> int:
    sf = argv[0] if argv else "0.01"
    folder = f"/root/testdata/sf{sf}"
    keys = argv[1:] or list(all_queries())
    spark = local_session()
    con = duckdb.connect()
    for name in GIVEN:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    bad = []
    for key in keys:
        try:
            ok, note = compare(spark, con, key, folder)
        except Exception as e:  # a broken query must not hide the others
            ok, note = False, f"{type(e).__name__}: {str(e)[:600]}"
        print(("ok   " if ok else "FAIL ") + key + "  " + note, flush=True)
        if not ok:
            bad.append(key)
    print(f"{len(keys) - len(bad)} of {len(keys)} agree; failing: {bad}")
    return len(bad)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
