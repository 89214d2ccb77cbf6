"""Compare registered queries with their SQL on one data folder."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

from . import registry

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def sql_rows(folder: str, sql: str):
    import duckdb

    con = duckdb.connect()
    for table in TABLES:
        if Path(f"{folder}/{table}.parquet").exists():
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    cur = con.execute(sql)
    return [(d[0], str(d[1])) for d in cur.description], cur.fetchall()


def _key(row):
    return tuple((v is None, str(type(v).__name__ if v is None else ""), str(v)) for v in row)


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return 0.0 if v == 0 else v
    return v


def compare(spark, folder: str, name: str) -> tuple[bool, str]:
    start = time.time()
    df = registry.QUERIES[name](spark, folder)
    cols = sorted(df.columns)
    got = [tuple(_norm(v) for v in r) for r in df.select(*[f"`{c}`" for c in cols]).collect()]
    spent = time.time() - start
    if name not in registry.ORACLES:
        return True, f"rows={len(got)} {spent:.1f}s (no SQL)"
    desc, want = sql_rows(folder, registry.ORACLES[name])
    order = sorted(range(len(desc)), key=lambda i: desc[i][0])
    if [desc[i][0] for i in order] != cols:
        return False, f"columns {cols} vs {[desc[i][0] for i in order]}"
    wide = [d[0] for d in desc if d[1] in ("HUGEINT", "UHUGEINT") or "DECIMAL" in d[1]]
    want = [tuple(_norm(r[i]) for i in order) for r in want]
    got.sort(key=_key), want.sort(key=_key)
    if got == want:
        empty = " EMPTY" if not got else ""
        return not wide, f"rows={len(got)} {spent:.1f}s{empty}" + (f" wide types {wide}" if wide else "")
    diffs = [(g, w) for g, w in zip(got, want) if g != w][:2]
    return False, f"rows {len(got)} vs {len(want)} {spent:.1f}s; cols={cols}; diffs={diffs}"


def main() -> int:
    from ..session import local_session

    folder = sys.argv[1]
    spark = local_session(8)
    registry.load()
    names = [n for n in registry.QUERIES if len(sys.argv) < 3 or any(n.startswith(a) for a in sys.argv[2:])]
    bad = 0
    for name in names:
        try:
            ok, text = compare(spark, folder, name)
        except Exception as exc:  # report and go on with the other queries
            ok, text = False, f"{type(exc).__name__}: {str(exc)[:600]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {text}", flush=True)
    print(f"{len(names)} queries, {bad} failed")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
