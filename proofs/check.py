"""Run queries against their SQL twins: ``python -m proofs.check [sf_dir] [name ...]``."""

from __future__ import annotations

import math
import sys
import time

import duckdb

from hazardline.session import build_session
from proofs.catalog import load
from proofs.registry import ORACLES, QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def one(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(v + 0.0)
        if isinstance(v, (list, tuple)):
            return "[" + ",".join(one(x) for x in v) + "]"
        return repr(v)

    return sorted(tuple(one(r[i]) for i in order) for r in rows), sorted(names)


def main(argv: list[str]) -> int:
    load()
    folder = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(QUERIES)
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(folder), 0
    for name in names:
        start = time.time()
        try:
            df = QUERIES[name](spark, folder)
            got, cols = canonical([tuple(r) for r in df.collect()], df.columns)
        except Exception as error:  # report and go on with the next query
            print(f"FAIL {name}: {type(error).__name__}: {str(error)[:900]}", flush=True)
            bad += 1
            continue
        took = time.time() - start
        if name not in ORACLES:
            print(f"rows {name} {len(got)} ({took:.1f}s) {cols[:8]}", flush=True)
            continue
        start = time.time()
        try:
            found = con.execute(ORACLES[name])
            want, want_cols = canonical(found.fetchall(), [d[0] for d in found.description])
        except Exception as error:
            print(f"SQL  {name}: {str(error)[:900]}", flush=True)
            bad += 1
            continue
        ok = got == want and cols == want_cols
        bad += not ok
        print(f"{'ok  ' if ok else 'DIFF'} {name} rows={len(got)}/{len(want)} spark={took:.1f}s sql={time.time() - start:.1f}s", flush=True)
        if not ok:
            print("   cols", cols, want_cols)
            print("   only spark", [r for r in got if r not in set(want)][:3])
            print("   only sql  ", [r for r in want if r not in set(got)][:3], flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
