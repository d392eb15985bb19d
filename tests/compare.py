"""Run registered queries against their SQL twins in DuckDB.

    python tests/compare.py [scale] [name-prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()
ROOT = "/root/testdata"


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(
        (tuple(_cell(r[i]) for i in order) for r in rows), key=repr
    )


def type_family(name: str) -> str:
    n = name.lower()
    for family, words in {
        "int": ("int", "long", "short"), "float": ("double", "float"), "text": ("string", "varchar"),
        "bool": ("bool",), "decimal": ("decimal",), "time": ("timestamp",),
    }.items():
        if any(w in n for w in words) and "hugeint" not in n:
            return family
    return n


def compare(spark, con, fn, sql, sf_dir):
    df = fn(spark, sf_dir)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want_types = {d[0]: type_family(str(d[1])) for d in cur.description}
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    got_types = {f.name: type_family(f.dataType.simpleString()) for f in df.schema}
    if got_types != want_types:
        diff = {k: (got_types[k], want_types[k]) for k in got_types if got_types[k] != want_types[k]}
        return f"types {diff}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    for g, w in zip(got, want):
        if g != w:
            bad = [(c, str(a)[:160], str(b)[:160]) for c, a, b in zip(got_cols, g, w) if a != b]
            return f"first difference {bad} in {str(g)[:120]}"
    return f"ok {len(got)}"


if __name__ == "__main__":
    from querent.session import local_session
    from querent.suite import load_all
    from querent.suite.registry import QUERIES, TWINS

    load_all()
    scale, prefixes = (sys.argv[1] if len(sys.argv) > 1 else "0.001"), tuple(sys.argv[2:])
    sf = f"{ROOT}/sf{scale}"
    spark = local_session("compare", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    bad = 0
    for name, fn in QUERIES.items():
        if prefixes and not name.startswith(prefixes):
            continue
        t = time.time()
        try:
            if name in TWINS:
                res = compare(spark, con, fn, TWINS[name], sf)
            else:
                res = f"rows-only {fn(spark, sf).count()}"
        except Exception as e:  # noqa: BLE001
            res = f"ERROR {str(e)[:600]}"
        if not res.startswith(("ok", "rows-only")):
            bad += 1
        print(f"{name:34s} {time.time() - t:6.2f}s {res}", flush=True)
    print("failed", bad)
