"""Run registered queries against their DuckDB counterparts and report differences."""

from __future__ import annotations

import math
import re
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
KIND = {"BIGINT": "int", "INTEGER": "int", "SMALLINT": "int", "TINYINT": "int", "HUGEINT": "huge", "DOUBLE": "double", "FLOAT": "double",
        "VARCHAR": "string", "BOOLEAN": "boolean"}


def make_spark(cores="8", partitions="8"):
    from pyspark.sql import SparkSession

    return (
        SparkSession.builder.master(f"local[{cores}]").appName("kerbline")
        .config("spark.sql.shuffle.partitions", partitions).config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.extraJavaOptions", "-Xss16m")
        .getOrCreate()
    )


def duck(sf):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return ("0", "")
    if isinstance(v, bool):
        return ("b", str(v))
    if isinstance(v, (int, float)):
        if isinstance(v, float) and math.isnan(v):
            return ("n", "nan")
        return ("d", f"{float(v) + 0.0:.9g}")
    return ("s", str(v))


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_norm(row[i]) for i in order) for row in rows)


def _close(a, b):
    if a == b:
        return True
    if a[0] == b[0] == "d":
        return abs(float(a[1]) - float(b[1])) <= 1e-9 * max(1.0, abs(float(a[1])))
    return False


def check(spark, con, sf, name, fn, sql):
    """Returns (ok, message, seconds, rows)."""
    t = time.time()
    df = fn(spark, sf)
    got = df.collect()
    took = time.time() - t
    if sql is None:
        return True, "rows only", took, len(got)
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    want_types = [str(d[1]) for d in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(want_cols):
        return False, f"columns {sorted(df.columns)} vs {sorted(want_cols)}", took, len(got)
    spark_kind = {}
    for n, ty in df.dtypes:
        spark_kind[n] = {"bigint": "int", "int": "int", "smallint": "int", "tinyint": "int"}.get(ty, ty)
    for n, ty in zip(want_cols, want_types):
        k = KIND.get(ty, ty)
        if k != spark_kind[n]:
            return False, f"type of {n}: {spark_kind[n]} vs {ty}", took, len(got)
    a, b = _rows(df.columns, [tuple(x) for x in got]), _rows(want_cols, want)
    if len(a) != len(b):
        only = [x for x in a if x not in set(b)][:2] if len(a) < 20000 else []
        return False, f"rows {len(a)} vs {len(b)}; only spark {only}", took, len(got)
    names = sorted(want_cols)
    exact = sum(x != y for x, y in zip(a, b))
    bad = [(x, y) for x, y in zip(a, b) if not all(_close(p, q) for p, q in zip(x, y))]
    if bad or exact:
        x, y = bad[0] if bad else next((x, y) for x, y in zip(a, b) if x != y)
        diff = {n: (p[1], q[1]) for n, p, q in zip(names, x, y) if p != q}
        return False, f"{len(bad)} differ ({exact} inexact), e.g. {diff} in {dict(zip(names, [p[1] for p in x]))}", took, len(got)
    return True, "match", took, len(got)


def main(argv):
    sf = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    pattern = re.compile(argv[2]) if len(argv) > 2 else None
    import __spark_entry__ as entry

    spark, con = make_spark(*argv[3:4]), duck(sf)
    spark.sparkContext.setLogLevel("ERROR")
    qs, sqls = entry.queries(), entry.oracle_sql()
    bad = []
    for name, fn in qs.items():
        if pattern and not pattern.search(name):
            continue
        try:
            ok, msg, took, n = check(spark, con, sf, name, fn, sqls.get(name))
        except Exception as ex:  # noqa: BLE001
            ok, msg, took, n = False, f"{type(ex).__name__}: {str(ex)[:700]}", 0.0, -1
        flag = "ok  " if ok else "FAIL"
        note = " EMPTY" if n == 0 else ""
        print(f"{flag} {name:42s} {took:6.2f}s {n:7d} rows{note} {msg if not ok else ('' if msg == 'match' else msg)}", flush=True)
        if not ok:
            bad.append(name)
    print(f"{len(bad)} failing: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
