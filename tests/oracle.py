"""Run a registered query and its SQL twin and compare names, types and values."""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()
KINDS = {
    "tinyint": "int", "smallint": "int", "int": "int", "integer": "int", "bigint": "bigint",
    "double": "double", "string": "string", "varchar": "string", "boolean": "boolean",
    "float": "float",
}


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


def compare(df, con, sql: str) -> str | None:
    rel = con.sql(sql)
    names, types = rel.columns, [str(t).lower() for t in rel.types]
    got_types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    for n, t in zip(names, types):
        a, b = KINDS.get(got_types[n], got_types[n]), KINDS.get(t, t)
        if a != b:
            return f"type of {n}: {got_types[n]} != {t}"
    order = sorted(names)
    want = sorted(
        (tuple(plain(r[names.index(c)]) for c in order) for r in rel.fetchall()), key=repr
    )
    rows = df.select(*order).collect()
    got = sorted((tuple(plain(v) for v in r) for r in rows), key=repr)
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, first {bad[0]}"
    return None


def main(argv: list[str]) -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry

    from trackhouse.session import local_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, fn in queries.items():
        if argv and not any(name.startswith(a) for a in argv):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in oracles:
                problem = compare(df, con, oracles[name])
                state = "ok" if problem is None else f"MISMATCH {problem}"
            else:
                state = f"rows-only {df.count()}"
                problem = None
        except Exception as exc:  # report and go on
            problem = state = f"ERROR {type(exc).__name__}: {str(exc)[:600]}"
        failed += problem is not None
        print(f"{name:32s} {time.time() - start:6.2f}s {state}", flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
