"""Run every query and its SQL on the same tables and compare the rows.

    python -m checks.compare /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

from checks.oracles import ORACLES
from checks.queries import QUERIES


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if hasattr(value, "asDict"):
        return tuple(plain(v) for v in value)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def table(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in sorted(os.listdir(sf_dir)):
        db.execute(f"create view {name.split('.')[0]} as select * from '{sf_dir}/{name}'")
    return db


# Spark and database names of the types results may have
TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "float": "FLOAT", "string": "VARCHAR", "boolean": "BOOLEAN",
}


def type_difference(df, db, sql: str) -> str:
    theirs = {r[0]: r[1] for r in db.execute(f"describe {sql}").fetchall()}
    odd = {n: (t, theirs[n]) for n, t in df.dtypes if TYPES.get(t, t) != theirs[n]}
    return f"types {odd}" if odd else ""


def check(spark, db, sf_dir: str, name: str) -> tuple[bool, str]:
    start = time.time()
    df = QUERIES[name](spark, sf_dir)
    mine = table(df.collect(), df.columns)
    took = time.time() - start
    start = time.time()
    cursor = db.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    theirs = table(cursor.fetchall(), columns)
    note = f"{len(mine)} rows, {took:.1f}s, sql {time.time() - start:.1f}s"
    if sorted(columns) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(columns)}"
    odd = type_difference(df, db, ORACLES[name])
    if odd:
        return False, odd
    if mine != theirs:
        a, b = set(map(repr, mine)), set(map(repr, theirs))
        return False, f"{note}; sql {len(theirs)} rows; only here {sorted(a - b)[:2]}; only sql {sorted(b - a)[:2]}"
    return bool(mine), note


def main() -> int:
    from quire.session import session

    spark = session("compare", **{
        "spark.master": "local[8]", "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
        "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    db, bad = database(sf_dir), 0
    for name in names:
        try:
            ok, note = check(spark, db, sf_dir, name) if name in ORACLES else (False, "no SQL")
        except Exception as exc:  # noqa: BLE001
            ok, note = False, f"{type(exc).__name__}: {exc}"
        bad += not ok
        print("ok  " if ok else "BAD ", name, note[:1500], flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
