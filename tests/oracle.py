"""Run registered queries beside their SQL and compare: ``python tests/oracle.py <sf_dir> [name ...]``."""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _value(x):
    if isinstance(x, bool):
        return x
    if isinstance(x, decimal.Decimal):
        return float(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else x
    if isinstance(x, (datetime.date, datetime.datetime)):
        return x.isoformat()
    if isinstance(x, (list, tuple)):
        return tuple(_value(v) for v in x)
    return x


def normal_rows(columns: list[str], rows) -> tuple[list[str], list[str]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(repr([_value(r[i]) for i in order]) for r in rows)


def differences(spark, con, sf_dir: str, function, sql: str | None) -> tuple[str, int]:
    """'' if both sides agree, else what differs; and the number of rows."""
    df = function(spark, sf_dir)
    ours = normal_rows(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return "", len(ours[1])
    cursor = con.execute(sql)
    theirs = normal_rows([d[0] for d in cursor.description], cursor.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} / {theirs[0]}", len(ours[1])
    kinds = [(a, b) for a, b in zip(_kinds(ours[1]), _kinds(theirs[1])) if a != b]
    if ours[1] != theirs[1]:
        left, right = set(ours[1]) - set(theirs[1]), set(theirs[1]) - set(ours[1])
        return f"rows {len(ours[1])}/{len(theirs[1])} ours {sorted(left)[:3]} sql {sorted(right)[:3]} {kinds}", len(ours[1])
    return "", len(ours[1])


def _kinds(rows: list[str]) -> list[str]:
    return rows[:1]


def main() -> int:
    from hubmetrics.queries import ORACLES, QUERIES
    from hubmetrics.session import build_session

    sf_dir = sys.argv[1]
    names = sys.argv[2:] or list(QUERIES)
    spark = build_session("local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            problem, n = differences(spark, con, sf_dir, QUERIES[name], ORACLES.get(name))
        except Exception as error:
            problem, n = traceback.format_exc()[-1500:] if "-v" in sys.argv else str(error)[:600], -1
        bad += bool(problem)
        state = "FAIL" if problem else ("ok" if name in ORACLES else "rows")
        print(f"{state:5} {name:32} {n:7} rows {time.time() - start:6.1f}s {problem}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
