"""Run queries on Spark and their SQL on DuckDB and compare the rows.

    python tests/compare.py SF_DIR [name-prefix ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, decimal.Decimal):
        return f"{float(v):.9g}" if v != v.to_integral_value() else str(int(v))
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, int):
        return str(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    body = sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)
    return [columns[i] for i in order], body


def compare(spark, con, name, fn, sql, sf_dir):
    start = time.time()
    df = fn(spark, sf_dir)
    got = normal(df.columns, [tuple(r) for r in df.collect()])
    seconds = time.time() - start
    if sql is None:
        return "rows-only", seconds, len(got[1]), ""
    result = con.execute(sql)
    want = normal([d[0] for d in result.description], result.fetchall())
    if got[0] != want[0]:
        return "COLUMNS", seconds, len(got[1]), f"{got[0]} != {want[0]}"
    if got[1] != want[1]:
        a, b = set(map(repr, got[1])), set(map(repr, want[1]))
        detail = f"{len(got[1])} vs {len(want[1])} rows\n  spark {sorted(a - b)[:3]}\n  sql   {sorted(b - a)[:3]}"
        return "DIFFER", seconds, len(got[1]), detail
    return "ok", seconds, len(got[1]), ""


def main(sf_dir: str, prefixes: list[str]) -> int:
    from heirloom.plans import catalogue
    from heirloom.session import get_spark

    spark = get_spark(
        "compare",
        "local[8]",
        **{
            "spark.ui.enabled": "false",
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "12g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sqls, bad = catalogue.oracle_sql(), 0
    for name, fn in catalogue.queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        try:
            verdict, seconds, rows, detail = compare(spark, con, name, fn, sqls.get(name), sf_dir)
        except Exception as e:  # noqa: BLE001
            verdict, seconds, rows, detail = "ERROR", 0.0, 0, str(e)[:900]
        bad += verdict not in ("ok", "rows-only")
        print(f"{verdict:10s} {seconds:6.2f}s {rows:7d}  {name} {detail}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
