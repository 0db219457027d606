"""Run registered queries beside their SQL and report where they differ.

    python tests/compare.py [sf_dir] [query ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def spark_result(df):
    return sorted(df.columns), rows_of(df.columns, [tuple(r) for r in df.collect()])


def duck_result(con, sql):
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    return sorted(columns), rows_of(columns, cur.fetchall())


def difference(df, con, sql, sizes=None) -> str | None:
    """None when both give the same rows, else what differs first. ``sizes`` collects the row counts."""
    columns, got = spark_result(df)
    expected_columns, expected = duck_result(con, sql)
    if sizes is not None:
        sizes.append(len(got))
    if columns != expected_columns:
        return f"columns {columns} vs {expected_columns}"
    if len(got) != len(expected):
        return f"{len(got)} rows vs {len(expected)}; first {got[:1]} vs {expected[:1]}"
    for a, b in zip(got, expected):
        if a != b:
            return f"{a} vs {b}"
    return None


def main(argv: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries
    from tidemart.session import get_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.001"
    spark = get_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    oracle = oracle_sql()
    for name, query in queries().items():
        if name not in oracle or argv[1:] and name not in argv[1:]:
            continue
        start, sizes = time.time(), []
        try:
            problem = difference(query(spark, sf_dir), con, oracle[name], sizes)
        except Exception as e:  # report and go on with the next query
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name:30s} {time.time() - start:6.2f}s {sizes} {problem or ''}", flush=True)
    print(f"{bad} differences")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
