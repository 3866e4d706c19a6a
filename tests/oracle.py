"""Run registered queries in Spark and their SQL in DuckDB and compare the rows.

`python -m tests.oracle [data folder] [query ...]` prints one line per query.
"""

from __future__ import annotations

import sys
import time
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _kinds(df) -> dict[str, str]:
    names = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}
    names |= {"timestamp_ntz": "TIMESTAMP", "date": "DATE"}
    return {f.name: names.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}


def compare(df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty when rows, column names and types are the same; else what differs."""
    have = _kinds(df)
    cursor = con.execute(sql)
    want = {d[0]: str(d[1]) for d in cursor.description}
    if set(have) != set(want):
        return f"columns differ: {sorted(set(have) ^ set(want))}"
    odd = {c: (have[c], want[c]) for c in have if have[c] != want[c]}
    columns = sorted(have)
    order = [list(want).index(c) for c in columns]
    expected = Counter(tuple(r[i] for i in order) for r in cursor.fetchall())
    actual = Counter(tuple(r) for r in df.select(*columns).collect())
    if expected != actual:
        missing, extra = expected - actual, actual - expected
        return (
            f"rows differ: {sum(actual.values())} against {sum(expected.values())}; "
            f"missing {list(missing)[:2]}, extra {list(extra)[:2]}"
        )
    return f"types differ: {odd}" if odd else ""


def main(argv: list[str]) -> None:
    from __spark_entry__ import oracle_sql, queries
    from edgeloom.session import build_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = build_session("oracle", "local[8]", **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = connect(sf_dir), oracle_sql(), 0
    for name, fn in queries().items():
        if argv[1:] and name not in argv[1:]:
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            said = compare(df, con, sqls[name]) if name in sqls else f"rows {df.count()}"
        except Exception as e:  # noqa: BLE001 - a report of all queries goes on past a failing one
            said = f"error {type(e).__name__}: {str(e)[:400]}"
        bad += bool(said) and not said.startswith("rows ") or said.startswith("rows differ")
        print(f"{name:16s} {time.time() - start:6.2f}s {said or 'same'}", flush=True)
    print("differing:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
