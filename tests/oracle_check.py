"""Run queries next to their DuckDB oracles: ``python tests/oracle_check.py [sf] [name ...]``."""

from __future__ import annotations

import math
import pathlib
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "float": "FLOAT", "tinyint": "TINYINT", "smallint": "SMALLINT"}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v) -> str:
    if v is None or (isinstance(v, float) and math.isnan(v)) or v is pd.NA:
        return "~"
    if isinstance(v, float):
        return "0.0" if v == 0 else repr(v)
    return str(v)


def rows_of(columns: list[str], rows) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(df, con, sql: str) -> tuple[list[str], int]:
    """Problems found (none: equal) and the number of rows."""
    got = df.collect()
    rel = con.sql(sql)
    want_columns, want_types = rel.columns, dict(zip(rel.columns, map(str, rel.types)))
    want = rel.fetchall()
    problems = []
    if sorted(df.columns) != sorted(want_columns):
        only = set(df.columns) ^ set(want_columns)
        return [f"columns differ: {sorted(only)}"], len(got)
    for c, t in df.dtypes:
        if KINDS.get(t, t) != want_types[c]:
            problems.append(f"type of {c}: {t} vs {want_types[c]}")
    if len(got) != len(want):
        problems.append(f"rows {len(got)} vs {len(want)}")
    a, b = rows_of(df.columns, got), rows_of(want_columns, want)
    if a != b:
        only_a, only_b = set(a) - set(b), set(b) - set(a)
        problems.append(f"values differ ({sorted(df.columns)}): spark {sorted(only_a)[:2]} duckdb {sorted(only_b)[:2]}, {len(only_a)}/{len(only_b)}")
    return problems, len(got)


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from packetloom.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    all_queries, oracles = queries(), oracle_sql()
    bad = 0
    for name in sys.argv[2:] or all_queries:
        began = time.time()
        try:
            df = all_queries[name](spark, sf_dir)
            if name in oracles:
                problems, n = compare(df, con, oracles[name])
            else:
                problems, n = [], len(df.collect())
        except Exception as e:  # report and go on
            problems, n = [f"{type(e).__name__}: {str(e)[:600]}"], -1
        bad += bool(problems)
        if n == 0:
            problems.append("NO ROWS")
        print(f"{'FAIL' if problems else 'ok'}\t{name}\t{n}\t{time.time() - began:.1f}s\t{'' if name in oracles else '(no oracle)'}", *problems, sep="\n    " if problems else " ", flush=True)
    print(f"{bad} failed")


if __name__ == "__main__":
    main()
