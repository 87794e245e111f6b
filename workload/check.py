"""Run queries and their SQL side by side: ``python -m workload.check sf_dir [name ...]``."""

from __future__ import annotations

import math
import sys
import time

import duckdb
import pyarrow as pa

from placelab.session import local_session
from workload.oracles import oracle_sql
from workload.queries import queries

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else (0.0 if value == 0 else value)
    return value


def normalized(table: pa.Table) -> tuple[list[str], list[tuple]]:
    names = sorted(table.column_names)
    columns = [[_plain(v) for v in table.column(n).to_pylist()] for n in names]
    return names, sorted(zip(*columns), key=lambda row: tuple((v is None, str(v)) for v in row))


def types(table: pa.Table) -> dict[str, str]:
    return {f.name: str(f.type).replace("large_", "") for f in table.schema}


def compare(got: pa.Table, want: pa.Table) -> str:
    """Empty when equal, else the first difference."""
    (names, rows), (want_names, want_rows) = normalized(got), normalized(want)
    if names != want_names:
        return f"columns {names} != {want_names}"
    if types(got) != types(want):
        return f"types {sorted(set(types(got).items()) ^ set(types(want).items()))}"
    if len(rows) != len(want_rows):
        return f"rows {len(rows)} != {len(want_rows)}"
    for mine, other in zip(rows, want_rows):
        if mine != other:
            return f"{mine} != {other}"
    return ""


def main(folder: str, *wanted: str) -> int:
    spark, con = local_session("check", cores="8"), connect(folder)
    sql, failed = oracle_sql(), 0
    for name, query in queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            got = query(spark, folder).toArrow()
            spent = time.time() - start
            verdict = compare(got, con.sql(sql[name]).to_arrow_table()) if name in sql else "rows only"
        except Exception as error:
            spent, verdict, got = time.time() - start, f"ERROR {type(error).__name__}: {str(error)[:600]}", None
        bad = verdict not in ("", "rows only")
        failed += bad
        print(f"{'FAIL' if bad else 'ok  '} {name:28s} {spent:6.1f}s rows={got.num_rows if got is not None else '-'} {verdict}", flush=True)
    print("failed", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(*sys.argv[1:]) else 0)
