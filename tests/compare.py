"""Runs registered queries in Spark and their SQL in DuckDB, and compares whole results.

    python -m tests.compare [sf] [name ...]
"""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from pathlib import Path

import duckdb
import pyarrow as pa

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings"
    " pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        file = Path(sf_dir) / f"{table}.parquet"
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{file}')")
    return con


def family(kind: pa.DataType) -> str:
    if pa.types.is_large_string(kind) or pa.types.is_string(kind):
        return "string"
    if pa.types.is_timestamp(kind):
        return "timestamp"
    if pa.types.is_list(kind) or pa.types.is_large_list(kind):
        return f"list<{family(kind.value_type)}>"
    return str(kind)


def plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return float(f"{value:.12g}") + 0.0
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, list):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return value


def rows_of(table: pa.Table) -> list[tuple]:
    names = sorted(table.column_names)
    columns = [[plain(v) for v in table.column(n).to_pylist()] for n in names]
    return sorted(zip(*columns, strict=True), key=repr)


def difference(spark_table: pa.Table, duck_table: pa.Table) -> str | None:
    a = {f.name: family(f.type) for f in spark_table.schema}
    b = {f.name: family(f.type) for f in duck_table.schema}
    if set(a) != set(b):
        return f"columns {sorted(a)} against {sorted(b)}"
    off = {n: (a[n], b[n]) for n in a if a[n] != b[n]}
    if off:
        return f"types {off}"
    if spark_table.num_rows != duck_table.num_rows:
        return f"rows {spark_table.num_rows} against {duck_table.num_rows}"
    x, y = rows_of(spark_table), rows_of(duck_table)
    if x != y:
        bad = next(i for i in range(len(x)) if x[i] != y[i])
        n = sum(1 for p, q in zip(x, y, strict=True) if p != q)
        return f"{n} rows differ ({sorted(a)}), first {x[bad]} against {y[bad]}"
    return None


def main() -> None:
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry

    from daytrail.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session(
        "compare", master="local[8]", shuffle_partitions=8,
        conf={"spark.ui.enabled": "false", "spark.driver.memory": "12g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    wanted = sys.argv[2:] or list(queries)
    failed = []
    for name in wanted:
        begun = time.time()
        try:
            ours = queries[name](spark, sf_dir).toArrow()
            took = time.time() - begun
            if name in oracles:
                problem = difference(ours, con.execute(oracles[name]).to_arrow_table())
                state = "ok" if problem is None else f"DIFF {problem}"
            else:
                state = "rows only"
            if ours.num_rows == 0:
                state += " (empty)"
        except Exception as error:  # noqa: BLE001
            took, state = time.time() - begun, f"ERROR {str(error)[:1500]}"
        if not state.startswith(("ok", "rows only")):
            failed.append(name)
        print(f"{name:38s} {took:6.2f}s {state}", flush=True)
    print(f"{len(wanted)} queries, {len(failed)} failed: {failed}")


if __name__ == "__main__":
    main()
