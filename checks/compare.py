"""Run queries next to their SQL in DuckDB: ``python -m checks.compare [sf_dir] [names...]``."""

from __future__ import annotations

import os
import sys
import time
import traceback

import duckdb
from pyspark.sql import SparkSession
from pyspark.sql import types as T

from checks.queries import QUERIES, SQL
from partlog.session import configure

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings"
    " pages benchmark labels conversations"
).split()

DUCK_TYPES = {
    T.LongType(): "BIGINT",
    T.IntegerType(): "INTEGER",
    T.StringType(): "VARCHAR",
    T.BooleanType(): "BOOLEAN",
    T.DoubleType(): "DOUBLE",
    T.TimestampNTZType(): "TIMESTAMP",
    T.TimestampType(): "TIMESTAMP WITH TIME ZONE",
}


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def local_session(cpus: str = "8") -> SparkSession:
    builder = (
        configure(SparkSession.builder.master(f"local[{cpus}]").appName("partlog"))
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _sortable(rows):
    return sorted(rows, key=lambda r: tuple((v is not None, str(v)) for v in r))


def compare(spark: SparkSession, con, name: str, sf_dir: str) -> tuple[str, int]:
    """('ok' or the first difference, number of rows)."""
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = [tuple(r) for r in df.select(*columns).collect()]
    if name not in SQL:
        return ("rows only" if rows else "no rows"), len(rows)
    rel = con.sql(SQL[name])
    want_columns = sorted(rel.columns)
    if columns != want_columns:
        return f"columns {columns} <> {want_columns}", len(rows)
    types = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    for f in df.schema.fields:
        if DUCK_TYPES.get(f.dataType) != types[f.name]:
            return f"type of {f.name}: {f.dataType} <> {types[f.name]}", len(rows)
    quoted = ", ".join(f'"{c}"' for c in columns)
    want = con.sql(f"SELECT {quoted} FROM ({SQL[name]})").fetchall()
    if len(rows) != len(want):
        return f"{len(rows)} rows <> {len(want)}", len(rows)
    for a, b in zip(_sortable(rows), _sortable(want)):
        if a != b:
            return f"{a} <> {b} in {columns}", len(rows)
    return ("ok" if rows else "no rows"), len(rows)


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    con = database(sf_dir)
    failed = 0
    for name in names:
        start = time.time()
        try:
            verdict, n = compare(spark, con, name, sf_dir)
        except Exception as e:
            verdict, n = f"{type(e).__name__}: {str(e)[:600]}", -1
            if os.environ.get("TRACE"):
                traceback.print_exc()
        failed += verdict not in ("ok", "rows only")
        print(f"{name:32s} {n:8d} {time.time() - start:6.2f}s  {verdict}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main())
