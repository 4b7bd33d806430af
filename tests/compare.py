"""Holds a Spark result against DuckDB: names, kinds of types, rows as a multiset."""

from __future__ import annotations

import datetime
import decimal
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"tinyint": "int", "smallint": "int", "integer": "int", "int": "int", "bigint": "int", "double": "float", "float": "float", "varchar": "string", "string": "string", "boolean": "boolean", "binary": "blob", "blob": "blob"}


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        at = Path(sf_dir, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{at}/*.parquet')" if at.is_dir() else f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{at}')")
    return con


def plain(value: object) -> object:
    """A value in a form that both engines share."""
    if isinstance(value, float):
        return "nan" if value != value else float(f"{value:.10g}") + 0.0
    if isinstance(value, decimal.Decimal):
        return plain(float(value))
    if isinstance(value, (list, tuple)) and not hasattr(value, "asDict"):
        return tuple(plain(v) for v in value)
    if hasattr(value, "asDict"):
        value = value.asDict(recursive=False)
    if isinstance(value, dict):
        return tuple(sorted((str(k), plain(v)) for k, v in value.items()))
    if isinstance(value, (bytearray, bytes, memoryview)):
        return bytes(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def differences(found: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty if both have the same columns and rows."""
    want = con.execute(sql)
    names, kinds = [d[0] for d in want.description], [str(d[1]).lower() for d in want.description]
    columns = sorted(found.columns)
    if columns != sorted(names):
        return f"columns {columns} and {sorted(names)}"
    types = dict(found.dtypes)
    for n, k in zip(names, kinds):
        a, b = KINDS.get(types[n], types[n]), KINDS.get(k, k)
        if a != b and "(" not in k and "[" not in k and k not in ("list", "number", "null", '"null"'):
            return f"{n} is {types[n]} and {k}"
    rows = want.fetchall()
    order = [names.index(c) for c in columns]
    b = Counter(tuple(plain(r[i]) for i in order) for r in rows)
    a = Counter(tuple(plain(r[c]) for c in columns) for r in found.select(*(f"`{c}`" for c in columns)).collect())
    if a != b:
        return f"{sum(a.values())} and {sum(b.values())} rows; only in Spark {list((a - b).items())[:3]}; only in SQL {list((b - a).items())[:3]}"
    return ""


def main() -> None:
    """python -m tests.compare SF_DIR [NAME...]: times and differences of the registered queries."""
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir, names = sys.argv[1], sys.argv[2:]
    con, queries, oracles = database(sf_dir), e.queries(), e.oracle_sql()
    for n in names or queries:
        began = time.time()
        try:
            said = differences(queries[n](spark, sf_dir), con, oracles[n]) if n in oracles else f"no SQL, {queries[n](spark, sf_dir).count()} rows"
        except Exception as x:
            said = f"{type(x).__name__}: {str(x)[:400]}"
        print(f"{n}: {said or 'same'} ({time.time() - began:.1f} s)", flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
