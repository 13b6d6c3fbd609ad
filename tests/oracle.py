"""Compare the registered queries with their SQL in DuckDB: python -m tests.oracle FOLDER [NAME...]."""

import math
import sys

import duckdb

import __spark_entry__ as entry
from quire.session import TABLES, build_session


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return tuple(map(plain, value)) if isinstance(value, list | tuple) else value


def compare(spark, folder: str, name: str) -> str:
    """Empty if both give the same rows."""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    df = entry.queries()[name](spark, folder)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    sql = entry.oracle_sql()[name]
    rel = con.execute(sql)
    at = [c[0] for c in rel.description]
    if sorted(at) != names:
        return f"columns {names} and {sorted(at)}"
    want = sorted((tuple(plain(r[at.index(c)]) for c in names) for r in rel.fetchall()), key=repr)
    if got == want:
        return ""
    odd = next(((a, b) for a, b in zip(got, want) if a != b), None)
    return f"rows {len(got)} and {len(want)}; first difference {str(odd)[:300]}"


if __name__ == "__main__":
    spark = build_session("oracle", "local[8]", 8)
    for name in sys.argv[2:] or entry.oracle_sql():
        try:
            said = compare(spark, sys.argv[1], name)
        except Exception as e:  # noqa: BLE001
            said = f"{type(e).__name__}: {str(e)[:300]}"
        print(name, said or "ok", flush=True)
