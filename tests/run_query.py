"""Compare queries with their SQL: python tests/run_query.py SF_DIR NAME..."""

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_float_dtype(df[c]):
            df[c] = df[c].round(6)
    return df.astype(str).sort_values(list(df.columns)).reset_index(drop=True)


def compare(spark, sf_dir: str, query, sql: str | None):
    """Rows of the query and, if there is SQL, what differs (None: nothing)."""
    got = query(spark, sf_dir).toPandas()
    if sql is None:
        return got, None
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'" if p.is_file() else f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}/*.parquet'")
    con.sql("SET TimeZone = 'UTC'")
    want = con.sql(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return got, f"columns {sorted(got.columns)} and {sorted(want.columns)}"
    a, b = canonical(got), canonical(want)
    if len(a) != len(b):
        return got, f"{len(a)} rows and {len(b)}"
    odd = (a != b).any(axis=1)
    return got, None if not odd.any() else f"{odd.sum()} of {len(a)} rows differ, first\n{a[odd].head(3).to_dict('records')}\n{b[odd].head(3).to_dict('records')}"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from lodeframe.session import local_session

    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracle = entry.queries(), entry.oracle_sql()
    for name in sys.argv[2:] or queries:
        began = time.time()
        try:
            got, odd = compare(spark, sys.argv[1], queries[name], oracle.get(name))
            print(f"{name}: {len(got)} rows, {time.time() - began:.1f} s, {'no SQL' if name not in oracle else 'same' if odd is None else 'DIFFERENT: ' + odd}", flush=True)
        except Exception as e:  # noqa: BLE001
            print(f"{name}: FAILED {str(e)[:1500]}", flush=True)
