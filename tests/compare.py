"""Runs queries and their SQL side by side: python tests/compare.py SF_DIR [NAME ...]."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def kind(s: pd.Series) -> str:
    return str(s.dtype) if str(s.dtype) != "object" else type(next((x for x in s if x is not None), "")).__name__


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == "object" and len(df) and isinstance(df[c].iloc[0], str):
            continue
        if str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].astype("int64" if False else str)
    return df.sort_values(list(df.columns), ignore_index=True) if len(df.columns) else df


def differences(spark, con, name: str, query, sql: str, sf_dir: str) -> list[str]:
    got = query(spark, sf_dir).toArrow().to_pandas()
    want = con.sql(sql).arrow()
    want = (want.read_all() if hasattr(want, "read_all") else want).to_pandas()
    if sorted(got.columns) != sorted(want.columns):
        return [f"columns {sorted(got.columns)} against {sorted(want.columns)}"]
    if len(got) != len(want):
        return [f"{len(got)} rows against {len(want)}"]
    out = [f"{c}: {kind(got[c])} against {kind(want[c])}" for c in got.columns if kind(got[c]) != kind(want[c])]
    a, b = canonical(got), canonical(want)
    for c in a.columns:
        bad = ~((a[c] == b[c]) | (a[c].isna() & b[c].isna()))
        if bad.any():
            i = bad.idxmax()
            out.append(f"{c}: {int(bad.sum())} rows differ, first {a.loc[i].to_dict()!r:.600} against {b.loc[i].to_dict()!r:.600}")
    return out


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf, names = sys.argv[1], sys.argv[2:]
    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "6").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").config("spark.driver.host", "127.0.0.1").config("spark.driver.maxResultSize", "4g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = oracle(sf), entry.oracle_sql(), 0
    for n, q in entry.queries().items():
        if names and n not in names:
            continue
        t = time.time()
        try:
            found = differences(spark, con, n, q, sqls[n], sf) if n in sqls else [] if q(spark, sf).count() >= 0 else []
        except Exception as e:  # noqa: BLE001
            found = [f"{type(e).__name__}: {str(e)[:700]}"]
        bad += bool(found)
        print(n, "SAME" if not found and n in sqls else "RAN" if not found else "DIFFERS", f"{time.time() - t:.1f}s", *found, sep="  ", flush=True)
    sys.exit(bad > 0)
