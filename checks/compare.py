"""Runs registered queries next to their SQL and compares the rows.

    python -m checks.compare /root/testdata/sf0.01 [key ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb
from pyspark.sql import SparkSession

from checks.registry import PAIRS
from fleetbooks.session import local_session

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages"
          " benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _bag(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    tidy = lambda v: None if isinstance(v, float) and math.isnan(v) else v
    return Counter(tuple(tidy(r[i]) for i in order) for r in rows)


def differences(spark: SparkSession, con, sf_dir: str, key: str) -> str | None:
    """None when columns, types of value and the bag of rows agree."""
    pair = PAIRS[key]
    df = pair.run(spark, sf_dir)
    got = _bag(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(pair.oracle())
    columns = [d[0] for d in cur.description]
    want = _bag(columns, cur.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    if got != want:
        return f"only Spark {list((got - want).items())[:2]}, only SQL {list((want - got).items())[:2]}"
    kinds = lambda bag: [{type(v).__name__ for v in col if v is not None} for col in zip(*bag)]
    if kinds(got) != kinds(want):
        return f"types {kinds(got)} != {kinds(want)}"
    return None


def main(sf_dir: str, keys: list[str]) -> int:
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for key in keys or PAIRS:
        start = time.time()
        try:
            problem = differences(spark, con, sf_dir, key)
        except Exception as e:  # report and go on with the next query
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        rows = con.execute(f"SELECT count(*) FROM ({PAIRS[key].oracle()})").fetchall()[0][0] if not problem else "-"
        print(f"{'ok ' if problem is None else 'BAD'} {key} rows={rows} {time.time() - start:.2f}s", problem or "", flush=True)
        bad += problem is not None
    print(f"{bad} of {len(keys or PAIRS)} differ")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
