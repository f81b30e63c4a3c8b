"""DuckDB beside Spark: the same tables, and rows made comparable."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connect(sf_dir: str = SF_DIR):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted(str([plain(r[c]) for c in cols]) for r in df.collect())


def duck_rows(c, sql: str):
    rel = c.execute(sql)
    names = [d[0] for d in rel.description]
    at = [names.index(n) for n in sorted(names)]
    return sorted(names), sorted(str([plain(r[i]) for i in at]) for r in rel.fetchall())
