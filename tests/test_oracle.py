"""Every registered query against its SQL in DuckDB, on the smallest tables; and partition invariance."""

import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from strandlake.plans import load

DATA = "/root/testdata/sf0.001"
QUERIES, ORACLE = load()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return con


def _plain(v):
    if v is None or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, (float, np.floating)):
        return repr(int(v)) if float(v).is_integer() else repr(float(v))
    if isinstance(v, (bool, np.bool_, int, np.integer)):
        return repr(int(v))
    return str(v)


def _rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(map(_plain, r)) for r in frame[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, db, name):
    assert _rows(QUERIES[name](spark, DATA).toPandas()) == _rows(db.execute(ORACLE[name]).df())


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", ["rrbs_candidates", "fastq_records", "denovo_events", "beta_levels", "read_summary", "wgbs_haplotype_gc", "haplotype_fragments"])
def test_partitioning_does_not_change_rows(spark, name):
    results = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        spark.conf.set("spark.sql.adaptive.enabled", str(n == "7").lower())
        results.append(_rows(QUERIES[name](spark, DATA).toPandas()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert results[0] == results[1]
