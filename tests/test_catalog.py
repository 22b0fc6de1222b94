"""Registered queries against the same rows from SQL."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from mzframe import catalog

DATA = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def rows_of(columns, names, rows):
    at = [columns.index(n) for n in names]
    return sorted(repr(tuple(plain(r[i]) for i in at)) for r in rows)


def compare(spark, tables, name):
    df = entry.queries()[name](spark, DATA)
    names = sorted(df.columns)
    want = tables.sql(entry.oracle_sql()[name])
    assert sorted(want.columns) == names
    kinds = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    assert {f.name: kinds[f.dataType.simpleString()] for f in df.schema} == dict(zip(want.columns, map(str, want.types), strict=True))
    assert rows_of(df.columns, names, df.collect()) == rows_of(want.columns, names, want.fetchall())


NAMES = sorted(n for n in catalog.ORACLE_SQL)


@pytest.mark.parametrize("name", NAMES)
def test_query_gives_the_rows_of_its_sql(spark, tables, name):
    if not os.path.isdir(DATA):
        pytest.skip("no tables")
    compare(spark, tables, name)


def test_checksums_equal_the_library(spark):
    import zlib

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    got = {r["doc_id"]: r["checksum"] for r in catalog.token_checksum(spark, DATA).collect()}
    assert got == {i: None if t is None else f"{zlib.crc32(t.encode()):08x}" for i, t in texts.items()} and len(got) >= 200


def test_entry_and_registry(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    if os.path.isdir(DATA):
        assert entry.entry(spark).limit(1).count() == 1
