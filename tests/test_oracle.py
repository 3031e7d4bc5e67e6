"""Every query against its SQL on the given tables, and the entry points."""

import os

import pytest
from compare import compare, connect

import __spark_entry__ as entry_points

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLE = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, con, name):
    assert compare(spark, con, QUERIES[name], ORACLE[name], DATA) > 0


#: Queries over the tables' own files; SQL has no view of those.
FILES = ("inventory_scan", "landing_admission", "landing_scan", "landing_stream")


@pytest.mark.parametrize("name", FILES)
def test_files(spark, name):
    rows = QUERIES[name](spark, DATA).collect()
    found = {os.path.basename(r["path"]): r for r in rows}
    assert set(found) == set(os.listdir(DATA))
    for base, row in found.items():
        size = row["length"] if "length" in row.asDict() else row["size"]
        assert size == os.path.getsize(os.path.join(DATA, base)) and row["kind"] == "parquet"


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["lane", "reason", "kind", "files", "bytes"] and df.count() > 0
