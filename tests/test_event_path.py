"""The event path takes every event, whether or not its id is a doc_id."""

import duckdb
from compare import compare, connect

from quayside.plans.catalog import QUERIES
from quayside.plans.oracle import ORACLE

DATA = "/root/testdata/sf0.001"


def test_every_event_gets_a_verdict(spark, tmp_path):
    """Six documents whose ids leave gaps, and arrivals so far apart that debounce lets all of them through."""
    tables = {
        "documents": "SELECT * FROM '{}' WHERE doc_id IN (0, 1, 2, 4, 5, 9)",
        "labels": "SELECT * FROM '{}' WHERE doc_id = 1",
        "events": "SELECT * REPLACE (TIMESTAMP '2024-01-01' + INTERVAL 6 HOUR * event_id AS ts) FROM '{}' WHERE event_id < 90"
                  " AND event_type IN ('click', 'view')",
    }
    for name, sql in tables.items():
        duckdb.sql(sql.format(f"{DATA}/{name}.parquet")).write_parquet(str(tmp_path / f"{name}.parquet"))
    want = {r[0] for r in duckdb.sql(f"SELECT event_id FROM '{tmp_path}/events.parquet'").fetchall()}
    got = {r["event_id"]: r["reason"] for r in QUERIES["event_admission_all"](spark, str(tmp_path)).collect()}
    assert set(got) == want and max(want) > 9
    assert all(got[e] == "pattern_mismatch" for e in want if e % 6 == 3)  # there is no document 3
    assert compare(spark, connect(str(tmp_path)), QUERIES["event_admission_all"], ORACLE["event_admission_all"], str(tmp_path)) == len(want)
