"""The column text_sha256 does not depend on how many prefix groups there are."""

import hashlib

import pytest

from quayside.llm import exact_dedup


@pytest.mark.parametrize("hash_all", [False, True])
def test_hashes_by_number_of_groups(spark, monkeypatch, hash_all):
    rows = [(1, "aa"), (2, "aa"), (3, "bb"), (4, "a longer one"), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    few = sorted(map(tuple, exact_dedup.exact_dedup(df, hash_all=hash_all).collect()))
    monkeypatch.setattr(exact_dedup, "FEW_GROUPS", 0)
    assert sorted(map(tuple, exact_dedup.exact_dedup(df, hash_all=hash_all).collect())) == few
    hashes = {r[0]: r[4] for r in few}
    assert hashes[1] == hashes[2] == hashlib.sha256(b"aa").hexdigest()
    assert all((hashes[d] is not None) == hash_all for d in (3, 4, 5))
