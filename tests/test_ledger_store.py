"""The tiered ledger against the plain view of everything that was logged."""

import os

import numpy as np
import pytest

from quayside.config import LedgerTtl
from quayside.operators import ledger, ledger_store
from quayside.operators.ledger_store import TieredLedger

HOUR = 3_600_000_000
TTL = LedgerTtl(enqueued_us=3 * HOUR, processed_us=6 * HOUR, failed_us=6 * HOUR)
COLUMNS = TieredLedger.COLUMNS


def batch(spark, n, size=30):
    """New hashes and completions of some earlier ones, one hour per batch."""
    rng = np.random.default_rng(n)
    rows = [(f"h{n}-{i}", "enqueued", f"/in/{i}", None, n * HOUR + i) for i in range(size)]
    rows += [(f"h{n - 1 - i % 3}-{rng.integers(size)}", "failed" if i % 5 == 0 else "processed", None, "why" if i % 5 == 0 else None,
              n * HOUR + 100 + i) for i in range(size // 2) if n - 1 - i % 3 >= 0]
    return spark.createDataFrame(rows, COLUMNS)


def rows_of(df):
    return sorted(map(str, df.select("hash", "state", "path", "reason", "at_us").collect()))


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    book = TieredLedger(spark, str(tmp_path_factory.mktemp("ledger") / "store"), TTL, fan=3, file_rows=16)
    sizes = []
    for n in range(30):
        book.append(batch(spark, n), f"landing-{n}")
        sizes.append((len(book.manifest().runs), sum(r.rows for r in book.manifest().runs)))
    return book, sizes


def test_same_entries_as_the_plain_log(spark, store):
    book, _ = store
    log = batch(spark, 0)
    for n in range(1, 30):
        log = log.unionByName(batch(spark, n))
    as_of = 29 * HOUR + 1000
    assert rows_of(book.live(as_of)) == rows_of(ledger.live(ledger.current(log), as_of, TTL))
    hashes = spark.createDataFrame([(f"h{n}-{i}",) for n in (0, 13, 27, 28, 29, 99) for i in range(0, 30, 7)], "hash string")
    want = ledger.live(ledger.current(log), as_of, TTL).join(hashes, "hash", "left_semi")
    assert rows_of(book.lookup(hashes, as_of)) == rows_of(want) and want.count() > 0


def test_store_stays_small(spark, store):
    """Thirty batches leave a few runs; what has expired is gone, so later batches cost what earlier ones did."""
    book, sizes = store
    assert max(runs for runs, _ in sizes) <= 8
    assert max(rows for _, rows in sizes[20:]) <= 1.5 * max(rows for _, rows in sizes[10:20])
    kept = {r.name for r in book.manifest().runs} | {r.name for r in book.manifest(book.manifest().version - 1).runs}
    assert set(os.listdir(f"{book.root}/runs")) <= kept and len(os.listdir(f"{book.root}/manifest")) <= 5


def test_lookups_open_few_files(spark, store):
    book, _ = store
    files = sum(r.files for r in book.manifest().runs)
    fresh = spark.createDataFrame([(f"new{i}",) for i in range(200)], "hash string")
    one = spark.createDataFrame([("h29-3",)], "hash string")
    assert files > 8 and len(book.files_for(fresh)) <= files // 2 and len(book.files_for(one)) <= 2
    assert book.lookup(fresh).isEmpty() and book.files_for(fresh.limit(0)) == []


def test_a_batch_counts_once(spark, store):
    book, _ = store
    before = book.manifest()
    book.append(batch(spark, 29).unionByName(batch(spark, 3)), "landing-29")
    assert book.manifest() == before and book.applied("landing-29") and not book.applied("landing-30")
    book.append(batch(spark, 31).limit(0), "other-0")
    assert book.manifest().done == {"landing": 29, "other": 0}


def test_empty_store_and_ttl(spark, tmp_path):
    book = TieredLedger(spark, str(tmp_path / "empty"), None)
    assert book.live(0).isEmpty() and book.lookup(spark.createDataFrame([("x",)], "hash string")).isEmpty()
    book.append(spark.createDataFrame([(None, "enqueued", None, None, 5), ("a", "processed", None, None, 7)], COLUMNS), "x-0")
    assert book.lookup(spark.createDataFrame([("a",), (None,)], "hash string")).count() == 1
    assert book.live(10**18).count() == 2
    with pytest.raises(ValueError):
        TieredLedger(spark, str(tmp_path), LedgerTtl(enqueued_us=2, processed_us=1, failed_us=3))


def test_filters_hold_what_was_put_in():
    rng = np.random.default_rng(0)
    h = rng.integers(-(1 << 63), 1 << 63, 20_000)
    marks = np.zeros(1 << 19, bool)
    marks[ledger_store.filter_bits(h[:10_000], 1 << 19).ravel()] = True
    hit = marks[ledger_store.filter_bits(h, 1 << 19)].all(axis=1)
    assert hit[:10_000].all() and hit[10_000:].mean() < 0.01
