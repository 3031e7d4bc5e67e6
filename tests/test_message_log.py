"""The message log: every message once, over restarts, appends that died, and a batch that runs again."""

import pytest

from quayside.sources.message_log import MessageLog


def test_every_message_once_over_restarts(spark, tmp_path):
    log = MessageLog(spark, str(tmp_path / "log"))
    seen, crash = {}, {"left": 1}

    def put(rows, batch):
        got = sorted(r["key"] for r in rows.collect())
        if batch == 1 and crash["left"]:
            crash["left"] -= 1
            raise RuntimeError("lost on the way")
        seen[batch] = got

    def run():
        q = log.stream().writeStream.foreachBatch(put).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination()

    rows = lambda a, b: spark.createDataFrame([(f"k{i:03d}", "v") for i in range(a, b)], "key string, value string").repartition(3)
    log.append(rows(0, 20))
    run()
    log.append(rows(20, 50))
    log.append(rows(50, 50))
    with pytest.raises(Exception, match="lost on the way"):
        run()
    (tmp_path / "log" / "messages" / "000000000003-died").mkdir()  # an append that never got its number
    log.append(rows(50, 60))
    run()
    run()
    assert sorted(k for some in seen.values() for k in some) == [f"k{i:03d}" for i in range(60)]
    assert seen[0] == [f"k{i:03d}" for i in range(20)] and log.appends() == 4


def test_empty_log(spark, tmp_path):
    log = MessageLog(spark, str(tmp_path / "log"))
    out = []
    q = log.stream().writeStream.foreachBatch(lambda rows, batch: out.append(rows.count())).option(
        "checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sum(out) == 0 and log.appends() == 0
