"""The continuous landing job: files in, outcomes, messages and ledger entries out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quayside.config import AdmissionConfig
from quayside.functions import scalars
from quayside.operators.ledger import Ledger
from quayside.plans import admission
from quayside.session import scratch_area, written
from quayside.sinks import messages as sink
from quayside.sinks.publish import Topic

Handler = Callable[[DataFrame, int], None]


class LandingPipeline:
    """Classifies every micro-batch of a landing stream.

    Each batch is written once to a folder of its own, which a replay of the same batch replaces; the
    messages and ledger entries are derived from that written, content-free table. A batch that died
    half-way is therefore repeated without doubling anything (effectively once).
    ``publish_to`` takes the written messages further: a ``Topic`` once per batch, its dead letters fail their files;
    any other sink at least once. ``on_batch`` is the hook for any
    other work: it gets the outcomes and the batch number.
    """

    def __init__(self, spark: SparkSession, cfg: AdmissionConfig, out: str, ledger: Ledger,
                 publish_to: sink.MessageSink | None = None, on_batch: Handler | None = None) -> None:
        self.spark, self.cfg, self.out, self.ledger = spark, cfg, out.rstrip("/"), ledger
        self.publish_to, self.on_batch = publish_to, on_batch

    def handle(self, files: DataFrame, batch_id: int) -> None:
        with scratch_area(files.sparkSession, f"landing-{batch_id}"):
            outcomes = self._process(files, batch_id)
        if self.on_batch is not None:
            self.on_batch(outcomes, batch_id)

    def _process(self, files: DataFrame, batch_id: int) -> DataFrame:
        now_us = int(files.sparkSession.sql("SELECT unix_micros(current_timestamp())").first()[0])
        processed = self.ledger.live(now_us).filter("state = 'processed'").select("hash")
        classified = written(admission.admit(files.drop("content"), self.cfg, processed), "classified")
        ready = classified.filter("lane = 'processing'").withColumn("timestamp", scalars.from_micros(F.lit(now_us).cast("long")))
        sink.work_messages(ready, self.cfg.lanes, self.cfg.working_dir).write.mode("overwrite").parquet(
            f"{self.out}/messages/batch={batch_id}")
        messages = files.sparkSession.read.schema("key string, value string").parquet(f"{self.out}/messages/batch={batch_id}")
        if isinstance(self.publish_to, Topic):
            classified = admission.published(classified, messages, self.publish_to, f"landing-{batch_id}")
        elif self.publish_to is not None:
            self.publish_to.write(messages)
        target = f"{self.out}/outcomes/batch={batch_id}"
        classified.write.mode("overwrite").partitionBy("lane").parquet(target)
        outcomes = files.sparkSession.read.schema(classified.schema).parquet(target)
        failed = F.col("reason").startswith("queue_error")
        entered = outcomes.filter(F.col("reason").isNull() | failed)
        self.ledger.append(entered.select(
            "hash", F.when(failed, "failed").otherwise("enqueued").alias("state"), "path", "reason",
            F.lit(now_us).cast("long").alias("at_us")), f"landing-{batch_id}")
        return outcomes

    def start(self, files: DataFrame, checkpoint: str, available_now: bool = True) -> StreamingQuery:
        writer = files.writeStream.foreachBatch(self.handle).option("checkpointLocation", checkpoint)
        if available_now:
            writer = writer.trigger(availableNow=True)
        return writer.start()

    def outcomes(self) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.out}/outcomes").parquet(f"{self.out}/outcomes")

    def messages(self) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.out}/messages").parquet(f"{self.out}/messages")
