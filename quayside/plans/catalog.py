"""Every operator as a query over the given tables: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quayside.config import DAY_US, HOUR_US, PROCESSING_SECONDS, SIZE_BYTES, AdmissionConfig, LedgerTtl, RetryConfig
from quayside.functions import paths, patterns, scalars
from quayside.operators import filters, housekeeping, ledger, metrics, ordered, retry, rules, sequential, skew, stability
from quayside.plans import admission, bindings, event_path
from quayside.plans.bindings import EPOCH_US
from quayside.session import hadoop_path, scratch, written
from quayside.sinks import messages as sink
from quayside.sinks import publish
from quayside.sources import archives, exposition, landing, messages

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Fixed parameters shared with the SQL oracle.
CONFIG = AdmissionConfig(include=("*.xml", "*.json"), exclude=(".*", "*.tmp"), min_bytes=100, max_bytes=16_384)
GAP_US = 6 * HOUR_US
TTL = LedgerTtl(enqueued_us=6 * HOUR_US, processed_us=9 * HOUR_US, failed_us=9 * HOUR_US)
AS_OF_US = EPOCH_US + 12 * HOUR_US
RETENTION = {"processed": 1, "failed": 3, "ignored": 0}
RETENTION_AS_OF_US = EPOCH_US + 7 * DAY_US
PATTERNS = ("*", "*.xml", "*.XML", "*.tar.gz", "en_*.xml", "e?_*[0-5].json", "fr_[^1-4]*.t*", "[", "en_380.xml")
RETRIES = RetryConfig(max_attempts=3, initial_delay_ms=1_000, max_delay_ms=2_500, multiplier=2.0)
RANGE_US = 6 * HOUR_US
MAX_MESSAGE_BYTES = 281
LANES = ("processing", "processed", "failed", "ignored", "tmp")


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# --- admission -----------------------------------------------------------------------------------

def _classified(spark: SparkSession, sf_dir: str, mode: str = "event") -> DataFrame:
    """Unlabelled documents as arriving files, labelled ones as the processed part of the ledger.

    One pass reads the contents and hashes what name and size leave over; everything after it works on
    the written narrow rows. A labelled file of equal hash has equal name and size, so the ones
    turned away early can not hide a duplicate.
    """
    decided = admission.decide(bindings.files(spark, sf_dir), CONFIG, mode)
    hashed = F.when(F.col("reason").isNull(), scalars.content_hash("filename", "content"))
    rows = written(decided.withColumn("hash", hashed).drop("content", "lang", "source", "n_chars"), "decided")
    labels = bindings.labels(spark, sf_dir)
    arriving = bindings.unprocessed(rows, labels)
    done = bindings.processed(rows.filter("hash is not null"), labels)
    return admission.settle(arriving.filter("reason is not null"), arriving.filter("reason is null"), done,
                            ("arrived_us", "path", "doc_id"))


@query
def admission_summary(spark, sf_dir):
    return admission.summary(_classified(spark, sf_dir))


@query
def lane_routing(spark, sf_dir):
    return _classified(spark, sf_dir).select("doc_id", "lane", F.coalesce("reason", F.lit("accepted")).alias("reason"))


def _event_path(spark: SparkSession, sf_dir: str, events: DataFrame, docs: DataFrame, hash_of) -> DataFrame:
    stable = stability.verdict(bindings.file_samples(spark, sf_dir), 5, 20 * DAY_US).select(
        F.col("path").alias("watched"), "stable", "duration_us")
    out = event_path.admit_events(
        events, stable, dataclasses.replace(CONFIG, debounce_us=5 * HOUR_US), hash_of,
        bindings.processed(docs, bindings.labels(spark, sf_dir)), "watched", ["source"], 1, 24 * HOUR_US, 2)
    return out.select("event_id", "ready_us", "lane", F.coalesce("reason", F.lit("accepted")).alias("reason"))


@query
def event_admission_all(spark, sf_dir):
    """The event path over every event: event n announces document n modulo the number of documents.

    Where ids leave gaps and there is no such document, the event announces its watched path itself, which no
    name pattern accepts.
    """
    docs = bindings.hashed_table(spark, sf_dir, "path", "source", "length")
    announced = F.col("event_id") % max(docs.count(), 1)
    events = bindings.file_events(spark, sf_dir).withColumnRenamed("path", "watched").join(
        docs.drop("hash").withColumnRenamed("doc_id", "_doc"), announced == F.col("_doc"), "left").withColumn(
        "path", F.coalesce("path", "watched"))
    hashes = docs.select(F.col("doc_id").alias("_doc"), "hash")
    return _event_path(spark, sf_dir, events, docs,
                       lambda rows: rows.join(hashes, announced == F.col("_doc")).drop("_doc"))


@query
def global_rate_admission(spark, sf_dir):
    """One limiter for everything, as a single history over all events."""
    e = bindings.events(spark, sf_dir).select("us", "event_id")
    return sequential.rate_admission(e, [], "us", "event_id", 10, HOUR_US, 10).select("event_id", "admitted")


@query
def file_facts(spark, sf_dir):
    f = landing.facts(bindings.files(spark, sf_dir).drop("content"))
    return f.select(
        "doc_id", "filename", "directory", "extension", "kind", paths.is_archive("filename").alias("is_archive"),
        paths.join("/landing/", F.concat(F.lit("./"), "lang"), F.concat(F.lit("../"), "kind"), F.col("filename"))
        .alias("target"))


@query
def content_hash(spark, sf_dir):
    return bindings.hashed_files(spark, sf_dir).select("doc_id", "hash")


@query
def event_op_filter(spark, sf_dir):
    e = bindings.file_events(spark, sf_dir)
    mask = F.element_at(F.create_map(*[F.lit(x) for p in filters.OP_BITS.items() for x in p]), F.col("op"))
    return e.filter(filters.is_arrival("op") & filters.is_arrival_mask(mask)).select("event_id", "path", "op")


@query
def event_log(spark, sf_dir):
    return bindings.file_events(spark, sf_dir).select("event_id", "path", "op", "us")


@query
def pattern_filter(spark, sf_dir):
    f = bindings.files(spark, sf_dir)
    return f.filter(patterns.accepts("filename", CONFIG.include, CONFIG.exclude)).select("doc_id", "filename")


@query
def pattern_match_matrix(spark, sf_dir):
    f = bindings.files(spark, sf_dir)
    return f.select("doc_id", *[patterns.match("filename", p).alias(f"p{i}") for i, p in enumerate(PATTERNS)])


@query
def size_filter(spark, sf_dir):
    f = bindings.files(spark, sf_dir)
    reason = filters.size_reason("length", CONFIG.min_bytes, CONFIG.max_bytes)
    return f.select("doc_id", "length", F.coalesce(reason, F.lit("ok")).alias("verdict"))


@query
def sidecar_filter(spark, sf_dir):
    f = bindings.files(spark, sf_dir)
    suffix = F.when(F.col("doc_id") % 7 == 0, ":Zone.Identifier").when(
        F.col("doc_id") % 7 == 1, ".Zone.Identifier").otherwise("")
    named = f.select("doc_id", F.concat("path", suffix).alias("path"))
    return named.select("doc_id", filters.is_sidecar("path", "event").alias("dropped_by_event"),
                        filters.is_sidecar("path", "scan").alias("dropped_by_scan"))


@query
def rule_violations(spark, sf_dir):
    c = bindings.table(spark, sf_dir, "customer")
    checks = [
        (F.col("c_acctbal") <= 0, "balance must be positive"),
        (F.col("c_mktsegment") == "", "segment is required"),
        ((F.col("c_mktsegment") == "BUILDING") & (F.col("c_acctbal") < 1000), "building needs a balance of 1000"),
        (F.col("c_nationkey") < 3, "nation is not served"),
    ]
    return rules.violation_counts(c, checks)


@query
def order_rule_violations(spark, sf_dir):
    o = bindings.table(spark, sf_dir, "orders")
    checks = [
        ((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") < 50000), "finished orders need a price"),
        (F.col("o_orderpriority") == "4-NOT SPECIFIED", "priority is required"),
        (F.col("o_totalprice") > 400000, "price is out of range"),
    ]
    v = rules.violations(o, checks).filter(F.size("violations") > 0)
    return v.select("o_orderkey", "first_violation", F.concat_ws("|", "violations").alias("violations"))


# --- archives ------------------------------------------------------------------------------------

def _archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents packed into zip files of up to 25 neighbouring ids; every tenth archive is damaged."""
    import io
    import zipfile

    import pandas as pd

    def pack(batches):
        for pdf in batches:
            bodies = []
            for number, members in zip(pdf["number"], pdf["members"]):
                buffer = io.BytesIO()
                with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
                    for m in members:
                        z.writestr(f"{m['lang']}/{m['doc_id']}.txt", bytes(m["content"]))
                body = buffer.getvalue()
                bodies.append(body[: len(body) // 2] if number % 10 == 9 else body)
            yield pd.DataFrame({"path": [f"/landing/batch/{n}.zip" for n in pdf["number"]], "content": bodies})

    f = bindings.files(spark, sf_dir).select(
        "doc_id", "lang", "content", F.floor(F.col("doc_id") / 25).alias("number"))
    groups = f.groupBy("number").agg(F.collect_list(F.struct("doc_id", "lang", "content")).alias("members"))
    return groups.mapInPandas(pack, "path string, content binary")


@query
def archive_members(spark, sf_dir):
    m = archives.expand(_archives(spark, sf_dir))
    return m.select("archive", "member", F.when(F.col("error").isNull(), F.col("path")).alias("path"), "length",
                    F.sha2("content", 256).alias("sha256"),
                    F.substring_index("error", ":", 1).alias("error"))


@query
def files_with_members(spark, sf_dir):
    plain = bindings.files(spark, sf_dir).select(
        "path", F.lit(None).cast("timestamp").alias("modificationTime"), "length", "content")
    both = archives.plain_and_members(plain, _archives(spark, sf_dir))
    named = both.withColumn("kind", F.when(F.col("error").isNull(), paths.kind("path")).otherwise("failed"))
    return named.groupBy("kind").agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


@query
def archive_path_audit(spark, sf_dir):
    shape = (
        F.when(F.col("doc_id") % 40 == 7, F.concat(F.lit("../"), "filename"))
        .when(F.col("doc_id") % 40 == 8, F.concat(F.lit("a/../../../"), "filename"))
        .when(F.col("doc_id") % 5 == 1, F.concat(F.lit("a/./b//../"), "filename"))
        .when(F.col("doc_id") % 5 == 2, F.concat("lang", F.lit("/"), "filename"))
        .otherwise(F.col("filename")))
    members = bindings.files(spark, sf_dir).select(
        F.floor(F.col("doc_id") / 10).alias("archive"), F.lit("/landing/in").alias("dest"), shape.alias("member"))
    return archives.audit(members)


# --- messages ------------------------------------------------------------------------------------

def messages_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = bindings.hashed_files(spark, sf_dir).withColumn("kind", paths.kind("filename")).withColumn(
        "timestamp", scalars.from_micros("arrived_us"))
    return sink.work_messages(f)


@query
def work_messages(spark, sf_dir):
    return messages_of(spark, sf_dir)


def _publish_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' admission, its messages published to a broker with a size limit."""
    rows = written(_classified(spark, sf_dir), "classified")
    accepted = rows.filter("reason IS NULL").withColumn("timestamp", scalars.from_micros("arrived_us"))
    topic = publish.Topic(spark, scratch(spark, "topic"), publish.SizeLimit(MAX_MESSAGE_BYTES))
    return admission.published(rows, sink.work_messages(accepted), topic, "documents-0")


@query
def admission_published(spark, sf_dir):
    return _publish_accepted(spark, sf_dir).select("doc_id", "lane", F.coalesce("reason", F.lit("accepted")).alias("reason"))


@query
def outcome_counters_published(spark, sf_dir):
    o = _publish_accepted(spark, sf_dir).withColumn("reason", F.coalesce("reason", F.lit("accepted")))
    return metrics.outcome_counters(o, ["kind"], "event", is_archive=paths.is_archive("filename")).select(
        "kind", "detected", "sent", "queue_errors", "duplicated", "rejected", "ignored")


@query
def publish_audit(spark, sf_dir):
    """What a broker with a size limit took of all work messages, and what became a dead letter."""
    topic = publish.Topic(spark, scratch(spark, "topic"), publish.SizeLimit(MAX_MESSAGE_BYTES))
    topic.publish(messages_of(spark, sf_dir), "all-0")
    sent, dead = topic.read()
    both = sent.withColumn("error", F.lit(None).cast("string")).unionByName(dead)
    return both.groupBy(F.get_json_object("value", "$.kind").alias("kind"), "error").agg(
        F.count("*").alias("messages"), F.sum(F.octet_length("value").cast("long")).alias("bytes"), F.sum("attempts").alias("attempts"))


@query
def message_decode(spark, sf_dir):
    bodies = messages_of(spark, sf_dir).select("value").unionByName(
        bindings.events(spark, sf_dir).select("event_id", F.col("props").alias("value")).select(
            F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("{broken "), "value")).otherwise(F.col("value"))
            .alias("value")))
    m = messages.decode(bodies)
    return m.groupBy("undecodable").agg(
        F.count("*").alias("messages"), F.count("path").alias("with_path"), F.count("queue").alias("with_queue"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"),
        F.coalesce(F.max(scalars.micros("timestamp")), F.lit(0)).alias("last_us"))


@query
def schema_drift(spark, sf_dir):
    bodies = messages_of(spark, sf_dir).select("value").unionByName(
        bindings.events(spark, sf_dir).select(F.col("props").alias("value")))
    return messages.schema_drift(bodies, ["path", "hash", "size", "timestamp", "queue"])


@query
def attempt_rollup(spark, sf_dir):
    return retry.rollup(bindings.attempts(spark, sf_dir), ["user_id", "day"], RETRIES)


@query
def dead_letters(spark, sf_dir):
    return sink.dead_letters(attempt_rollup(spark, sf_dir)).drop("status")


@query
def retry_schedule(spark, sf_dir):
    first = bindings.outcomes(spark, sf_dir).filter(~F.col("ok")).select("event_id", "us")
    return retry.schedule(first, "us", RETRIES).select("event_id", "attempt", "planned_us")


# --- ledger --------------------------------------------------------------------------------------

@query
def ledger_current(spark, sf_dir):
    return ledger.current(bindings.ledger_log(spark, sf_dir))


@query
def ledger_live(spark, sf_dir):
    return ledger.live(ledger.current(bindings.ledger_log(spark, sf_dir)), AS_OF_US, TTL).select(
        "hash", "state", "at_us", "expires_us")


@query
def new_files_anti(spark, sf_dir):
    h, labels = bindings.hashed_table(spark, sf_dir), bindings.labels(spark, sf_dir)
    done = ledger.key_set(bindings.processed(h, labels))
    return ledger.new_only(bindings.unprocessed(h, labels), done).select("doc_id", "hash")


@query
def duplicates_semi(spark, sf_dir):
    h, labels = bindings.hashed_table(spark, sf_dir), bindings.labels(spark, sf_dir)
    done = ledger.key_set(bindings.processed(h, labels))
    return ledger.duplicates(bindings.unprocessed(h, labels), done).select("doc_id", "hash")


@query
def ttl_dedup_join(spark, sf_dir):
    h, labels = bindings.hashed_table(spark, sf_dir, "arrived_us"), bindings.labels(spark, sf_dir)
    entries = bindings.processed(h, labels).select("hash", F.col("arrived_us").alias("at_us"))
    arrivals = bindings.unprocessed(h, labels).select("doc_id", "hash", "arrived_us")
    return ledger.seen_within_ttl(arrivals, entries, 6 * HOUR_US, "doc_id").select(
        "doc_id", "last_at_us", "is_duplicate")


@query
def orphan_replay(spark, sf_dir):
    h, labels = bindings.hashed_table(spark, sf_dir, "path"), bindings.labels(spark, sf_dir)
    processing = h.select("doc_id", "path", "hash", F.col("path").endswith(".tmp").alias("is_dir"))
    done = ledger.key_set(bindings.processed(h, labels))
    out = ledger.orphans(processing, done, "/landing/incoming")
    return out.select("doc_id", "replay_path")


@query
def orphan_replay_all(spark, sf_dir):
    processing = bindings.files(spark, sf_dir).select("doc_id", "path", F.col("path").endswith(".tmp").alias("is_dir"))
    return ledger.orphans(processing, None, "/landing/incoming").select("doc_id", "replay_path")


@query
def ledger_lifecycle(spark, sf_dir):
    return ledger.lifecycle(bindings.ledger_log(spark, sf_dir), AS_OF_US, TTL)


@query
def failed_reason_unpack(spark, sf_dir):
    e = bindings.events(spark, sf_dir)
    reason = F.concat_ws(":", "event_type", F.col("user_id").cast("string"))
    packed = e.select("event_id", scalars.pack_failure(F.floor(F.col("us") / 1_000_000), reason).alias("packed"))
    epoch, text = scalars.unpack_failure("packed")
    return packed.select("event_id", "packed", epoch.alias("epoch"), text.alias("reason"))


@query
def single_winner(spark, sf_dir):
    f = bindings.hashed_table(spark, sf_dir, "arrived_us", "path")
    return ordered.first_of_group(f, ["hash"], ["arrived_us", "path", "doc_id"], "wins").select(
        "doc_id", "hash", "wins")


@query
def lane_collisions(spark, sf_dir):
    moves = bindings.lane_files(spark, sf_dir).select(
        "lane", "filename", F.concat_ws("#", "path", F.col("doc_id").cast("string")).alias("path"),
        F.col("mtime_us").alias("moved_us"), F.col("doc_id").alias("file_id"))
    return housekeeping.lane_survivors(moves)


# --- sequential ----------------------------------------------------------------------------------

@query
def debounce(spark, sf_dir):
    e = bindings.file_events(spark, sf_dir).select("path", "us", "event_id")
    return sequential.debounce(e, ["path"], "us", "event_id", GAP_US).filter("accepted").select("event_id", "path", "us")


@query
def lease_grants(spark, sf_dir):
    e = bindings.file_events(spark, sf_dir).select(
        "path", "us", "event_id", (F.col("op") == "REMOVE").alias("release"))
    return sequential.lease_grants(e, ["path"], "us", "event_id", 30 * HOUR_US, "release").select(
        "event_id", "release", F.col("accepted").alias("granted"))


@query
def rate_admission(spark, sf_dir):
    e = bindings.events(spark, sf_dir).select("event_type", "us", "event_id")
    return sequential.rate_admission(e, ["event_type"], "us", "event_id", 2, HOUR_US, 2).select("event_id", "admitted")


@query
def fixed_window_cap(spark, sf_dir):
    e = bindings.events(spark, sf_dir).select("event_type", "us", "event_id")
    return housekeeping.fixed_window_cap(e, ["event_type"], "us", "event_id", HOUR_US, 2).select(
        "event_id", "event_type", "window", "rank")


@query
def breaker_verdicts(spark, sf_dir):
    return sequential.breaker_verdicts(
        bindings.outcomes(spark, sf_dir), ["sink"], "us", "event_id", 2, 2 * HOUR_US).select(
        "event_id", "verdict", "state_after", "failures_after")


@query
def breaker_episodes(spark, sf_dir):
    v = sequential.breaker_verdicts(bindings.outcomes(spark, sf_dir), ["sink"], "us", "event_id", 2, 2 * HOUR_US)
    return sequential.breaker_episodes(v, ["sink"], "us")


@query
def ttl_dedup(spark, sf_dir):
    f = bindings.hashed_table(spark, sf_dir, "arrived_us")
    return sequential.ttl_dedup(f, "hash", "arrived_us", "doc_id", 5 * HOUR_US).select("doc_id", "accepted")


@query
def stability_verdict(spark, sf_dir):
    return stability.verdict(bindings.file_samples(spark, sf_dir), 5, 2 * DAY_US).select(
        "path", "samples", "stable", "stable_at_sample", "reason")


@query
def stability_duration(spark, sf_dir):
    v = stability.verdict(bindings.file_samples(spark, sf_dir), 5, 30 * DAY_US)
    return v.filter("stable").select("path", "duration_us")


# --- metrics -------------------------------------------------------------------------------------

def _daily_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _classified(spark, sf_dir).withColumn("day", F.floor(F.col("doc_id") / 24)).withColumn(
        "reason", F.coalesce("reason", F.lit("accepted")))
    return metrics.outcome_counters(o, ["day"], "event", is_archive=paths.is_archive("filename"),
                                    storage_errors=F.col("doc_id") % 50 == 0)


@query
def outcome_counters_daily(spark, sf_dir):
    return _daily_counters(spark, sf_dir)


@query
def success_rate(spark, sf_dir):
    return metrics.success_rate(_daily_counters(spark, sf_dir)).select("day", "success_rate", "total")


@query
def size_histogram(spark, sf_dir):
    h = metrics.histogram(bindings.files(spark, sf_dir), "length", SIZE_BYTES, ["lang"])
    return metrics.histogram_rows(h, SIZE_BYTES, ["lang", "total", "observations"])


@query
def duration_histogram(spark, sf_dir):
    e = bindings.events(spark, sf_dir).withColumn("seconds", F.col("value") / 10)
    h = metrics.histogram(e, "seconds", PROCESSING_SECONDS)
    return metrics.histogram_rows(h, PROCESSING_SECONDS, ["observations"])


@query
def histogram_quantiles(spark, sf_dir):
    e = bindings.events(spark, sf_dir).withColumn("seconds", F.col("value") / 10)
    h = metrics.histogram(e, "seconds", PROCESSING_SECONDS, ["event_type"])
    return h.select("event_type", *[F.round(metrics.quantile(q, PROCESSING_SECONDS), 6).alias(name)
                                    for name, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))])


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = bindings.events(spark, sf_dir).select("event_id", "us", "event_type")
    counted = metrics.daily_running(e, ["event_type"])
    return counted.select(F.col("event_type").alias("name"), "us", F.col("event_id").alias("sample_id"),
                          F.col("running_count").cast("double").alias("value"))


@query
def counter_rate(spark, sf_dir):
    names = bindings.events(spark, sf_dir).select(F.col("event_type").alias("name"))
    r = metrics.counter_rate(_samples(spark, sf_dir), RANGE_US, sizes_from=names)
    return r.select("sample_id", "name", F.round("rate", 9).alias("rate"))


@query
def sliding_quantiles(spark, sf_dir):
    """p50, p95 and p99 at every event of what its type took within the hours before, from bucket counters that start over daily."""
    e = bindings.events(spark, sf_dir).select("event_id", "us", "event_type", scalars.bucket_index(
        F.col("value") / 10, PROCESSING_SECONDS).alias("bucket")).withColumn("day", ordered.time_segment("us", DAY_US))
    width = PROCESSING_SECONDS.count + 1
    per_day = ["event_type", "day"]
    counts = {f"le{i}": F.when(F.col("bucket") <= i, 1).otherwise(0) for i in range(width)}
    counted = skew.by_size(e, per_day, ["us", "event_id"], lambda rows, segment: ordered.running_sums(
        rows, per_day, ["us", "event_id"], counts, segment), metrics.BUCKET_ROWS)
    samples = counted.select(F.col("event_type").alias("name"), "us", F.col("event_id").alias("sample_id"),
                             F.array(*[F.col(c).cast("double") for c in counts]).alias("value"))
    out = metrics.bucket_increase(samples, RANGE_US, width, sizes_from=e.select(F.col("event_type").alias("name")))
    return out.select("sample_id", *[F.round(metrics.quantile(q, PROCESSING_SECONDS, "increase"), 6).alias(name)
                                     for name, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))])


@query
def daily_running_counter(spark, sf_dir):
    e = bindings.events(spark, sf_dir).select("event_id", "us", "event_type", "ts")
    out = metrics.daily_running(e, ["event_type"])
    return out.select("event_id", "event_type", scalars.micros(scalars.next_midnight("ts")).alias("resets_us"),
                      "running_count")


@query
def reset_epoch_counter(spark, sf_dir):
    e = bindings.events(spark, sf_dir).select("event_id", "us", "event_type", (F.col("user_id") % 10).alias("instance"))
    out = metrics.reset_epochs(e, ["instance"], F.col("event_type") == "signup", ["event_type"])
    return out.select("event_id", "instance", "event_type", "epoch", "running_count")


@query
def concurrency_gauge(spark, sf_dir):
    return metrics.gauge(bindings.intervals(spark, sf_dir), "start_us", "finish_us")


@query
def backlog_gauge(spark, sf_dir):
    i = bindings.intervals(spark, sf_dir).filter("start_us >= submit_us")
    return metrics.backlog(i, "submit_us", "start_us")


@query
def windowed_outcomes(spark, sf_dir):
    e = bindings.events(spark, sf_dir).withColumn("at", F.col("ts").cast("timestamp"))
    w = metrics.windowed_outcomes(e, "at", "6 hours", {
        "detected": F.col("event_type").isin("click", "view"), "processed": F.col("event_type") == "purchase",
        "rejected": F.col("event_type") == "signup", "errors": F.col("event_type") == "error"})
    return w.withColumn("window_us", scalars.micros("window_start")).drop("window_start")


@query
def distinct_content(spark, sf_dir):
    f = bindings.hashed_files(spark, sf_dir).withColumn("kind", paths.kind("filename"))
    return metrics.distinct_content(f)


@query
def trailing_contents(spark, sf_dir):
    """Distinct contents per kind over the trailing four hours, exact and from hourly sketches."""
    f = bindings.hashed_table(spark, sf_dir, "filename", "arrived_us").select(
        paths.kind("filename").alias("kind"), F.floor(F.col("arrived_us") / HOUR_US).alias("hour"), "hash")
    kept = written(metrics.content_sketches(f, ["kind", "hour"]), "sketches")
    ranges = F.explode(metrics.trailing("hour", 4)).alias("until")
    about = metrics.merged_contents(kept.select("kind", "files", "sketch", ranges), ["kind", "until"])
    exact = f.distinct().select("kind", "hash", ranges).groupBy("kind", "until").agg(F.count_distinct("hash").alias("contents"))
    return about.join(exact, ["kind", "until"]).select(
        "kind", "until", "files", "contents",
        (F.abs(F.col("contents_about") - F.col("contents")) <= 0.03 * F.col("contents") + 1).alias("estimate_holds"))


@query
def dry_run(spark, sf_dir):
    """How many work messages there would be, and of what size; nothing is kept."""
    seen = Observation("dry-run")
    sink.NoopSink().write(messages_of(spark, sf_dir).observe(
        seen, F.count("*").alias("messages"), F.coalesce(F.sum(F.octet_length("value").cast("long")), F.lit(0).cast("long")).alias("bytes")))
    got = seen.get
    return spark.createDataFrame([(got["messages"], got["bytes"])], "messages long, bytes long")


@query
def lane_folders(spark, sf_dir):
    """Outcomes written to a folder per lane; each lane is read from its folder alone."""
    place = scratch(spark, "lanes")
    sink.write_lanes(_classified(spark, sf_dir).select("doc_id", "length", "reason", "lane"), place)
    lanes = spark.read.schema("doc_id long, length long, reason string, lane string").option("basePath", place)
    out = None
    for lane in sorted(set(admission.LANES.values())):
        fs, folder = hadoop_path(spark, f"{place}/lane={lane}")
        if fs.exists(folder):
            part = lanes.parquet(f"{place}/lane={lane}")
            out = part if out is None else out.unionByName(part)
    out = out if out is not None else spark.createDataFrame([], "doc_id long, length long, reason string, lane string")
    return out.groupBy("lane").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"), F.count("reason").alias("with_reason"))


@query
def exposition_parse(spark, sf_dir):
    e = bindings.events(spark, sf_dir)
    line = (
        F.when(F.col("event_id") % 8 == 0, F.concat(F.lit("# HELP x "), "event_type"))
        .when(F.col("event_id") % 8 == 1, F.lit("  "))
        .when(F.col("event_id") % 8 == 2, F.concat(F.lit("x_total 1.5e+0"), (F.col("event_id") % 7).cast("string")))
        .when(F.col("event_id") % 8 == 3, F.concat(F.lit('x_bucket{le="0.1"} '), F.col("event_id").cast("string")))
        .otherwise(F.concat("event_type", F.lit("_total "), F.col("event_id").cast("string"), F.lit(".25"))))
    return exposition.parse_both(e.select("event_id", line.alias("line")), keep=("event_id",))


@query
def health_rollup(spark, sf_dir):
    checks = rules.HealthChecks()
    checks.register("errors", F.avg(F.when(F.col("ok"), 0).otherwise(1)) < 0.2, "too many errors")
    checks.register("traffic", F.count("*") > 10, "no traffic")
    checks.register("last_call", F.max_by("ok", F.struct("us", "event_id")), "last call failed")
    report = checks.report(bindings.outcomes(spark, sf_dir), ["sink"])
    return rules.health_rows(report, ["sink"])


@query
def path_list_explode(spark, sf_dir):
    d = bindings.table(spark, sf_dir, "documents").select(
        "doc_id", F.concat_ws(",", F.lit("/in"), "source", "lang").alias("paths"))
    return d.select("doc_id", F.posexplode(scalars.split_list("paths")).alias("position", "path"))


# --- housekeeping --------------------------------------------------------------------------------

@query
def retention_candidates(spark, sf_dir):
    return housekeeping.retention_candidates(bindings.lane_files(spark, sf_dir), RETENTION, RETENTION_AS_OF_US).select(
        "doc_id", "lane", "age_days")


@query
def cleanup_summary(spark, sf_dir):
    due = housekeeping.retention_candidates(bindings.lane_files(spark, sf_dir), RETENTION, RETENTION_AS_OF_US)
    return housekeeping.cleanup_summary(due)


@query
def lane_census(spark, sf_dir):
    inventory = bindings.lane_files(spark, sf_dir).select("lane", F.col("path").endswith(".tmp").alias("is_dir"))
    return housekeeping.lane_census(inventory)


@query
def empty_directories(spark, sf_dir):
    dirs = housekeeping.directories_of(bindings.page_files(spark, sf_dir))
    entries = dirs.unionByName(bindings.kept_page_files(spark, sf_dir).select("path"))
    protected = dirs.filter(paths.basename("path") == "de")
    return housekeeping.empty_directories(dirs, entries, protected)


def _vanishing(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirs = written(housekeeping.directories_of(bindings.page_files(spark, sf_dir)), "dirs")
    protected = dirs.filter(paths.basename("path") == "de")
    return housekeeping.empty_closure(dirs, bindings.kept_page_files(spark, sf_dir), protected)


@query
def empty_directory_closure(spark, sf_dir):
    return _vanishing(spark, sf_dir)


@query
def counters_of_all_stages(spark, sf_dir):
    """All counters of the landing zone, raised by admission and publishing, by archives that can not be opened, and by clean-up."""
    outcomes = _publish_accepted(spark, sf_dir).withColumn("reason", F.coalesce("reason", F.lit("accepted")))
    failed = archives.expand(_archives(spark, sf_dir)).filter("error IS NOT NULL").select(
        F.substring_index("error", ":", 1).alias("reason"))
    return metrics.total_counters(
        metrics.outcome_counters(outcomes, [], "event", is_archive=paths.is_archive("filename")),
        metrics.outcome_counters(failed, [], "event", is_archive=F.lit(True)),
        _vanishing(spark, sf_dir).agg(F.count("*").alias("empty_directories_removed")))


@query
def protected_dirs(spark, sf_dir):
    host = F.concat(F.lit("/"), F.split("path", "/")[1])
    return housekeeping.protected_dirs(bindings.page_files(spark, sf_dir).select(host.alias("path")), LANES)


@query
def missing_lanes(spark, sf_dir):
    seen = bindings.files(spark, sf_dir).select(
        F.concat_ws("/", "source", "lang").alias("root"),
        F.get(F.array(*[F.lit(x) for x in LANES]), (F.col("n_chars") % 5).cast("int")).alias("lane"))
    return housekeeping.missing_lanes(seen, LANES)
