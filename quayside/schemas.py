"""Declared schemas. Nothing is inferred on read."""

from pyspark.sql import types as T

FILE_EVENT = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("op", T.StringType()),
    T.StructField("ts", T.TimestampType()),
])

BINARY_FILE = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("modificationTime", T.TimestampType()),
    T.StructField("length", T.LongType()),
    T.StructField("content", T.BinaryType()),
])

INVENTORY = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("is_dir", T.BooleanType()),
    T.StructField("size", T.LongType()),
    T.StructField("mtime", T.TimestampType()),
])

WORK_MESSAGE = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("filename", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("size", T.LongType()),
    T.StructField("hash", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
])

CONSUMER_MESSAGE = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("hash", T.StringType()),
    T.StructField("size", T.LongType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("queue", T.StringType()),
])

LEDGER = T.StructType([
    T.StructField("hash", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("reason", T.StringType()),
    T.StructField("at", T.TimestampType()),
    T.StructField("expires_at", T.TimestampType()),
])

ARCHIVE_MEMBER = T.StructType([
    T.StructField("archive", T.StringType()),
    T.StructField("member", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("length", T.LongType()),
    T.StructField("content", T.BinaryType()),
    T.StructField("error", T.StringType()),
])

# The given tables.
TABLES = {
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "labels": "doc_id long, quality int, toxic int",
    "pages": "page_id long, url string, html string",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, "
              "o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
}
