"""Real files in temporary folders: hidden, empty, nested, archives of every kind."""

import hashlib
import io
import os
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quayside.config import AdmissionConfig
from quayside.plans import admission
from quayside.session import prepare
from quayside.sinks import messages as sink
from quayside.sources import archives, exposition, inventory, landing, messages

XML = b"<cargo><crate no='%d' weight='%d'/></cargo>"


def make_zip(members):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for name, body in members:
            z.writestr(name, body)
    return buffer.getvalue()


@pytest.fixture
def root(tmp_path):
    def put(name, body):
        target = tmp_path / "incoming" / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(body)
    put.path = str(tmp_path / "incoming")
    os.makedirs(put.path)
    return put


def config(root, **kw):
    return AdmissionConfig(roots=(root.path,), min_bytes=10, **kw)


def reasons(df):
    return {(os.path.basename(r["path"]), r["reason"], r["lane"]) for r in df.collect()}


def test_three_files_are_accepted(spark, root):
    for i in range(3):
        root(f"test_{i + 1}.xml", XML % (i, i))
    root("sub/test.txt", b"some plain text")
    out = admission.admit_landing(spark, config(root))
    rows = {os.path.basename(r["path"]): r for r in out.collect()}
    assert [rows[f"test_{i}.xml"]["lane"] for i in (1, 2, 3)] == ["processing"] * 3
    assert (rows["test.txt"]["reason"], rows["test.txt"]["lane"]) == ("pattern_mismatch_scan", "ignored")
    assert rows["test_1.xml"]["hash"] == hashlib.sha256(b"test_1.xml" + XML % (0, 0)).hexdigest()


@pytest.mark.parametrize("complete", [False, True])
def test_all_verdicts(spark, root, complete):
    body = XML % (1, 1)
    root("a/one.xml", body)
    root("b/one.xml", body)  # same name and bytes: one wins
    root("b/two.xml", body)  # same bytes under another name: its own file
    root("small.xml", b"x")
    root("big.xml", b"x" * 3000)
    root("old.tmp", body)
    root("pack/cargo.zip", make_zip([("crate.xml", body), ("hold/barrel.xml", body), ("note.txt", b"text" * 5)]))
    root("pack/slip.zip", make_zip([("ok.xml", body), ("../x.xml", body)]))
    root("pack/bad.zip", b"PK\x03\x04 not really an archive")
    root("x.xml:Zone.Identifier", b"[ZoneTransfer]")
    root(".hidden.xml", body)
    root("_under.xml", body)
    root("empty.xml", b"")
    done = spark.createDataFrame([(hashlib.sha256(b"two.xml" + body).hexdigest(),)], "hash string")
    got = reasons(admission.admit_landing(spark, config(root, max_bytes=2000), done, complete))
    errors = {g for g in got if (g[1] or "").startswith("zip_extraction_failed")}
    assert {(e[0], e[2]) for e in errors} == {("slip.zip", "failed"), ("bad.zip", "failed")}
    want = {
        ("one.xml", None, "processing"), ("one.xml", "lock_held", "incoming"), ("two.xml", "duplicate", "ignored"),
        ("small.xml", "file_too_small", "ignored"), ("big.xml", "file_too_large", "ignored"),
        ("old.tmp", "pattern_mismatch_scan", "ignored"), ("crate.xml", None, "processing"),
        ("barrel.xml", None, "processing"), ("note.txt", "pattern_mismatch_scan", "ignored"),
    }
    if complete:
        want |= {(".hidden.xml", "pattern_mismatch_scan", "ignored"), ("empty.xml", "file_too_small", "ignored"),
                 ("_under.xml", None, "processing")}
    assert got - errors == want


def test_vanished_files_stay_out(spark, root):
    root("here.xml", XML % (1, 1))
    listed = landing.scan(spark, [root.path]).drop("content")
    gone = listed.withColumn("path", F.lit(root.path + "/gone.xml"))
    gone_zip = listed.withColumn("path", F.lit(root.path + "/gone.zip"))
    got = reasons(admission.admit(listed.unionByName(gone).unionByName(gone_zip), config(root)))
    assert got == {("here.xml", None, "processing"), ("gone.xml", "hash_error", "incoming"),
                   ("gone.zip", "zip_extraction_failed: the archive can not be read", "failed")}


def test_archive_members(spark):
    nested = make_zip([("inner.xml", b"in"), ("dir/", b"")])
    rows = [
        ("/in/cargo.zip", make_zip([("manifest.csv", b"7;rope"), ("hold/list.csv", b"9;tar"), ("hold/", b"")])),
        ("/in/TWICE.ZIP", make_zip([("a.txt", b"first"), ("./a.txt", b"second")])),
        ("/in/nest.zip", make_zip([("n/inner.zip", nested), ("broken.zip", b"nope")])),
        ("/in/cut.zip", make_zip([("file.txt", os.urandom(500))])[:300]),
        ("/in/big.zip", make_zip([("big.bin", b"0" * 5000)])),
    ]
    df = spark.createDataFrame(rows, "path string, content binary")
    got = {(r["path"], bytes(r["content"]) if r["content"] is not None else None, r["error"] is None)
           for r in archives.expand(df, content_limit=1000).collect()}
    assert got == {
        ("/in/manifest.csv", b"7;rope", True), ("/in/hold/list.csv", b"9;tar", True), ("/in/a.txt", b"second", True),
        ("/in/n/inner.xml", b"in", True), ("/in/broken.zip", None, False), ("/in/cut.zip", None, False),
        ("/in/big.bin", None, True)}
    whole = archives.expand(df).filter("path = '/in/big.bin'").first()
    assert bytes(whole["content"]) == b"0" * 5000
    shallow = archives.expand(df, max_depth=1).filter("path LIKE '%inner%'").collect()
    assert [(r["path"], r["error"]) for r in shallow] == [
        ("/in/n/inner.zip", "zip_extraction_failed: archives nested too deeply")]


def test_inventory_and_scan(spark, root):
    root("x/y/z.xml", b"abc")
    root(".hidden", b"h")
    root("empty", b"")
    os.makedirs(os.path.join(root.path, "x", "nothing"))
    listed = {(os.path.relpath(r["path"], root.path), r["is_dir"], r["size"]) for r in
              inventory.scan(spark, [root.path]).collect()}
    assert listed == {("x", True, 0), ("x/y", True, 0), ("x/nothing", True, 0), ("x/y/z.xml", False, 3),
                      (".hidden", False, 1), ("empty", False, 0)}
    scanned = landing.scan(spark, [root.path])
    assert [os.path.relpath(r["path"], root.path) for r in scanned.collect()] == ["x/y/z.xml"]
    by_path = landing.hash_by_path(scanned.select("path")).collect()
    assert by_path[0]["hash"] == hashlib.sha256(b"z.xml" + b"abc").hexdigest()


def test_scan_pushes_down_and_prunes(spark, root, capsys):
    root("a.xml", b"abc")
    df = landing.scan(spark, [root.path]).filter(F.col("length") > 2).select("length")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(length,2)" in plan
    assert "content" not in plan.split("ReadSchema")[1]


def test_exposition(spark):
    lines = ["# HELP x_total some", "", "  ", "x_total 12", "x_total 1.5e+06", 'x_bucket{le="0.1"} 3', "Upper 3",
             "y_total +Inf", "junk"]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    assert [(r["name"], r["value"]) for r in exposition.parse(df).collect()] == [("x_total", 12.0), ("x_total", 1.5)]
    full = [(r["name"], r["labels"], r["value"]) for r in exposition.parse(df, full=True).collect()]
    assert full == [("x_total", "", 12.0), ("x_total", "", 1.5e6), ("x_bucket", '{le="0.1"}', 3.0), ("Upper", "", 3.0),
                    ("y_total", "", float("inf"))]
    both = [(r["grammar"], r["name"], r["labels"], r["value"]) for r in exposition.parse_both(df).collect()]
    assert [b[1:] for b in both if b[0] == "full"] == full
    assert [(b[1], b[3]) for b in both if b[0] == "strict"] == [("x_total", 12.0), ("x_total", 1.5)]


def test_messages_round_trip(spark):
    bodies = spark.createDataFrame([
        ('{"path":"/p/a.xml","hash":"h1","size":5,"timestamp":"2024-01-02T03:04:05Z","queue":"q","more":1}',),
        ('{"id":"h2","path":"/p/b.xml","filename":"b.xml","kind":"xml","size":7,"hash":"h2"}',),
        ('{"path": 5, "size": "x"}',), ("{broken",)], "value string")
    good, dead = messages.consume(bodies, lambda df: df.select("hash", "size", "queue"))
    assert sorted(tuple(r) for r in good.collect()) == [("h1", 5, "q"), ("h2", 7, None)]
    assert dead.count() == 2
    drift = {r["field"]: r["status"] for r in messages.schema_drift(bodies.limit(2), ["path", "queue", "gone"]).collect()}
    assert (drift["path"], drift["queue"], drift["gone"], drift["more"]) == (
        "expected", "expected", "missing", "unexpected")


def test_sinks(spark, tmp_path):
    files = spark.createDataFrame([("a.xml", "xml", 5, "h")], "filename string, kind string, length long, hash string")
    out = sink.work_messages(files.withColumn("timestamp", F.lit("2024-01-02 03:04:05").cast("timestamp")))
    row = out.first()
    assert row["key"] == "h"
    assert row["value"] == ('{"id":"h","path":"/landing/processing/a.xml","filename":"a.xml","kind":"xml","size":5,'
                            '"hash":"h","timestamp":"2024-01-02T03:04:05.000000Z"}')
    for s in (sink.NoopSink(), sink.FileSink(str(tmp_path / "p")), sink.FileSink(str(tmp_path / "j"), "json")):
        s.write(out)
    assert spark.read.parquet(str(tmp_path / "p")).count() == spark.read.json(str(tmp_path / "j")).count() == 1
    lanes = spark.createDataFrame([("a", "ignored", "x"), ("b", "failed", "y")], "path string, lane string, reason string")
    sink.write_lanes(lanes, str(tmp_path / "lanes"))
    assert sorted(os.listdir(tmp_path / "lanes"))[-2:] == ["lane=failed", "lane=ignored"]


def test_workers_get_long_rows_a_few_megabytes_at_a_time(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    prepare(spark)
    long = spark.range(0, 40, 1, 1).select(F.repeat(F.lit("x"), 1 << 20).alias("content"))
    sizes = [r["n"] for r in long.mapInPandas(
        lambda batches: (pd.DataFrame({"n": [int(b["content"].str.len().sum())]}) for b in batches), "n long").collect()]
    assert sum(sizes) == 40 << 20 and max(sizes) <= 10 << 20
