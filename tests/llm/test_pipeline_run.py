"""The whole pipeline on small tables: nulls, clashing names, an empty table, and what each stage leaves."""

import random

import corpus_pipeline
import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, severity string, spans int, _id int, _sha string"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Toxic and clean texts with labels, exact and near copies, a shared passage, null ids and texts."""
    rng = random.Random(2)
    words = ["".join(rng.choice("aeioubcdfg") for _ in range(rng.randint(3, 7))) for _ in range(400)]
    bad = ["zzhate", "zzvile", "zzscum", "zzrage"]
    plain = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, " ".join(rng.choice(bad) if rng.random() < 0.4 else rng.choice(words) for _ in range(40)) if i % 4 == 0 else plain(40))
            for i in range(200)]
    labels = [(i, int(i % 3 > 0), int(i % 4 == 0)) for i in range(0, 160)]
    base, passage = plain(60), plain(20)
    rows += [(300, base), (301, base), (302, base + " end"), (303, plain(30) + " " + passage), (304, plain(30) + " " + passage),
             (305, None), (None, plain(25)), (None, None), (306, "")]
    root = tmp_path_factory.mktemp("tables")
    docs = [(d, t, "en", "s", len(t) if t else 0, "mild", 3, 4, "x") for d, t in rows]
    spark.createDataFrame(docs, COLUMNS).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return str(root), rows


def test_every_stage_keeps_columns_and_clean_rows(spark, tables):
    root, rows = tables
    docs = spark.read.parquet(f"{root}/documents.parquet")
    columns, left = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, root), "stage")
        assert docs.columns == columns, name
        assert docs.filter("severity = 'mild' AND spans = 3 AND _id = 4 AND _sha = 'x'").count() == docs.count(), name
        left.append({(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()})
    toxic, exact, near, cut = left
    assert not any(d is not None and d < 200 and d % 4 == 0 for d, _ in toxic) and len([d for d, _ in toxic if d is not None and d < 200]) == 150
    assert {d for d, _ in toxic} - {d for d, _ in exact} == {300, 305} and {(None, None)} & toxic  # 301 and 306 stay for their texts
    assert {d for d, _ in exact} - {d for d, _ in near} == {302}
    assert {d for d, _ in cut} == {d for d, _ in near}
    short = {d for d, t in cut if (d, t) not in near}
    assert short == {304}


def test_run_packs_all_that_is_left(spark, tables):
    pieces = corpus_pipeline.run(spark, tables[0]).collect()
    ends = {}
    for r in sorted(pieces, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["start"])):
        if r["doc_id"] is not None:
            assert r["start"] == ends.get(r["doc_id"], 0)
            ends[r["doc_id"]] = r["start"] + r["length"]
    assert all(ends[r["doc_id"]] == r["doc_tokens"] for r in pieces if r["doc_id"] is not None)
    assert {300, 302, 305} & set(ends) == set() and {301, 303, 304, 306} <= set(ends)


def test_empty_table(spark, tables, tmp_path):
    spark.read.parquet(f"{tables[0]}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{tables[0]}/labels.parquet").limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
