"""The corpus pipeline: documents in, packed training sequences out.

Every stage takes (spark, docs, sf_dir), works on all rows it is given and returns the columns of ``documents``; the
last returns pieces of sequences. Decisions come back to the rows by doc_id and the SHA-256 of the text, null ids
included, so only rows that repeat both share one. Extra columns stay until the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.llm import exact_dedup, jaccard_join, packing, suffix_dedup, toxicity
from quayside.llm.common import prepare, table
from quayside.session import written

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def same_text() -> Column:
    """A row ``d`` and a result ``k`` with its doc_id (null matches null) and its text; a null text counts as empty."""
    return F.expr("d.doc_id <=> k._id AND sha2(coalesce(cast(d.text AS binary), cast('' AS binary)), 256) = k._sha")


def unused(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have; names differ in more than case."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def only(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id and text are among ``kept``."""
    kept = kept.select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")).distinct()
    return docs.alias("d").join(kept.alias("k"), same_text(), "left_semi")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that more likely than not are of a toxic grade go."""
    prepare(spark)
    grade = F.col("toxic") * (2 - F.col("quality"))
    model = toxicity.fit_on(docs, table(spark, sf_dir, "labels"), grade)
    found = unused(docs, "severity")
    return docs.withColumn(found, toxicity.severity(model, F.col("text"))).filter(F.col(found)["p_toxic"] < 0.5).drop(found)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the largest doc_id stays."""
    prepare(spark)
    return only(docs, exact_dedup.exact_dedup(docs, hash_all=True).filter("kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by 80 % of its five-word shingles the document with the smallest doc_id stays."""
    prepare(spark)
    groups = jaccard_join.groups(docs, words=5, num=80, den=100, with_hash=True)
    return only(docs, groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes that a document with a smaller doc_id has too are cut out of the texts. A character that is
    cut in part goes as a whole. Documents stay, also those with nothing left; n_chars is counted anew."""
    prepare(spark)
    spans = unused(docs, "spans")
    cut = suffix_dedup.repeats(docs, 50, with_hash=True).filter("n_removed > 0").select(
        F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"), F.col("spans").alias(spans))
    cut = cut.dropDuplicates(["_id", "_sha"])  # equal texts of one id have equal spans
    rows = docs.alias("d").join(cut.alias("k"), same_text(), "left").select("d.*", F.col(f"k.{spans}"))
    made = rows.withColumn("text", F.when(F.col(spans).isNull(), F.col("text")).otherwise(without("text", spans)))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        made = made.withColumn("n_chars", F.when(F.col(spans).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return made.select(*[F.col(f"`{c}`") for c in docs.columns])


def without(text: str, spans: str):
    """The text without its spans of bytes."""
    @F.pandas_udf("string")
    def cut(texts, spans):
        import pandas as pd

        out = []
        for t, some in zip(texts, spans):
            if t is None or some is None:
                out.append(t)
                continue
            data, kept, last = t.encode(), [], 0
            for s in some:
                kept.append(data[last:s["start"]])
                last = s["end"]
            out.append(b"".join([p.decode(errors="ignore").encode() for p in [*kept, data[last:]]]).decode())
        return pd.Series(out, dtype=object)

    return cut(text, spans)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token sequences of what is left."""
    prepare(spark)
    return packing.pack(docs, TOKENIZER, with_tokens=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("packing", pack),
]
ORACLE_SQL = None  # SQL expresses neither the fitted model nor the tokenizer


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
