"""How many labelled texts take part in the fit."""

from pyspark.sql import functions as F

from quayside.llm import toxicity


def test_eight_thousand_labels_are_used(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, grades: seen.append(len(texts)))
    docs = spark.range(8200).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"))
    labels = spark.range(8200).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("grade"))
    toxicity.fit_on(docs, labels, F.col("grade"))
    assert seen == [8000]
