"""Sources far under their share of the bytes."""

from __future__ import annotations

from pyspark.sql import functions as F

from skillcorpus.llm import mixing


def test_a_rare_source_reaches_its_weight(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2000 == 0, "rare").otherwise("large").alias("source"), F.lit("text of one size").alias("text"))
    out = mixing.mix(docs)
    n = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(n["rare"] - 10_000) < 500 and abs(n["large"] - 10_000) < 500
    assert out.select("doc_id", "copy").distinct().count() == sum(n.values()) and out.filter("source = 'rare'").select("doc_id").distinct().count() == 10


def test_a_count_beyond_one_array(spark):
    row = spark.range(1).select(F.lit(5).alias("doc_id"), F.lit("s").alias("source"), F.lit("t").alias("text"))
    copies = sorted(r["copy"] for r in mixing.mix(row, epochs=10_000.0).select("copy").collect())
    assert copies == list(range(len(copies))) and abs(len(copies) - 10_000) < 600
