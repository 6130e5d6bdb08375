"""The bitmap of keys lets through all that has a key, and nearly nothing else."""

from __future__ import annotations

from pyspark.sql import functions as F

from skillcorpus.llm import key_filter


def test_no_key_is_missed(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 50 > 0, F.col("id")).alias("a"), (F.col("id") * 7).alias("b"), F.lit(1).alias("bit"))
    keys = rows.filter("b % 13 = 0").select("a", "b")
    out = key_filter.marked(rows, keys, ["a", "b"])
    wrong = out.filter("b % 13 = 0 and not suspect").count()
    assert wrong == 0 and out.filter("suspect").count() <= keys.count() + 40 and out.count() == 20_000 and out.columns == ["a", "b", "bit", "suspect"]
    assert key_filter.marked(rows, keys.filter("false"), ["a", "b"]).filter("suspect").count() == 0
