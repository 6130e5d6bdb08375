"""Translation by a dictionary of shapes: numbers and grades of a text are slots, so texts that differ in these meet one entry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skillcorpus.functions import chinese as Z


def shape(text: Column) -> Column:
    """A text with its slots blanked: what it is looked up by."""
    return F.regexp_replace(text, Z.SLOT, "#")


def dictionary(spark: SparkSession) -> DataFrame:
    """``en, zh``: the library's own entries; in ``zh`` the slots are numbered as in ``en``."""
    entries = Z.TITLES | Z.EDITS | Z.VERDICTS | {Z.CAPABILITY[0] + k: Z.CAPABILITY[1] + v for k, v in Z.CAPABILITIES.items()}
    return spark.createDataFrame(list(entries.items()), "en string, zh string")


def localized(rows: DataFrame, text: str, entries: DataFrame, slots: int = 3) -> DataFrame:
    """``rows`` with ``zh``: the translation of ``text``, or the text itself where ``entries`` (``en, zh``; one per shape) has none.

    The suffix of findings in warnings is translated by itself; a script's capability without an entry keeps its name after the translated prefix. Up to ``slots`` numbers or grades of the text are put back where the entry numbers them. Entries whose own wording has
    digits or lone letters of grades (as "500") are met whole, before shapes. Null texts stay null. The dictionary is a small table: Spark broadcasts it if it is.
    """
    base = F.col("__base")
    warned = F.endswith(text, F.lit(Z.WARNED[0]))
    rows = rows.withColumn("__base", F.when(warned, F.left(text, F.length(text) - len(Z.WARNED[0]))).otherwise(F.col(text)))
    whole = entries.filter(~F.contains("en", F.lit("#1"))).select(F.col("en").alias("__en"), F.col("zh").alias("__zh"))
    shaped = entries.filter(F.contains("en", F.lit("#1"))).select(F.regexp_replace("en", r"#\d", "#").alias("__shape"), F.col("zh").alias("__pattern"))
    rows = rows.join(whole, base == F.col("__en"), "left").withColumn("__key", shape(base)).join(shaped, F.col("__key") == F.col("__shape"), "left")
    found = F.regexp_extract_all(base, F.lit(f"({Z.SLOT})"), F.lit(1))
    filled = F.col("__pattern")
    for i in range(1, slots + 1):
        filled = F.replace(filled, F.lit(f"#{i}"), F.coalesce(F.get(found, F.lit(i - 1)), F.lit("")))
    bare = F.when(F.startswith(base, F.lit(Z.CAPABILITY[0])), F.concat(F.lit(Z.CAPABILITY[1]), F.substring(base, F.lit(len(Z.CAPABILITY[0]) + 1), F.length(base))))
    zh = F.coalesce(F.col("__zh"), filled, bare, base)
    held = [c for c in rows.columns if not c.startswith("__")]
    return rows.select(*held, F.concat(zh, F.when(warned, Z.WARNED[1]).otherwise("")).alias("zh"))
