"""Line dedup by site-relative frequency.

Lines that occur on a large share of a host's pages are boilerplate of that host and go; the rest of every text stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skillcorpus.plans.storage import cut


def _key(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def boilerplate_lines(pages: DataFrame, host: str, text: str, max_ratio: float, min_pages: int) -> DataFrame:
    """One row per host that has boilerplate: ``host, lines`` (sorted 64-bit keys of its boilerplate lines).

    A line's ratio is the number of the host's pages that hold it (once per page) over all pages of the host.
    The count is combined before the shuffle, so that a line on a third of all rows costs each task one row.
    As each listed line is on more than ``max_ratio`` of a host's pages, a host's list is at most
    (average lines of a page) / ``max_ratio`` long, whatever the size of the host.
    """
    rows = pages.select(F.coalesce(F.col(host), F.lit("")).alias("host"), F.col(text).alias("text"))
    totals = rows.groupBy("host").agg(F.count(F.lit(1)).alias("n_pages"))
    keys = F.array_distinct(F.transform(F.filter(F.split("text", "\n", -1), lambda x: F.trim(x) != ""), _key))
    counts = rows.select("host", F.explode(keys).alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_pages)
    return counts.join(totals, "host").filter(F.col("n") > max_ratio * F.col("n_pages")).groupBy("host").agg(F.sort_array(F.collect_list("line")).alias("lines"))


def dedup_lines(pages: DataFrame, host: str = "source", text: str = "text", max_ratio: float = 0.1, min_pages: int = 5) -> DataFrame:
    """All rows and columns of ``pages``; ``text`` without boilerplate lines, and ``n_lines``, ``n_dropped`` (long).

    Lines are cut at ``\\n`` and compared without outer spaces, by a 64-bit hash within one host. A line goes
    everywhere in a page if more than ``max_ratio`` of its host's pages, and ``min_pages`` pages at least, hold it.
    A null host is the host of empty name. Blank lines are never counted or dropped. Null texts stay null with 0
    lines; an empty text is one blank line. Repeated rows count as pages of their own. Columns named ``n_lines`` or
    ``n_dropped`` are replaced.
    """
    # written, so that its size is known and a small one is not joined by moving all texts
    bad = cut(boilerplate_lines(pages, host, text, max_ratio, min_pages), "boilerplate").withColumnRenamed("host", "__host").withColumnRenamed("lines", "__lines")
    lines = F.split(F.col(text), "\n", -1)
    kept = F.when(F.col("__lines").isNull(), lines).otherwise(F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains("__lines", _key(x))))
    joined = pages.join(bad, F.coalesce(F.col(host), F.lit("")) == F.col("__host"), "left").withColumn("__kept", kept)
    counted = joined.withColumns({"n_lines": F.coalesce(F.size(F.when(F.col(text).isNotNull(), lines)), F.lit(0)).cast("long"), text: F.array_join("__kept", "\n")})
    counted = counted.withColumn("n_lines", F.greatest("n_lines", F.lit(0)))
    return counted.withColumn("n_dropped", F.when(F.col("__kept").isNull(), 0).otherwise(F.col("n_lines") - F.size("__kept")).cast("long")).drop("__host", "__lines", "__kept")
