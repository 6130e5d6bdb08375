"""Jobs whose outcome depends on an order, without rounds that grow with chains."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skillcorpus.operators.components import components
from skillcorpus.plans.storage import cut

#: Rows that one task folds in order; rounds between two looks at components where one is larger.
FOLD, ROUNDS = 1 << 17, 8


def settle(rows: DataFrame, ends: tuple[Column, Column], turn: Callable[[DataFrame], tuple[DataFrame, DataFrame]], fold: Callable[[pd.DataFrame], pd.DataFrame], schema: str, limit: int | None = None) -> DataFrame:
    """What an ordered pass over ``rows`` decides, as rows of ``schema``.

    Each row is an edge between two nodes (``ends``: long, not null), and rows act on each other only through nodes they share. So
    components are independent: one of up to ``limit`` rows is folded in order in one pass of one task (``fold``, which takes any number of whole components at once), many
    small ones together. A component beyond that takes ``turn`` first, which decides in one round all rows whose turn has come and gives
    what it decided (``schema``) and what is left (columns of ``rows``), until its pieces are small enough. The number of jobs grows with the logarithm of
    the longest chain, and not at all where all rows fit in one task.
    """
    limit = limit or FOLD
    left, done = cut(rows, "open"), []
    while (n := left.count()) > 0:
        if n <= limit:
            done.append(left.withColumn("__group", F.lit(0)).groupBy("__group").applyInPandas(lambda pdf: fold(pdf.drop(columns="__group")), schema))
            break
        for _ in range(ROUNDS if done else 1):
            decided, left = (cut(x, name) for x, name in zip(turn(left), ("decided", "open"), strict=True))
            done.append(decided)
        nodes = components(left.select(ends[0].alias("a"), ends[1].alias("b")))
        named = cut(left.withColumn("__a", ends[0]).join(nodes.toDF("__a", "__comp"), "__a").drop("__a"), "named")
        sizes = cut(named.groupBy("__comp").agg(F.count(F.lit(1)).alias("__n")), "component-sizes")
        sized = named.join(sizes, "__comp")
        width = max(1, math.ceil(n / limit * 4))
        group = F.pmod(F.xxhash64("__comp"), F.lit(width))
        small = cut(sized.filter(F.col("__n") <= limit).withColumn("__group", group).drop("__comp", "__n"), "small")
        done.append(small.groupBy("__group").applyInPandas(lambda pdf: fold(pdf.drop(columns="__group")), schema))
        left = cut(sized.filter(F.col("__n") > limit).select(*rows.columns), "open")
    return reduce(DataFrame.unionByName, done, rows.sparkSession.createDataFrame([], schema)) if done else rows.sparkSession.createDataFrame([], schema)
