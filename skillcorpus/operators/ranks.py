"""Ranks and running sums within groups of any size, in two passes.

Rows are dealt to ranges of the order by cuts from a bounded sample. Counts and sums by group and range give each range its offset, and windows by group
and range the rest, so a group is sorted by as many tasks as its rows take ranges, not by one. The sample only decides which task sorts which rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Keys in the sample, about, and ranges that they are cut into.
SAMPLE, RANGES = 4096, 64


def ranked(rows: DataFrame, group: list[str], order: list[Column], add: Column | None = None, ranges: int = RANGES) -> DataFrame:
    """``rows`` with ``rank`` (from 1) by ``order`` within ``group`` and, where ``add`` is given, ``before``: its sum over the rows of the group that come earlier.

    All of ``order`` is ascending (a number that descends is given as its negative) and not null, and it should tell rows apart; rows that it does not have their ranks in any order. ``rows`` is read three times, so it should be a
    written table. Null groups are groups. Empty tables give no rows.
    """
    keyed = rows.withColumns({"__key": F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)]), "__add": F.lit(0) if add is None else add})
    n = rows.count()
    share = min(1.0, SAMPLE / max(n, 1))
    drawn = keyed.select("__key").filter(F.pmod(F.xxhash64("__key", F.lit(9)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).orderBy("__key").limit(4 * SAMPLE).select("__key")
    keys = drawn.collect()  # about SAMPLE
    cuts = [keys[len(keys) * i // ranges]["__key"] for i in range(1, ranges)] if len(keys) >= ranges else []
    kind = keyed.schema["__key"].dataType
    literal = F.array(*[F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(c, kind.fields, strict=True)]) for c in cuts]) if cuts else None
    placed = keyed.withColumn("__range", F.lit(0) if literal is None else F.size(F.filter(literal, lambda c: c <= F.col("__key"))))
    sizes = placed.groupBy(*group, "__range").agg(F.count(F.lit(1)).alias("__n"), F.sum("__add").alias("__sum"))
    earlier = Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as ranges
    offsets = sizes.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], F.col("__range").alias("__r"), F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__rows"), F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__total"))
    part = Window.partitionBy(*group, "__range").orderBy("__key")
    within = placed.withColumns({"__i": F.row_number().over(part), "__s": F.coalesce(F.sum("__add").over(part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    same = F.col("__range") == F.col("__r")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    out = within.join(offsets, same)
    extra = [] if add is None else [(F.col("__total") + F.col("__s")).alias("before")]
    return out.select(*rows.columns, (F.col("__rows") + F.col("__i")).cast("long").alias("rank"), *extra)
