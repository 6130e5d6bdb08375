"""Sharding by sampled splitters.

Size-weighted samples of the keys give quantile boundaries; rows are dealt to the ranges between them, ranges
that come out overfull are subdivided, and each range cuts its own rows into shards at exact quantiles of bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skillcorpus.plans.storage import cut, partitions


def _range_of(high: Column, low: Column, bounds: list[tuple[int, int]]) -> Column:
    """The number of bounds at or below the key, by binary search (a row's work is log2 of the number of bounds)."""
    if not bounds:
        return F.lit(0)
    cuts = F.array(*[F.struct(F.lit(a).cast("long").alias("high"), F.lit(b).cast("long").alias("low")) for a, b in bounds])
    key = F.struct(high.alias("high"), low.alias("low"))
    step = lambda s, _: F.when(
        s["lo"] < s["hi"],
        F.when(F.get(cuts, F.floor((s["lo"] + s["hi"]) / 2).cast("int")) <= key, F.struct((F.floor((s["lo"] + s["hi"]) / 2) + 1).cast("int").alias("lo"), s["hi"].alias("hi"))).otherwise(
            F.struct(s["lo"].alias("lo"), F.floor((s["lo"] + s["hi"]) / 2).cast("int").alias("hi"))
        ),
    ).otherwise(s)
    steps = F.array(*[F.lit(i) for i in range(len(bounds).bit_length() + 1)])
    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi")), step)["lo"]


def shard(docs: DataFrame, n_shards: int = 40, text: str = "text", doc_id: str = "doc_id", ranges: int | None = None, sample: int = 8000, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``, and the columns of ``docs`` that ``carry`` names.

    Rows are ordered by (64-bit hash of the text, doc_id), so that equal texts stand together and a large group
    of copies is still cut by doc_id. ``size`` is the text's UTF-8 bytes plus 16. Law ``bytes``: shard s holds the
    rows whose middle byte, counted over all rows in that order, lies in the s-th of ``n_shards`` equal parts, so
    shards differ from an equal share by less than one row at each end. ``slot`` counts from 0 within a shard.
    ``grown_shard`` is null, as the law is not ``key``.

    The sample has about ``sample`` keys at any input size (a bounded parameter); it only sets which task sorts
    which rows. Sampling probability is in proportion to size. Null texts have size 16 and hash and CRC null; rows
    with null ids come first among equal texts. Identical rows take their slots in any order. Texts of any length are sized
    whole; other columns are ignored unless carried, also where their names clash. Empty input gives no rows.
    """
    spark = docs.sparkSession
    parts = ranges or max(n_shards, 2 * partitions(spark))
    whole = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.col(text).cast("binary")).alias("text_crc32"),
        F.xxhash64(F.col(text)).alias("__high"),
        F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63))).alias("__low"),
        *[F.col(c).alias(f"__carry_{c}") for c in carry],
    )
    rows = cut(whole.select("doc_id", "size", "text_crc32", "__high", "__low"), "shard-keys")
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    # a row is in the sample with a probability in proportion to its size
    chance = F.pmod(F.xxhash64("__high", "__low", F.lit(17)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = rows.filter(chance * max(total, 1) < F.col("size") * sample).select("__high", "__low").distinct()
    keys = sorted((r[0], r[1]) for r in drawn.collect())
    bounds = sorted({keys[len(keys) * i // parts] for i in range(1, parts)}) if keys else []

    def placed(of: DataFrame) -> DataFrame:
        return of.withColumn("__range", _range_of(F.col("__high"), F.col("__low"), bounds))

    filled = {r[0]: r[1] for r in placed(rows).groupBy("__range").agg(F.sum("size")).collect()}
    over = {r for r, size in filled.items() if size > 2 * total / parts}
    if over:  # subdivide overfull ranges at every sampled key inside
        edges = [None, *bounds, None]
        inside = [k for k in keys if any((edges[r] is None or k > edges[r]) and (edges[r + 1] is None or k < edges[r + 1]) for r in over)]
        bounds = sorted({*bounds, *inside})

    sums = placed(rows).groupBy("__range").agg(F.sum("size").alias("__bytes"))  # one row per range: at most 4 * sample + ranges
    before = sums.withColumn("__before", F.sum("__bytes").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))).select("__range", F.coalesce("__before", F.lit(0)).alias("__before"))
    within = Window.partitionBy("__range").orderBy("__high", "__low", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, 0)
    # the shard of the middle byte, in whole numbers
    at = F.expr(f"cast((2 * __end - size) * {n_shards} div {2 * max(total, 1)} as int)")

    def cutting(of: DataFrame) -> DataFrame:
        running = placed(of).join(F.broadcast(before), "__range").withColumns({"__end": F.col("__before") + F.sum("size").over(within), "__row": F.count(F.lit(1)).over(within)})
        return running.withColumn("shard", F.least(F.lit(n_shards - 1), at))

    known = cut(cutting(rows), "shard-cuts")
    # a range's rows of one shard follow each other; as many of these counts as ranges and shards
    counts = known.groupBy("shard", "__range").agg(F.count(F.lit(1)).alias("__n"), F.min("__row").alias("__least"))
    earlier = F.coalesce(F.sum("__n").over(Window.partitionBy("shard").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = counts.select("shard", "__range", (earlier - F.col("__least")).alias("__first"))
    # carried columns take the same places in a pass of their own: they are moved once and written nowhere
    return (cutting(whole) if carry else known).join(F.broadcast(first), ["shard", "__range"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("__first") + F.col("__row")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        *[F.col(f"__carry_{c}").alias(c) for c in carry],
    )
