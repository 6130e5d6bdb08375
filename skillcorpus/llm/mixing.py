"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skillcorpus.plans.storage import cut, partitions

#: Largest mean of one Poisson draw (a higher rate takes several), and copies that one array lists.
DRAW, COPIES = 16.0, 4096


def source_rates(docs: DataFrame, source: str, text: str, weights: dict[str, float] | None, epochs: float) -> DataFrame:
    """``__source, __rate``: mean copies per document that bring each source's bytes to its share of the target.

    Shares follow ``weights`` (sources not named weigh 1; no weights: all sources equal) over the sources that
    have rows; the mix as a whole has ``epochs`` times the input's bytes.
    """
    sizes = docs.groupBy(F.coalesce(F.col(source), F.lit("")).alias("__source")).agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + 1).alias("bytes"))
    weight = F.lit(1.0)
    for name, w in (weights or {}).items():
        weight = F.when(F.col("__source") == name, float(w)).otherwise(weight)
    sizes = cut(sizes.withColumn("weight", weight), "source-sizes")
    all_bytes, all_weight = sizes.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(1.0))).first()
    rate = epochs * F.col("weight") * F.lit(all_bytes) / (F.lit(all_weight) * F.col("bytes"))
    return sizes.select("__source", rate.alias("__rate"))


def identity(doc_id: Column, text: Column) -> Column:
    """What a row's draws are hashed from: its id, or its text where it has none."""
    return F.coalesce(doc_id.cast("string"), F.concat(F.lit("text "), F.md5(text)), F.lit(""))


def uniform(ident: Column, seed: int, draw: Column | None = None) -> Column:
    """A number in [0, 1) with 48 random bits, from the MD5 of seed, id and, after the first, the draw's number."""
    start = F.lit(str(seed)) if draw is None else F.concat_ws("/", F.lit(str(seed)), draw.cast("string"))
    return F.conv(F.substring(F.md5(F.concat_ws(":", start, ident)), 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))


def poisson_count(u: Column, rate: Column) -> Column:
    """The inverse Poisson distribution: the least k whose cumulative probability exceeds ``u``.

    Rates are ``DRAW`` at most; the sum runs over so many terms that there the rest is below the step of ``u``; it ends early where
    the cumulative probability has passed ``u``.
    """
    terms = int(DRAW + 10 * DRAW**0.5 + 20)
    begin = F.struct(F.lit(0).alias("k"), F.exp(-rate).alias("p"), F.exp(-rate).alias("c"))
    step = lambda s, i: F.when(s["c"] > u, s).otherwise(F.struct(i.alias("k"), (s["p"] * rate / i).alias("p"), (s["c"] + s["p"] * rate / i).alias("c")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(terms)), begin, step)["k"]


def copies_of(ident: Column, rate: Column, seed: int) -> Column:
    """How often a row is repeated: a Poisson count of any rate, as the sum of equal draws with a mean of ``DRAW`` or less."""
    draws = F.greatest(F.lit(1), F.ceil(rate / DRAW)).cast("int")
    more = F.aggregate(F.sequence(F.lit(1), draws - 1), F.lit(0).cast("long"), lambda s, i: s + poisson_count(uniform(ident, seed, i), rate / draws))
    return poisson_count(uniform(ident, seed), rate / draws).cast("long") + F.when(draws > 1, more).otherwise(F.lit(0).cast("long"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0, seed: int = 7, source: str = "source", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """All columns of ``docs``, each row as often as its Poisson count says, plus ``copy`` (int, from 0) and ``mix_key`` (long).

    A row's count inverts the Poisson distribution whose mean is its source's rate, however high, at points hashed from seed
    and ``doc_id`` (a row without an id: from its text): the same id gets the same count on any cluster, and repeated rows get
    equal counts. Rows come out in global random order: dealt to partitions by a hash of ``mix_key`` and sorted by it within
    each; rows of one id and text have keys of their own by ``copy`` alone. A null source is the source of empty name; null
    texts count one byte and are kept like others, as are empty and very long ones. Columns named ``copy`` or ``mix_key`` are replaced. Empty input gives no rows.
    """
    # written, so that its size is known and a small one is not joined by moving all texts
    rates = cut(source_rates(docs, source, text, weights, epochs), "rates")
    held = [c for c in docs.columns if c not in ("copy", "mix_key")]
    counted = docs.select(*held).join(rates, F.coalesce(F.col(source), F.lit("")) == F.col("__source"))
    counted = counted.withColumn("__n", copies_of(identity(F.col(doc_id), F.col(text)), F.col("__rate"), seed)).filter(F.col("__n") > 0)
    parts = counted.select(*held, "__n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1, F.lit(COPIES).cast("long"))).alias("__from"))
    copies = parts.select(*held, F.explode(F.sequence(F.col("__from"), F.least(F.col("__from") + COPIES, F.col("__n")) - 1).cast("array<int>")).alias("copy"))
    keyed = copies.withColumn("mix_key", F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text), F.col("copy")))
    return keyed.repartition(partitions(docs.sparkSession), "mix_key").sortWithinPartitions("mix_key")
