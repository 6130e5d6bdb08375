"""Connected components of an edge table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skillcorpus.plans.storage import cut, discard


def components(edges: DataFrame) -> DataFrame:
    """``node, comp`` for all nodes of ``edges`` (``a, b``: long, not null); ``comp`` is the least node of the component.

    Each round maps every node to its least neighbour or itself, whichever is less, and renames both ends of the
    edges; what still joins two names goes on. Where the ids are hashes an edge set
    shrinks by a constant factor a round. A node of very many edges costs one row a task, as minima are
    combined before the shuffle; nothing is gathered on the driver.
    """
    pairs = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = cut(pairs, "edges")
    names = None
    while not pairs.isEmpty():
        both = pairs.select(F.col("a").alias("node"), F.col("b").alias("other")).union(pairs.select("b", "a"))
        to = cut(both.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("to")), "renamed")
        if names is None:
            names = to.withColumnRenamed("to", "comp")
        else:
            step = to.withColumnRenamed("node", "comp")
            known, names = names, cut(names.join(step, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")), "components")
            discard(known)
        a, b = to.toDF("a", "ta"), to.toDF("b", "tb")
        renamed = pairs.join(a, "a").join(b, "b").filter("ta <> tb")
        done, pairs = pairs, cut(renamed.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "edges")
        discard(done)
    if names is None:
        return pairs.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    return names
