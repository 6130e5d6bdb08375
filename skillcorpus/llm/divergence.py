"""Divergence of sources within a language by hash-consed segment trees.

The kept terms of a language are dealt to blocks. In a block every source, and the language as a whole, has a segment tree
over its term ids, whose leaves are counts. Equal count subtrees of any trees and places are one node, so a traversal of two
trees at once meets each pair of nodes once, with the number of places where it stands, and prices it once. What blocks give
is added up: a block's root is a child of the language's root, which Spark's aggregation stands for.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skillcorpus.llm import terms
from skillcorpus.plans.storage import cut

#: Terms that a counting task holds before it hands them on; leaves of all trees of a block.
HELD, LEAVES = 400_000, 1 << 20
_BY = terms.table(digits=False)
_OUT = "lang string, source string, part string, item string, value long"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``lang, source, term, n, docs`` of documents ``lang, source, text``: occurrences and documents, added up as far as a task holds them."""
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def handed_on() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in groups.items():
            if n:
                keys = list(n)
                term = pa.array(keys, pa.binary()).cast(pa.string())
                same = [pa.repeat(pa.scalar(x, pa.string()), len(keys)) for x in (lang, source)]
                yield pa.RecordBatch.from_arrays([*same, term, pa.array(n.values(), pa.int64()), pa.array([docs[k] for k in keys], pa.int64())], names=["lang", "source", "term", "n", "docs"])
        groups.clear()

    for batch in batches:
        for lang, source, text in zip(*(batch.column(i) for i in range(3)), strict=True):
            n, docs = groups.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
            seen: set[bytes] = set()
            for ws in terms.words(text.as_py(), _BY):
                n.update(ws)
                seen.update(ws)
            docs.update(seen)
        if sum(len(n) for n, _ in groups.values()) > HELD:
            yield from handed_on()
    yield from handed_on()


class Forest:
    """Hash-consed segment trees of equally many leaves.

    ``roots[t]`` is the root of tree t. Nodes are numbered by level: ``left`` and ``right`` give the children of those of a level, the
    last level being the leaves, whose number is the place of their value in ``values``.
    """

    def __init__(self, leaves: np.ndarray) -> None:
        """leaves: a row for each tree, their number a power of two."""
        self.values, nodes = np.unique(leaves, return_inverse=True)
        nodes = nodes.reshape(leaves.shape)
        self.left: list[np.ndarray] = []
        self.right: list[np.ndarray] = []
        while nodes.shape[1] > 1:
            size = int(nodes.max()) + 1
            pairs, nodes = np.unique(nodes[:, ::2] * size + nodes[:, 1::2], return_inverse=True)
            nodes = nodes.reshape(len(leaves), -1)
            self.left.insert(0, pairs // size)
            self.right.insert(0, pairs % size)
        self.roots = nodes[:, 0]

    def pairs(self, one: int, others: np.ndarray) -> tuple[np.ndarray, ...]:
        """Traverses tree ``one`` with each of ``others`` at once: distinct pairs of leaves, and at how many places each stands.

        Arrays: which of the others, the leaf of ``one``, that of the other, places. A pair of nodes that was met before at its level is not entered again.
        """
        which, a, b = np.arange(len(others)), np.full(len(others), self.roots[one]), self.roots[others]
        places = np.ones(len(others), np.int64)
        for left, right in zip(self.left, self.right, strict=True):
            which, places = np.r_[which, which], np.r_[places, places]
            a, b = np.r_[left[a], right[a]], np.r_[left[b], right[b]]
            na, nb = int(a.max()) + 1, int(b.max()) + 1
            met, back = np.unique((which * na + a) * nb + b, return_inverse=True)
            total = np.zeros(len(met), np.int64)
            np.add.at(total, back, places)
            which, a, b, places = met // (na * nb), met // nb % na, met % nb, total
        return which, a, b, places

    def places(self, one: int, other: int, empty: int) -> tuple[np.ndarray, ...]:
        """Traverses two trees at once, but not where all leaves of ``one`` have the value ``empty``: places, leaves of ``one``, leaves of ``other``."""
        at, a, b = np.zeros(1, np.int64), self.roots[[one]], self.roots[[other]]
        bare = [np.searchsorted(self.values, empty) if empty in self.values else -1]  # at each level the node of nothing but such leaves
        for left, right in zip(self.left[::-1], self.right[::-1], strict=True):
            found = np.flatnonzero((left == bare[0]) & (right == bare[0]))
            bare.insert(0, int(found[0]) if len(found) else -1)
        for level, (left, right) in enumerate(zip(self.left, self.right, strict=True), 1):
            at = np.r_[2 * at, 2 * at + 1]
            a, b = np.r_[left[a], right[a]], np.r_[left[b], right[b]]
            keep = a != bare[level]
            at, a, b = at[keep], a[keep], b[keep]
        keep = a != bare[-1]
        return at[keep], a[keep], b[keep]


def probabilities(values: np.ndarray, n: int, v: int) -> np.ndarray:
    """In billionths, each 1 at least: of counts in a group of ``n`` occurrences and ``v`` terms."""
    if not len(values) or int(values[-1]) < 9_000_000_000:
        return 1 + 1_000_000_000 * (values + 1) // (n + v)
    return np.array([1 + 1_000_000_000 * (int(x) + 1) // (n + v) for x in values], np.int64)


def _priced(top: int):
    """Rows of ``_OUT``: of a block's terms all pairs of sources, and each source's ``top`` dearest terms."""

    def of(key: tuple, block: pa.Table, groups: pa.Table) -> pa.Table:
        lang = key[0].as_py()
        rows: list[list] = [[], [], [], []]
        if block.num_rows:
            sources, sizes = groups.column("source").to_pylist(), [*groups.column("n").to_pylist(), groups.column("lang_n")[0].as_py()]
            v, s = groups.column("v")[0].as_py(), groups.num_rows
            index = {x: i for i, x in enumerate(sources)}
            block = block.combine_chunks()
            total = block.column("total").to_numpy()
            lists = block.column("sources").combine_chunks()
            at = np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(len(total)), at)
            source = np.array([index[x] for x in lists.flatten().to_pylist()], np.int64)
            counts = np.zeros((s + 1, len(total)), np.int64)
            counts[source, row] = block.column("counts").combine_chunks().flatten().to_numpy()
            counts[s] = total
            order = np.lexsort((*counts[:s], total))  # like counts stand together, so that subtrees are equal
            leaves = np.full((s + 1, 1 << max(0, int(len(total) - 1).bit_length())), -1, np.int64)  # -1: no term
            leaves[:, : len(total)] = counts[:, order]
            forest = Forest(leaves)
            p = np.array([probabilities(np.maximum(forest.values, 0), n, v) for n in sizes])
            none = int(forest.values[0] == -1)
            for g in range(s):
                others = np.arange(g + 1, s)
                if len(others):
                    which, a, b, places = forest.pairs(g, others)
                    term = (a >= none) & (b >= none)
                    which, a, b, places = (x[term] for x in (which, a, b, places))
                    pa_, pb = p[g, a], p[others[which], b]
                    square = (pa_ - pb) ** 2
                    for price, turn in ((square // pb, False), (square // pa_, True)):
                        value = np.zeros(len(others), np.int64)
                        np.add.at(value, which, price * places)
                        mine, theirs = [sources[g]] * len(others), [sources[h] for h in others]
                        rows[0] += theirs if turn else mine
                        rows[2] += mine if turn else theirs
                        rows[1] += ["pair"] * len(others)
                        rows[3] += value.tolist()
                place, a, b = forest.places(g, s, 0)
                term = a >= none
                place, a, b = place[term], a[term], b[term]
                met, back = np.unique(a * len(forest.values) + b, return_inverse=True)
                pg, pl = p[g, met // len(forest.values)], p[s, met % len(forest.values)]
                price = np.where(pg > pl, (pg - pl) ** 2 // pl, -1)[back]
                dear = price >= (np.partition(price, -top)[-top] if len(price) > top else 0)
                dear &= price >= 0
                named = block.column("term").take(pa.array(order[place[dear]])).to_pylist()
                best = sorted(zip((-price[dear]).tolist(), (x.encode() for x in named), named, strict=True))[:top]
                rows[0] += [sources[g]] * len(best)
                rows[1] += ["term"] * len(best)
                rows[2] += [x[2] for x in best]
                rows[3] += [-x[0] for x in best]
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64())
        out = [pa.array(x, kind) for x, kind in zip(rows, kinds, strict=True)]
        return pa.Table.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), len(rows[0])), *out], names=["lang", "source", "part", "item", "value"])

    return of


def divergence(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least_docs: int = 3, top: int = 200, leaves: int = LEAVES) -> DataFrame:
    """``lang, source, part, item, value, rank``: how far each source of a language is from the others, and by which terms from the language.

    Terms are runs of letters and characters outside ASCII, A-Z lower-cased, of whole texts; a language keeps those in ``least_docs`` of its documents.
    With V kept terms, and N the sum of their counts in a group, a count stands for p = 1 + floor(10^9 (count + 1) / (N + V)), and a term costs
    floor((p - q)^2 / q). Part ``pair``: the sum over all kept terms, q of another source. Part ``term``: terms that the source has more often than
    the language (q), the ``top`` dearest. Ranks go by value, then by the item's bytes. All arithmetic is in integers.

    Null languages, sources and texts are empty ones; a source without terms is a group, and so is one of a language without kept terms (value 0). Repeated
    rows count each; very long texts are read in pieces. An empty table gives no rows. Extra columns are ignored. Texts are counted in tasks before
    anything is shuffled. A block has about ``leaves`` leaves in all trees of the language with most sources, so blocks grow in number, not in size.
    """
    slim = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"))], F.col(text).cast("string").cast("binary").alias("text"))
    counted = slim.mapInArrow(_counted, "lang string, source string, term string, n long, docs long").repartition("lang", "term")
    by_source = counted.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by_term = by_source.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("found"))
    kept = cut(by_term.filter(F.col("docs") >= least_docs).select("lang", "term", "total", F.col("found.source").alias("sources"), F.col("found.n").alias("counts")), "kept-terms")

    of_lang = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("lang_n"))
    of_source = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("n"))
    groups = slim.select("lang", "source").distinct().join(of_source, ["lang", "source"], "left").join(of_lang, "lang", "left").na.fill(0, ["n", "v", "lang_n"])
    groups = cut(groups, "groups")
    widest, most = (x or 0 for x in groups.groupBy("lang").agg(F.count(F.lit(1)).alias("s"), F.max("v").alias("v")).agg(F.max("s"), F.max("v")).first())
    blocks = max(1, math.ceil(most / max(256, leaves // (widest + 1))))

    deal = kept.withColumn("block", F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int")).groupBy("lang", "block")
    needed = groups.filter("v > 0").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).groupBy("lang", "block")
    priced = cut(deal.cogroup(needed).applyInArrow(_priced(top), _OUT), "priced")
    found = priced.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    bare = groups.filter("v = 0").select("lang", "source")
    zero = bare.join(bare.select("lang", F.col("source").alias("item")), "lang").filter("source <> item").select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), F.asc("item"))
    return found.unionByName(zero).withColumn("rank", F.row_number().over(order)).filter((F.col("part") == "pair") | (F.col("rank") <= top))
