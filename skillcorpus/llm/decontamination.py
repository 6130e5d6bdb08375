"""Benchmark decontamination by greedy string tiling.

Seeds, hashed runs of tokens, of documents and benchmark items are joined; for each pair of document and item that shares
one, the longest matches that do not overlap are found by rolling hashes (Karp-Rabin) and marked again and again, and the
marked share of the item's tokens is its coverage. As tiles may lie in any order, passages whose parts are moved are found too.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skillcorpus.llm.shingles import Hasher, chunks
from skillcorpus.plans.storage import cut, partitions

#: Bits of the filter of seeds, whose size (8 MB at most) does not depend on the benchmark's; pairs of positions that tiling looks at in one step.
FILTER_BITS, STEP = 1 << 26, 1 << 20
_BUCKET = 1 << 15  # bits of one value of Spark's bitmap functions


def matches(doc: np.ndarray, at_doc: np.ndarray, item: np.ndarray, at_item: np.ndarray, k: int) -> np.ndarray:
    """All longest matches of two texts, given their seeds (hashes of ``k`` tokens) and positions: rows (item position, document position, tokens).

    Pairs of equal seeds are walked through in steps of about ``STEP`` in order of the document, so that a passage that both
    texts repeat does not fill the memory; a match that a step cuts goes on in the next one. No match is longer than the item.
    """
    order = np.argsort(item, kind="stable")
    item, at_item = item[order], at_item[order]
    lo, hi = np.searchsorted(item, doc), np.searchsorted(item, doc, side="right")
    order = np.argsort(at_doc, kind="stable")
    order = order[hi[order] > lo[order]]
    at_doc, lo, n = at_doc[order], lo[order], (hi - lo)[order]
    total = np.cumsum(n)
    ended: list[np.ndarray] = []
    live = np.empty((0, 3), np.int64)  # matches that reach the last position of the steps so far
    a = 0
    while a < len(n):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + STEP, side="right")))
        m = n[a:b]
        i = at_item[np.repeat(lo[a:b] - np.r_[0, np.cumsum(m)[:-1]], m) + np.arange(m.sum())]
        d = np.repeat(at_doc[a:b], m)
        order = np.lexsort((i, d - i))
        d, i = d[order], i[order]
        new = np.flatnonzero(np.r_[True, (np.diff(i) != 1) | (np.diff(d - i) != 0)])
        runs = np.stack([i[new], d[new], np.diff(np.r_[new, len(i)])], 1)
        if len(live):  # go on with matches of the step before
            runs = np.concatenate([live, runs])
            runs = runs[np.lexsort((runs[:, 1], runs[:, 1] - runs[:, 0]))]
            goes = np.r_[False, (np.diff(runs[:, 1] - runs[:, 0]) == 0) & (runs[:-1, 1] + runs[:-1, 2] == runs[1:, 1])]
            first = np.flatnonzero(~goes)
            runs = np.concatenate([runs[first][:, :2], np.add.reduceat(runs[:, 2], first)[:, None]], 1)
        open_ = runs[:, 1] + runs[:, 2] > at_doc[b - 1]
        ended.append(runs[~open_])
        live = runs[open_]
        a = b
    found = np.concatenate([*ended, live])
    found[:, 2] += k - 1
    return found


def tile(found: np.ndarray, k: int, size: int) -> list[tuple[int, int, int]]:
    """Greedy tiling from ``matches`` with an item of ``size`` tokens: tiles (document position, item position, tokens), longest first.

    The longest match is marked first, and what marked tokens leave of a later one goes on as shorter matches while it has ``k``
    tokens. Ties go to the earlier place in the item, then in the document. It ends when the item has no ``k`` free tokens in a row.
    """
    found = found[np.lexsort((found[:, 1], found[:, 0], -found[:, 2]))]
    rest: list[tuple[int, int, int]] = []
    doc_marked: set[int] = set()
    item_marked = np.zeros(size, bool)
    tiles = []
    at, room = 0, size >= k
    while room and (at < len(found) or rest):
        whole = (-int(found[at, 2]), int(found[at, 0]), int(found[at, 1])) if at < len(found) else None
        if rest and (whole is None or rest[0] < whole):
            minus, q, p = heapq.heappop(rest)
        else:
            (minus, q, p), at = whole, at + 1
        taken = item_marked[q : q - minus].copy()
        if not taken.all():
            taken |= np.fromiter((p + t in doc_marked for t in range(-minus)), bool, -minus)
        if not taken.any():
            tiles.append((p, q, -minus))
            doc_marked.update(range(p, p - minus))
            item_marked[q : q - minus] = True
            free = np.flatnonzero(np.diff(np.r_[True, item_marked, True].astype(np.int8)))
            room = bool((free[1::2] - free[::2] >= k).any())
            continue
        edges = np.flatnonzero(np.diff(np.r_[True, taken, True].astype(np.int8)))
        for begin, end in zip(edges[::2], edges[1::2], strict=True):  # the runs that are still free
            if end - begin >= k:
                heapq.heappush(rest, (int(begin - end), q + int(begin), p + int(begin)))
    return tiles


def _seeds(k: int):
    """Rows ``item, w, size, h, pos`` of items ``item, text``: each run of ``k`` tokens; an item shorter than ``k`` is one seed of its ``w`` tokens."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(k)
        for batch in batches:
            for first, data, offsets in chunks(batch.column(1)):
                words, at = hasher.words(data, offsets)
                for row, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
                    if b > a:
                        w = min(k, int(b - a))
                        h = hasher.windows(words[a:b], w)
                        key = batch.column(0)[first + row].as_py()
                        same = [pa.array(np.full(len(h), v, t)) for v, t in ((key, np.int64), (w, np.int32), (b - a, np.int32))]
                        yield pa.RecordBatch.from_arrays([*same, pa.array(h.view(np.int64)), pa.array(np.arange(len(h), dtype=np.int32))], names=["item", "w", "size", "h", "pos"])

    return of


def _seed_filter(spark: SparkSession, seeds: DataFrame) -> np.ndarray:
    """A bitmap of the seeds' hashes modulo ``FILTER_BITS``, made by the executors; its size has a bound whatever the benchmark's is."""
    bit = F.pmod("h", F.lit(FILTER_BITS)) + 1  # these functions count from one
    parts = seeds.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in parts.collect():  # FILTER_BITS / _BUCKET rows of 4 KB at most
        begin = (r["bucket"] - 1) * _BUCKET // 8
        out[begin : begin + _BUCKET // 8] |= np.frombuffer(r["bits"], np.uint8)
    return out


def _seeded(widths: list[int], k: int, shared):
    """Rows ``doc_id, text_hash, h, pos``: of each document the seeds that the filter lets through."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, bits = Hasher(k), shared.value
        for batch in batches:
            rows: list[tuple] = []
            for first, data, offsets in chunks(batch.column(2)):
                words, at = hasher.words(data, offsets)
                hs, ps, ts = [], [], []
                for w in widths:
                    h = hasher.windows(words, w)
                    bit = (h.view(np.int64) % FILTER_BITS).astype(np.int64)
                    where = np.flatnonzero(bits[bit >> 3] >> (bit & 7).astype(np.uint8) & 1)
                    text = np.searchsorted(at, where, side="right") - 1
                    inside = where + w <= at[text + 1]
                    hs.append(h[where[inside]])
                    ps.append(where[inside] - at[text[inside]])
                    ts.append(text[inside])
                h, pos, text = (np.concatenate(x) for x in (hs, ps, ts))
                order = np.argsort(text, kind="stable")
                h, pos, text = h[order].view(np.int64), pos[order], text[order]
                begin = np.flatnonzero(np.r_[True, text[1:] != text[:-1]]) if len(text) else np.empty(0, int)
                for a, b in zip(begin, [*begin[1:], len(text)], strict=False):
                    rows.append((first + int(text[a]), h[a:b], pos[a:b]))
            index = pa.array([r[0] for r in rows], pa.int64())
            kept = batch.select(["doc_id", "text_hash"]).take(index)
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array([r[1] for r in rows], pa.list_(pa.int64())), pa.array([r[2] for r in rows], pa.list_(pa.int64()))], names=["doc_id", "text_hash", "h", "pos"])

    return of


def _tiled(threshold: float):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, cover, count = [], [], []
            for row in range(len(batch)):
                h, pos, ih, ipos = (np.asarray(batch.column(c)[row].values) for c in ("h", "pos", "ih", "ipos"))
                size, w = batch.column("size")[row].as_py(), batch.column("w")[row].as_py()
                there = np.isin(ih, h)
                if len(np.unique((ipos[there][:, None] + np.arange(w)).ravel())) < threshold * size:  # tiles lie within seeds
                    continue
                tiles = tile(matches(h, pos, ih, ipos, w), w, size)
                coverage = sum(t[2] for t in tiles) / size
                if coverage >= threshold:
                    keep.append(row)
                    cover.append(coverage)
                    count.append(len(tiles))
            kept = batch.select(["doc_id", "text_hash", "item"]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(cover, pa.float64()), pa.array(count, pa.int32())], names=["doc_id", "text_hash", "item", "coverage", "n_tiles"])

    return of


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, k: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, text_hash, item_id, coverage, n_tiles`` of all (document, item) pairs whose coverage reaches ``threshold``.

    A document is an id with a text (``text_hash``: its xxhash64), so that rows without an id, or with the same one, are judged by their own texts. Words are
    compared after A-Z is lower-cased. Matches have ``k`` words at least, or all words of a shorter item. Null or empty items
    and texts match nothing, nor does an item without an id; equal items count each. Extra columns are ignored.

    1. The benchmark's seeds go into a bitmap of fixed size, with which one pass over the documents leaves out nearly all of theirs.
    2. What is left is joined with the items' seeds. A covered item has at least ``threshold`` of its tokens in tiles, so at
       least a ``k``-th of these begin a shared seed: all but one of so many seeds, the most frequent ones, are left out of the join.
    3. Each pair that shares a seed is tiled, from its own seeds alone.
    """
    spark = docs.sparkSession
    named = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null and item_id is not null")
    items = cut(named.select("item_id", "text", F.xxhash64("item_id", "text").alias("item")), "items")
    seeds = cut(items.select("item", "text").dropDuplicates(["item"]).mapInArrow(_seeds(k), "item long, w int, size int, h long, pos int"), "seeds")
    widths = [r[0] for r in seeds.select("w").distinct().collect()] or [k]  # k at most
    shared = spark.sparkContext.broadcast(_seed_filter(spark, seeds))
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).cast("string").alias("text"))
    found = cut(slim.mapInArrow(_seeded(widths, k, shared), "doc_id long, text_hash long, h array<long>, pos array<long>").dropDuplicates(["doc_id", "text_hash"]), "seeded")

    df = seeds.groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    need = F.ceil(threshold * F.col("size") / F.col("w"))
    rank = F.row_number().over(Window.partitionBy("item").orderBy("df", "h", "pos"))
    index = cut(seeds.join(df, "h").withColumn("rank", rank).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("item"))).filter(F.col("rank") <= F.col("n") - need + 1).select("h", "item").distinct(), "seed-index")
    exploded = found.select("doc_id", "text_hash", F.explode(F.array_distinct("h")).alias("h"))
    pairs = cut(exploded.join(index, "h").select("doc_id", "text_hash", "item").distinct(), "seed-pairs")
    lists = seeds.groupBy("item", "w", "size").agg(F.collect_list(F.struct("h", "pos")).alias("s")).select("item", "w", "size", F.col("s.h").alias("ih"), F.col("s.pos").alias("ipos"))
    same = F.col("p.doc_id").eqNullSafe(F.col("f.doc_id")) & F.col("p.text_hash").eqNullSafe(F.col("f.text_hash"))
    sides = pairs.alias("p").join(found.alias("f"), same).select("p.doc_id", "p.text_hash", "item", "h", "pos").join(lists, "item")
    tiled = sides.repartition(partitions(spark), "doc_id", "text_hash", "item").mapInArrow(_tiled(threshold), "doc_id long, text_hash long, item long, coverage double, n_tiles int")
    return tiled.join(items.select("item", "item_id").distinct(), "item").select("doc_id", "text_hash", "item_id", "coverage", "n_tiles")


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, k: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, contaminated, item_ids`` (ascending), ``coverage`` (the largest, else 0).

    Rows are judged by their own texts, also where ids repeat or lack; a very long text is judged whole. Empty inputs give no rows, or documents that are all clean.
    """
    pairs = cut(leaks(docs, benchmark, threshold, k, doc_id, text), "leaks")
    per_doc = pairs.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max("coverage").alias("coverage"))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"))
    same = F.col("r.doc_id").eqNullSafe(F.col("d.doc_id")) & F.col("r.text_hash").eqNullSafe(F.col("d.text_hash"))
    joined = rows.alias("r").join(per_doc.alias("d"), same, "left")
    return joined.select("r.doc_id", F.col("item_ids").isNotNull().alias("contaminated"), F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"))
