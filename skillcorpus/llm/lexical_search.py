"""Ranked lexical search by buckets of vector lengths.

A document is a vector of integer impacts of the queries' terms, a query one of their weights; the score is their inner
product. Vectors are ordered by length and lie in buckets of like lengths. A bucket is passed over by Cauchy-Schwarz when
its longest vector cannot reach a query's threshold. Inside a bucket only documents on the lists of a query's heaviest
coordinates are looked at, as many as it takes until the rest of the query cannot reach the threshold alone; of these a
bound by coordinates leaves the survivors, which are scored again in integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skillcorpus.llm import terms
from skillcorpus.plans.storage import cut, discard, partitions

#: Terms of queries that one pass over the documents serves, about; documents of a range of lengths; salts of the last ranking.
BLOCK_TERMS, RANGE_ROWS, SALTS = 1 << 20, 1 << 16, 64
_BY = terms.table(digits=True)
_NONE = np.iinfo(np.int64).min  # stands for a missing id
#: Bounds are doubles: they are widened by this share, so that rounding prunes nothing.
_SLACK = 1 + 1e-9


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [sorted({t for ws in terms.words(x, _BY) for t in ws}) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.binary()))], names=["item_id", "terms"])


def _frequencies(shared):
    """Rows ``doc_id, n, term, tf``: of each document with terms their number, and the frequencies of those that queries have."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = {t: i for i, t in enumerate(shared.value, 1)}.get
        for batch in batches:
            keep, n, offsets, ids, tf = [], [], [0], [], []
            for row, text in enumerate(batch.column(1)):
                count, held = 0, []
                for ws in terms.words(text.as_py(), _BY):
                    count += len(ws)
                    held.extend(filter(None, map(get, ws)))
                if count:
                    i, f = np.unique(np.array(held, np.int32), return_counts=True)
                    keep.append(row)
                    n.append(count)
                    ids.append(i - 1)
                    tf.append(f)
                    offsets.append(offsets[-1] + len(i))
            flat = [np.concatenate(x) if x else np.empty(0) for x in (ids, tf)]
            lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x.astype(np.int32))) for x in flat]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "term", "tf"])

    return of


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and the offsets of its rows in them."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy()[offsets[0] : offsets[-1]], offsets - offsets[0]


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What an occurrence count counts for in a document of length measure ``m``: an integer under a million."""
    tf = tf.astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def _lengths(shared):
    """Adds ``norm``, the length of the document's vector, whose coordinates are impacts times the roots of the terms' weights."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value.astype(float)
        for batch in batches:
            term, at = _flat(batch.column("term"))
            tf, _ = _flat(batch.column("tf"))
            x = impact(tf, np.repeat(batch.column("m").to_numpy(), np.diff(at))).astype(float)
            sums = np.r_[0, np.cumsum(w[term] * x * x)]
            # from differences of sums: rounding is made up for by what all sums of the batch can lose
            norm = np.sqrt(np.maximum(sums[at[1:]] - sums[at[:-1]], 0) + sums[-1] * 1e-12)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(norm)], names=[*batch.schema.names, "norm"])

    return of


class Query:
    """A query's terms, heaviest first, with their weights, coordinates and the length of what is left after each."""

    def __init__(self, ids: np.ndarray, w: np.ndarray) -> None:
        order = np.argsort(-w[ids], kind="stable")
        self.ids, self.w = ids[order], w[ids[order]]
        self.q = np.sqrt(self.w.astype(float))
        self.rest = np.sqrt(np.r_[np.cumsum(self.w[::-1])[::-1], 0].astype(float))  # rest[j]: without the first j
        self.top = (np.empty(0, np.int64), np.empty(0, np.int64))  # ids and scores found so far

    def add(self, ids: np.ndarray, scores: np.ndarray, k: int) -> None:
        ids, scores = np.r_[self.top[0], ids], np.r_[self.top[1], scores]
        order = np.lexsort((ids, -scores))[:k]
        self.top = ids[order], scores[order]

    def least(self, known: int, k: int) -> int:
        """The score that a document needs: what is known from elsewhere, the k-th found here, or 1."""
        return max(known, int(self.top[1][-1]) if len(self.top[1]) == k else 1, 1)


class Bucket:
    """Documents of like length: their coordinates as lists by term."""

    def __init__(self, batch: pa.RecordBatch, w: np.ndarray) -> None:
        ids = batch.column("doc_id")
        self.ids = ids.fill_null(_NONE).to_numpy() if ids.null_count else ids.to_numpy()
        self.norm = batch.column("norm").to_numpy()
        self.longest = float(self.norm.max(initial=0))
        term, at = _flat(batch.column("term"))
        tf, _ = _flat(batch.column("tf"))
        row = np.repeat(np.arange(len(self.ids)), np.diff(at))
        order = np.argsort(term, kind="stable")
        self.row = row[order]
        self.x = impact(tf[order], batch.column("m").to_numpy()[self.row])
        self.y = self.x * np.sqrt(w[term[order]].astype(float))
        self.at = np.searchsorted(term[order], np.arange(len(w) + 1))

    def places(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the lists of some terms stand, and for each place which of these terms it is."""
        a, n = self.at[ids], self.at[ids + 1] - self.at[ids]
        which = np.repeat(np.arange(len(ids)), n)
        return np.arange(n.sum()) + np.repeat(a - np.r_[0, np.cumsum(n)[:-1]], n), which

    def search(self, query: Query, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact scores of all documents whose score reaches ``least``."""
        reach = query.rest * self.longest * _SLACK >= least
        if not reach[0]:  # Cauchy-Schwarz: no vector of the bucket is long enough
            return self.ids[:0], self.ids[:0]
        focus = int(reach.sum()) if not reach[-1] else len(query.ids)
        place, which = self.places(query.ids[:focus])
        rows, y, n = self.row[place], self.y[place], len(self.ids)
        seen = np.bincount(rows, query.q[which] * y, n)
        held = np.bincount(rows, y * y, n)
        bound = seen + query.rest[focus] * np.sqrt(np.maximum(self.norm * self.norm - held, 0))
        survives = (seen > 0) & (bound * _SLACK + 1e-6 >= least)
        if not survives.any():
            return self.ids[:0], self.ids[:0]
        place, which = self.places(query.ids)
        inside = survives[self.row[place]]
        place, which = place[inside], which[inside]
        score = np.zeros(n, np.int64)
        np.add.at(score, self.row[place], query.w[which] * self.x[place])
        good = np.flatnonzero(score >= least)
        return self.ids[good], score[good]


def _searched(shared, k: int):
    """Rows ``query, doc_id, score``: the ``k`` best documents of a task's buckets for each query, if they reach its threshold."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, sets, known = shared.value
        queries = [Query(ids, w) for ids in sets]
        for batch in batches:  # in order of length: a batch is a bucket
            if len(batch):
                bucket = Bucket(batch, w)
                for query, least in zip(queries, known, strict=True):
                    query.add(*bucket.search(query, query.least(least, k)), k)
        found = [(i, *query.top) for i, query in enumerate(queries) if len(query.top[0])]
        if found:
            ids, score = (np.concatenate([f[j] for f in found]) for j in (1, 2))
            query = np.repeat([f[0] for f in found], [len(f[1]) for f in found])
            yield pa.RecordBatch.from_arrays([pa.array(query, pa.int32()), pa.array(ids, pa.int64(), mask=ids == _NONE), pa.array(score)], names=["query", "doc_id", "score"])

    return of


def _best(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best rows of each query with ``rank``; first within salted parts, so that no task gets all that tasks have found."""
    order = [F.desc("score"), F.asc("doc_id")]
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALTS)))
    part = salted.withColumn("rank", F.row_number().over(Window.partitionBy("query", "salt").orderBy(*order))).filter(F.col("rank") <= k)
    return part.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).filter(F.col("rank") <= k).drop("salt")


def search(docs: DataFrame, queries: DataFrame, k: int = 50, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``item_id, rank, doc_id, score``: for each query its ``k`` best documents, ranks from 1, equal scores by ascending id.

    Terms are runs of letters, digits and characters outside ASCII, A-Z lower-cased, of whole texts. With N documents that have terms, L terms in
    all, n in a document, df documents with a term and tf occurrences in one, a term weighs floor(1000 ln((2N + 2) / (2 df + 1))), m is
    50 + (50 n N) div L, and a score sums weight * ((10^9 tf) div (1000 tf + 20 m)) over a query's distinct terms. Only scores above 0 count.

    Null and empty texts have no terms: as documents they count for nothing, as queries they give no rows. Queries with one id are ranked each
    for itself; repeated documents take a rank each; an id that is null comes before others of its score. Empty tables give no rows. Extra columns are ignored.

    Queries are served in blocks of about ``block_terms`` terms, by a hash; for each block documents are read whole, what they have of its terms is
    written, and their vectors are dealt to ranges of lengths. The longest ranges are searched first, and the scores that they give are the thresholds
    for all others, of which Parquet leaves out those that are too short for every query. The driver holds one block's terms and thresholds.
    """
    spark = docs.sparkSession
    asked = queries.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).cast("string").cast("binary").alias("text"))
    asked = cut(asked.mapInArrow(_query_terms, "item_id long, terms array<binary>").filter(F.size("terms") > 0).withColumn("query", F.monotonically_increasing_id()), "queries")
    blocks = max(1, math.ceil((asked.agg(F.sum(F.size("terms"))).first()[0] or 0) / block_terms))
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text"))
    out = [_block(spark, slim, asked.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b).collect(), k) for b in range(blocks)]
    found = out[0]
    for more in out[1:]:
        found = found.unionAll(more)
    return found


def _block(spark, slim: DataFrame, asked: list, k: int) -> DataFrame:
    """The results of one block of queries."""
    vocabulary = sorted({t for r in asked for t in r["terms"]})
    place = {t: i for i, t in enumerate(vocabulary)}
    counted = cut(slim.mapInArrow(_frequencies(spark.sparkContext.broadcast(vocabulary)), "doc_id long, n long, term array<int>, tf array<int>"), "frequencies")
    n_docs, n_terms = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(1))).first()
    df = np.zeros(len(vocabulary), np.int64)
    for r in counted.select(F.explode("term").alias("term")).groupBy("term").count().collect():  # the block's terms at most
        df[r["term"]] = r["count"]
    w = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    sets = [np.array([place[t] for t in r["terms"]], np.int64) for r in asked]

    measured = counted.filter(F.size("term") > 0).withColumn("m", F.expr(f"50 + (50L * n * {n_docs}L) div {n_terms}L")).select("doc_id", "m", "term", "tf")
    vectors = cut(measured.mapInArrow(_lengths(spark.sparkContext.broadcast(w)), "doc_id long, m long, term array<int>, tf array<int>, norm double"), "vectors")
    discard(counted)
    ranges = max(partitions(spark), math.ceil(n_docs / RANGE_ROWS))
    dealt = vectors.repartitionByRange(ranges, F.desc("norm"), F.xxhash64("doc_id"))  # many vectors may have one length
    ordered = cut(dealt.withColumn("range", F.spark_partition_id()).sortWithinPartitions(F.desc("norm")), "ranges")
    discard(vectors)

    schema, head = "query int, doc_id long, score long", math.ceil(ranges / 16)

    def run(rows: DataFrame, known: list[int], to: str) -> DataFrame:
        shared = spark.sparkContext.broadcast((w, sets, known))
        return cut(_best(rows.mapInArrow(_searched(shared, k), schema), k).select("query", "doc_id", "score"), to)

    first = run(ordered.filter(F.col("range") < head), [0] * len(sets), "head")
    known = [0] * len(sets)
    for r in first.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).filter(F.col("n") == k).collect():
        known[r["query"]] = r["least"]
    lengths = [math.sqrt(int(w[s].sum())) for s in sets]
    shortest = min((t / (length * _SLACK) for t, length in zip(known, lengths, strict=True) if length), default=0.0)
    rest = run(ordered.filter((F.col("range") >= head) & (F.col("norm") >= shortest * (1 - 1e-9))), known, "tail")
    discard(ordered)
    ids = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(asked)], "query int, item_id long")
    return _best(first.unionAll(rest), k).join(ids, "query").select("item_id", "rank", "doc_id", "score")
