"""N-gram Jaccard join by T-occurrence search.

Two texts whose shingle sets have Jaccard similarity J >= 3/4 share at least T = 3/7 (n_x + n_y) shingles. Candidates are
narrowed by counting on inverted lists, and what may link is searched exactly: short lists are merged, long ones
probed (DivideSkip), and pairs that reach T are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skillcorpus.operators.components import components
from skillcorpus.llm.key_filter import marked
from skillcorpus.llm.shingles import Hasher, digest
from skillcorpus.plans.storage import cut, discard, partitions

#: Postings that a mapper gathers before it deals them out, and shingles of one search task at most.
DEAL, TASK = 1 << 20, 1 << 19
#: Bytes of texts whose postings (about one for 15 bytes) are one group.
GROUP_BYTES = 1 << 24
#: A mapper reports the length of lists that have ``HEAVY`` entries or more in one deal; lists of ``HOT`` or more in all are in no group.
HEAVY, HOT = 16, 1 << 14

DEALT = "kind int, key int, doc_id long, ref long, g long, n int, h binary, ids binary, sizes binary, df binary, th long"
NAMES = [x.split()[0] for x in DEALT.split(", ")]


def least_overlap(n: np.ndarray | int) -> np.ndarray | int:
    """T of a set of n shingles against the smallest set it can link with: ceil(3n/4)."""
    return (3 * n + 3) // 4


def slack(n: np.ndarray | int) -> np.ndarray | int:
    """How many of its prefix's shingles a set must share with one other set to link.

    The prefix of a set is its first n - T + slack shingles by hash. If two sets share O >= T shingles, then both
    prefixes hold the same first O - T + slack or more of these. The more slack, the longer the prefix, and the larger the part
    of a set that may be common passages before it is led to unlike sets: with T/4, 43 percent of it.
    """
    return 1 + least_overlap(n) // 4


def _rows(**columns: object) -> pa.RecordBatch:
    """A batch of the ``DEALT`` schema; columns that are not named are null."""
    n = len(next(iter(columns.values())))
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(columns.get(x.split()[0], [None] * n), kinds[x.split()[1]]) for x in DEALT.split(", ")], names=NAMES)


def _dealt(kind: int, key: np.ndarray, **columns: np.ndarray) -> pa.RecordBatch:
    """One row per distinct key, with the key's part of each column as bytes."""
    order = np.argsort(key.astype(np.uint16 if key.max(initial=0) < 65536 else np.uint32), kind="stable")
    key = key[order]
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, int)
    to = np.r_[at[1:], len(key)][: len(at)]
    packed = {k: v[order] for k, v in columns.items()}
    return _rows(kind=[kind] * len(at), key=key[at].astype(np.int32), **{k: [v[a:b].tobytes() for a, b in zip(at, to, strict=True)] for k, v in packed.items()})


def _unpacked(table: pa.Table, **kinds: type) -> list[np.ndarray]:
    return [np.frombuffer(b"".join(table.column(k).to_pylist()), kind) for k, kind in kinds.items()]


def _postings(buckets: int, heavy: int):
    """Rows of kind 0: postings, dealt out by shingle; 1: one per document; 2: shingles with ``heavy`` sets or more in a deal, and how many."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        held: list[tuple[np.ndarray, int, int]] = []
        seen: set[int] = set()
        count = 0

        def deal() -> Iterator[pa.RecordBatch]:
            h = np.concatenate([x[0] for x in held])
            sizes = [len(x[0]) for x in held]
            ids = np.repeat(np.array([x[1] for x in held], np.int64), sizes)
            n = np.repeat(np.array([x[2] for x in held], np.int32), sizes)
            held.clear()
            seen.clear()
            yield _dealt(0, (h % np.uint64(buckets)).astype(np.int64), h=h, ids=ids, sizes=n)
            lists, length = np.unique(h, return_counts=True)
            if (length >= heavy).any():
                lists, length = lists[length >= heavy], length[length >= heavy]
                yield _dealt(2, np.zeros(len(lists), np.int64), h=lists, sizes=length.astype(np.int32))

        for batch in batches:
            sets, sizes = [0] * len(batch), [0] * len(batch)
            for row, values in hasher.sets(batch.column(2)):
                n = sizes[row] = len(values)
                g = sets[row] = digest(values)
                if n and g not in seen:  # copies of a text are one set
                    seen.add(g)
                    prefix = values[: n - least_overlap(n) + slack(n)]
                    held.append((prefix, g, n))
                    count += len(prefix)
                    if count >= DEAL:
                        yield from deal()
                        count = 0
            yield _rows(kind=[1] * len(batch), key=[0] * len(batch), doc_id=batch.column(0).to_pylist(), ref=batch.column(1).to_pylist(), g=sets, n=sizes, th=batch.column(3).to_pylist())
        if held:
            yield from deal()

    return of


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h, n = _unpacked(pa.Table.from_batches([batch]), h=np.uint64, sizes=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])


def _apart(buckets: int, hot: np.ndarray, length: np.ndarray, wanted: int):
    """Of postings, those of lists that are not hot (``wanted`` 0), or those of ``hot`` ones (2; ascending), dealt out by set."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                table = pa.Table.from_batches([batch.slice(row, 1)])
                h, ids, n = _unpacked(table, h=np.uint64, ids=np.int64, sizes=np.int32)
                at = np.minimum(np.searchsorted(hot, h), len(hot) - 1)
                there = hot[at] == h
                mine = there if wanted else ~there
                if not mine.any():
                    continue
                if wanted:
                    yield _dealt(0, ids[mine] % buckets, h=h[mine], ids=ids[mine], sizes=n[mine], df=length[at[mine]].astype(np.uint32))
                else:
                    yield _dealt(0, np.full(int(mine.sum()), table.column("key")[0].as_py(), np.int64), h=h[mine], ids=ids[mine], sizes=n[mine])

    return of


def _shared(buckets: int):
    """Of a bucket of inverted lists, the postings of lists that two sets or more are on, dealt out by set."""

    def of(table: pa.Table) -> pa.Table:
        h, ids, n = _unpacked(table, h=np.uint64, ids=np.int64, sizes=np.int32)
        order = np.lexsort((ids, h))
        h, ids, n = h[order], ids[order], n[order]
        new = np.r_[True, (h[1:] != h[:-1]) | (ids[1:] != ids[:-1])]
        h, ids, n = h[new], ids[new], n[new]
        at = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        df = np.diff(np.r_[at, len(h)])
        df = np.repeat(df, df)
        more = df > 1
        return pa.Table.from_batches([_dealt(0, ids[more] % buckets, h=h[more], ids=ids[more], sizes=n[more], df=df[more].astype(np.uint32))])

    return of


def _short_lists(buckets: int, hot: int):
    """Keeps sets with enough shared shingles, each with all but its slack - 1 longest lists, dealt out by shingle.

    Entries of lists of ``hot`` sets or more come as kind 2, for they need no group: see ``_hubs``.
    """

    def of(table: pa.Table) -> pa.Table:
        h, ids, n, df = _unpacked(table, h=np.uint64, ids=np.int64, sizes=np.int32, df=np.uint32)
        order = np.lexsort((h, df, ids))
        h, ids, n, df = h[order], ids[order], n[order], df[order]
        new = np.r_[True, (ids[1:] != ids[:-1]) | (h[1:] != h[:-1])]  # a set of several deals is on a hot list as often
        h, ids, n, df = h[new], ids[new], n[new], df[new]
        at = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        count = np.diff(np.r_[at, len(ids)])
        rank = np.arange(len(ids)) - np.repeat(at, count)
        keep = rank <= np.repeat(count, count) - slack(n.astype(np.int64))
        key = (h % np.uint64(buckets)).astype(np.int64)
        return pa.Table.from_batches([_dealt(kind, key[k], h=h[k], ids=ids[k]) for kind, k in ((0, keep & (df < hot)), (2, keep & (df >= hot)))])

    return of


def _stars(table: pa.Table) -> pa.Table:
    """Joins the sets on each short list to the first of them: as many edges as the lists are long."""
    h, ids = _unpacked(table, h=np.uint64, ids=np.int64)
    order = np.lexsort((ids, h))
    h, ids = h[order], ids[order]
    at = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    first = np.repeat(ids[at], np.diff(np.r_[at, len(h)]))
    order = np.lexsort((ids, first))
    first, ids = first[order], ids[order]
    keep = (first != ids) & np.r_[True, (first[1:] != first[:-1]) | (ids[1:] != ids[:-1])]
    return pa.table({"a": first[keep], "b": ids[keep]})


def _hubs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins each set on a hot list to a node that stands for the list, so that the list need not be in one place."""
    for batch in batches:
        h, ids = _unpacked(pa.Table.from_batches([batch]), h=np.uint64, ids=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array((h >> np.uint64(1)).astype(np.int64)), pa.array(ids)], names=["a", "b"])


def divide_skip(sets: list[np.ndarray], ids: np.ndarray, left: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links among ``sets`` (ascending hashes): a spanning forest of all pairs with J >= 3/4.

    ``left`` marks the sets of the first side; where it is given, only pairs across the sides are searched. For each set,
    by size, its lists are divided: the L longest are skipped, the short ones, which are ascending, merged, and those sets that
    are on T - L of them or more are looked up in the long ones by binary search.
    """
    order = np.argsort([len(s) for s in sets], kind="stable")
    sizes = np.array([len(sets[i]) for i in order], np.int64)
    h = np.concatenate([sets[i] for i in order])
    owner = np.repeat(np.arange(len(order)), sizes)
    by = np.argsort(h, kind="stable")  # within a list, sets are in order of size
    h, owner = h[by], owner[by]
    at = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.empty(0, int)
    length = np.diff(np.r_[at, len(h)])
    number = np.repeat(np.arange(len(at)), length)
    entries = number * len(order) + owner  # ascending: a binary search for (list, set)
    place = np.empty(len(h), np.int64)
    place[by] = number  # of each shingle in order of sets, its list
    begin = np.r_[0, np.cumsum(sizes)]
    side = None if left is None else np.asarray(left)[order]
    label = np.arange(len(order))  # of the forest so far
    links: list[tuple[int, int]] = []

    for q in range(1, len(order)):
        n = int(sizes[q])
        low = int(np.searchsorted(sizes, least_overlap(n)))  # smaller sets cannot link
        mine = place[begin[q] : begin[q + 1]]
        mine = mine[length[mine] > 1]
        need = (3 * (n + int(sizes[low])) + 6) // 7
        if low >= q or len(mine) < need:
            continue
        mine = mine[np.argsort(length[mine], kind="stable")]
        skip = min(need - 1, int(need / (0.1 * np.log2(length[mine[-1]] + 1) + 1)))
        short, long = mine[: len(mine) - skip], mine[len(mine) - skip :]
        spans = length[short]
        merged = owner[np.repeat(at[short] - np.r_[0, np.cumsum(spans)[:-1]], spans) + np.arange(spans.sum())]
        merged = np.sort(merged[(merged >= low) & (merged < q)], kind="stable")  # ascending runs, one a list, are merged
        edge = np.flatnonzero(np.r_[True, merged[1:] != merged[:-1]][: len(merged)])
        on, times = merged[edge], np.diff(np.r_[edge, len(merged)])
        enough = times >= need - skip
        found, counts = on[enough], times[enough]
        if side is not None:
            other = side[found] != side[q]
            found, counts = found[other], counts[other]
        if not len(found):
            continue

        def linked(y: np.ndarray, long: np.ndarray = long, all_: np.ndarray = found, counts: np.ndarray = counts, n: int = n) -> np.ndarray:
            """Those of ``y`` that link with the query, their overlap completed from the long lists."""
            wanted = (long[:, None] * len(order) + y).ravel()
            there = entries[np.minimum(np.searchsorted(entries, wanted), len(entries) - 1)] == wanted
            overlap = counts[np.searchsorted(all_, y)] + there.reshape(len(long), len(y)).sum(0)
            return y[100 * overlap >= 75 * (n + sizes[y] - overlap)]

        found = found[np.argsort(-counts, kind="stable")]
        _, first = np.unique(label[found], return_index=True)  # one of each tree, then all of the trees that it left apart
        for y in linked(found[first]):
            links.append((int(ids[order[q]]), int(ids[order[y]])))
            label[label == label[y]] = label[q]
        rest = np.setdiff1d(found[label[found] != label[q]], found[first])
        for y in linked(rest) if len(rest) else ():
            if label[y] != label[q]:
                links.append((int(ids[order[q]]), int(ids[order[y]])))
                label[label == label[y]] = label[q]
    return links


def _search(table: pa.Table) -> pa.Table:
    """All searches of a group: rows ``part, block, side, g, h``; a search is one (block, part)."""
    block, part = table.column("block").to_numpy(), table.column("part").to_numpy()
    side, g, h = table.column("side").to_numpy(), table.column("g").to_numpy(), table.column("h")
    order = np.lexsort((g, part, block))
    block, part, side, g = block[order], part[order], side[order], g[order]
    at = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (part[1:] != part[:-1])])
    links = []
    for a, b in zip(at, np.r_[at[1:], len(order)], strict=True):
        sets = [np.frombuffer(h[int(i)].as_py(), np.uint64) for i in order[a:b]]
        links += divide_skip(sets, g[a:b], None if (side[a:b] == 0).all() else side[a:b] == 1)
    return pa.table({"a": pa.array([x[0] for x in links], pa.int64()), "b": pa.array([x[1] for x in links], pa.int64())})


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets of rows ``text, g, block, total``; where ids repeat, rows of other texts go."""
    hasher = Hasher()
    for batch in batches:
        found = [(row, v.tobytes()) for row, v in hasher.sets(batch.column(0)) if digest(v) == batch.column(1)[row].as_py()]
        kept = batch.select(["g", "block", "total"]).take(pa.array([x[0] for x in found], pa.int64()))
        yield pa.RecordBatch.from_arrays([*kept.columns, pa.array([x[1] for x in found], pa.binary())], names=["g", "block", "total", "h"])


def _runs(members: DataFrame) -> DataFrame:
    """Adds ``run`` to ``block, kind, n, g, …``: by size, so many sets of one block and kind as have about ``TASK`` shingles.

    Only sums by size are ranked. Sets of one size are spread over the runs that their sum spans by a hash, so that a block of any size is nowhere in one place.
    """
    sizes = members.groupBy("block", "kind", "n").agg(F.sum("n").alias("s"))
    begin = F.coalesce(F.sum("s").over(Window.partitionBy("block", "kind").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = cut(sizes.withColumn("begin", begin), "run-starts")
    return members.join(starts, ["block", "kind", "n"]).withColumn("run", F.expr(f"cast((begin + pmod(xxhash64(g), s)) div {TASK} as int)")).drop("s", "begin")


def _searched(sets: DataFrame, width: int, alone: Column | bool = True) -> DataFrame:
    """Links found by the searches that ``sets`` (``g, block, part, side, h``) are in.

    Searches that are ``alone`` have a group each; the others, which are small, share ``width`` groups.
    """
    search = F.xxhash64("block", "part")
    at = F.when(alone if isinstance(alone, Column) else F.lit(alone), search).otherwise(F.pmod(search, F.lit(width))).alias("at")
    return sets.select(at, "block", "part", "side", "g", "h").groupBy("at").applyInArrow(_search, "a long, b long")


def _links(sets: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """Links within blocks, a spanning forest of them at least, by searches of bounded size.

    A block of ``TASK`` shingles or fewer is one search. Of a larger one, a sample of sets (pivots, about ``TASK`` shingles) is first
    searched against all runs of sets, which for copies of one text leaves one large class. Then only pairs of runs are searched
    that may join classes: a class of ``TASK`` shingles or more has runs of its own and is not searched in itself, all
    others share runs, which are searched in themselves and against all. So the work grows with what the pivots left apart.
    ``sets`` (``g, block, total, h``) and ``members`` (``g, block, total, n``) name the shingles of their block, so sets of small blocks need no join.
    """
    in_large = F.col("total") > TASK
    width = max(width, -(-(members.agg(F.sum("n")).first()[0] or 0) * 8 // TASK))
    small = _searched(sets.filter(~in_large).withColumns({"part": F.lit(0).cast("long"), "side": F.lit(0)}), width, F.col("total") > TASK // 8)
    large, sets = members.filter(in_large), sets.filter(in_large).select("g", "block", "h")
    if large.isEmpty():
        return small
    runs = _runs(large.withColumn("kind", F.lit(0).cast("long")))
    is_pivot = F.pmod(F.xxhash64("g", F.lit(5)), F.ceil(F.col("total") / TASK)) == 0
    parts = runs.select("block", "run").distinct()
    pivots = large.filter(is_pivot).select("g", "block").join(parts, "block").select("g", "block", F.col("run").cast("long").alias("part"), F.lit(1).alias("side"))
    tasks = runs.select("g", "block", F.col("run").cast("long").alias("part"), F.lit(2).alias("side")).union(pivots)
    first = cut(_searched(sets.join(tasks, ["block", "g"]), width), "pivot-links")

    labelled = cut(large.join(components(first).toDF("g", "label"), "g", "left").withColumn("label", F.coalesce("label", "g")), "labelled")
    whole = labelled.groupBy("block", "label").agg(F.sum("n").alias("in_label")).filter(F.col("in_label") >= TASK).select("block", "label", F.lit(1).alias("own"))
    kinds = labelled.join(cut(whole, "large-labels"), ["block", "label"], "left").withColumn("kind", F.when(F.col("own") == 1, F.col("label")).otherwise(-1))
    runs = cut(_runs(kinds.select("block", "kind", "n", "g")), "runs")
    spans = cut(runs.groupBy("block", "kind", "run").agg(F.min("n").alias("least"), F.max("n").alias("most")), "spans")
    x, y = spans.toDF("block", "kx", "rx", "lx", "mx"), spans.toDF("block", "ky", "ry", "ly", "my")
    differ = ((F.col("kx") != F.col("ky")) | (F.col("kx") == -1)) & (F.struct("kx", "rx") <= F.struct("ky", "ry")) & F.expr("3 * lx <= 4 * my and 3 * ly <= 4 * mx")
    pairs = x.join(y, "block").filter(differ).withColumn("part", F.xxhash64("kx", "rx", "ky", "ry"))
    alone = F.expr("kx = ky and rx = ry")
    sides = pairs.select("block", F.col("kx").alias("kind"), F.col("rx").alias("run"), "part", F.when(alone, 0).otherwise(1).alias("side")).union(pairs.filter(~alone).select("block", "ky", "ry", "part", F.lit(2)))
    second = _searched(sets.join(runs.join(sides, ["block", "kind", "run"]).select("g", "block", "part", "side"), ["block", "g"]), width)
    return small.union(first).union(second)


def groups(spark: SparkSession, docs: DataFrame) -> int:
    """Into how many groups postings are dealt: by the bytes of the texts, so that a group's size does not grow with the input."""
    return max(24, 2 * partitions(spark), -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // GROUP_BYTES))


def jaccard_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id, class, text_hash``.

    A text's set holds its distinct 5-word shingles (see ``shingles``); two texts link when their sets' Jaccard
    similarity is 3/4 or more, and ``component_id`` is the least id that links lead to. Nothing is sampled or capped:

    1. One pass hashes all texts, and deals the prefixes of their sets (about 0.44 n hashes each) out by hash. Texts
       with equal sets are one set from here on.
    2. Lists of one set go. Each set needs ``slack`` shared shingles in its prefix, else nothing links with it; it may
       skip its slack - 1 longest lists, so common passages do not bring unlike texts together.
    3. The rest of the lists only join sets into blocks, by as many edges as lists have entries. Lists of ``HOT`` sets or
       more are counted beforehand and are in no group: their entries go to the sets at once, with the list's length.
    4. In each block ``divide_skip`` searches whole sets; large blocks are cut into bounded searches (see ``_links``).

    ``class`` names the class whatever the ids are (null without shingles), ``text_hash`` is the text's xxhash64. Null or empty texts have no shingles and are alone, also where ids repeat. Rows with a null id have a null
    component unless they link with others. Extra columns are ignored. Empty input gives no rows.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    buckets = groups(spark, slim)
    slim = slim.select("doc_id", F.coalesce("doc_id", F.xxhash64("text")).alias("ref"), "text", F.xxhash64("text").alias("th"))  # ref finds a text again
    dealt = cut(slim.mapInArrow(_postings(buckets, HEAVY), DEALT), "postings")
    sets = cut(dealt.filter("kind = 1").select("doc_id", "ref", "g", "n", "th"), "set-names")
    lengths = dealt.filter("kind = 2").select("h", "sizes").mapInArrow(_lengths, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    found = lengths.filter(F.col("n") >= HOT).toPandas()  # one of HOT postings at most
    postings = dealt.filter("kind = 0").select("key", "h", "ids", "sizes")
    if len(found):
        hot = found["h"].to_numpy().astype(np.int64).view(np.uint64)
        order = np.argsort(hot)
        hot, length = hot[order], found["n"].to_numpy().astype(np.int64)[order]
        cold = postings.mapInArrow(_apart(buckets, hot, length, 0), DEALT).select("key", "h", "ids", "sizes")
        shared = cold.groupBy("key").applyInArrow(_shared(buckets), DEALT).union(postings.mapInArrow(_apart(buckets, hot, length, 2), DEALT))
    else:
        shared = postings.groupBy("key").applyInArrow(_shared(buckets), DEALT)
    kept = shared.select("key", "h", "ids", "sizes", "df").groupBy("key").applyInArrow(_short_lists(buckets, HOT), DEALT)
    kept = cut(kept.select("kind", "key", "h", "ids"), "short-lists")
    discard(dealt)
    stars = kept.filter("kind = 0").select("key", "h", "ids").groupBy("key").applyInArrow(_stars, "a long, b long")
    edges = stars.union(kept.filter("kind = 2").select("h", "ids").mapInArrow(_hubs, "a long, b long"))
    blocks = components(edges)
    discard(kept)

    first = sets.filter("n > 0").groupBy("g").agg(F.min("ref").alias("ref"), F.max("n").alias("n"))
    blocked = cut(first.join(blocks.toDF("g", "block"), "g"), "blocks")
    members = cut(blocked.join(blocked.groupBy("block").agg(F.sum("n").alias("total")), "block"), "members")
    # texts in no block, which are most, are not moved
    texts = marked(slim.select("ref", "text"), members, ["ref"]).filter("suspect").select("ref", "text").join(members.select("ref", "g", "block", "total").hint("shuffle_hash"), "ref")
    found = cut(texts.select("text", "g", "block", "total").mapInArrow(_sets, "g long, block long, total long, h binary"), "sets")
    links = _links(found, members.select("g", "block", "total", "n"), 4 * buckets)

    comps = components(links).toDF("g", "c")
    discard(found, members, blocked, blocks)
    named = sets.join(comps, "g", "left").withColumn("c", F.coalesce("c", "g"))
    # written and without classes of one row, so that the join is one that Spark can split where a class is large
    least = cut(named.filter("n > 0").groupBy("c").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("c", "least"), "least")
    alone = F.when(F.col("n") > 0, F.coalesce("least", "doc_id")).otherwise(F.col("doc_id"))
    return named.join(least, "c", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), alone.alias("component_id"), F.when(F.col("n") > 0, F.col("c")).alias("class"), F.col("th").alias("text_hash"))
