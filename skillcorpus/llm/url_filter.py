"""URL filters over a sorted digest array.

A rule is a host with a path; it fits that host and its subdomains where the URL's path starts with the rule's. Rules are
kept as ascending arrays of 64-bit xxhash keys, cut by ranges of keys into files that every worker maps into memory and probes by
binary search for all candidates of a batch at once; the stored rule is then compared as a whole, so that colliding digests
decide nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skillcorpus.plans.storage import cut, shared_folder

#: Spark's own seed of xxhash64, so that its keys and those of the workers are the same.
SEED = 42
#: Bytes of rules in one file of the array, about; a larger rule set has more files.
PIECE_BYTES = 16 << 20
# Fixed values.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://`` or for null."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def key_of(text: str) -> int:
    return xxhash.xxh64_intdigest(text, SEED)


def packed(rules: list[tuple[str, str, str]]) -> bytes:
    """Rules (host, path, verdict) as one piece of the array: keys, text offsets, verdicts (1: block), path lengths, texts."""
    texts = sorted({(h + p, v) for h, p, v in rules}, key=lambda x: (key_of(x[0]), x))
    raw = [t.encode() for t, _ in texts]
    keys = np.array([key_of(t) for t, _ in texts], np.uint64)
    offsets = np.r_[0, np.cumsum([len(r) for r in raw])].astype(np.uint64)
    verdicts = np.array([v == "block" for _, v in texts], np.uint64)
    lengths = np.unique([len(p) for _, p, _ in rules]).astype(np.uint64)
    head = np.array([len(keys), len(lengths)], np.uint64)
    return b"".join(part.tobytes() for part in (head, keys, offsets, verdicts, lengths)) + b"".join(raw)


class Piece:
    """A written piece, mapped into memory."""

    def __init__(self, path: str) -> None:
        whole = np.memmap(path, np.uint8, "r")
        n, m = (int(x) for x in whole[:16].view(np.uint64))
        at = 16
        parts = []
        for size in (n, n + 1, n, m):
            parts.append(whole[at : at + 8 * size].view(np.uint64))
            at += 8 * size
        self.keys, self.offsets, self.verdicts, self.lengths = parts
        self.texts = whole[at:]

    def text(self, i: int) -> bytes:
        return self.texts[int(self.offsets[i]) : int(self.offsets[i + 1])].tobytes()

    def found(self, digests: np.ndarray, wanted: list[str]) -> Iterator[tuple[int, bool]]:
        """(candidate, whether it blocks) for each candidate that is a rule; its text is compared, not its digest alone."""
        lo, hi = np.searchsorted(self.keys, digests), np.searchsorted(self.keys, digests, side="right")
        for c in np.flatnonzero(hi > lo):
            text = wanted[c].encode()
            for i in range(lo[c], hi[c]):
                if self.text(i) == text:
                    yield int(c), bool(self.verdicts[i])


class DigestArray:
    """All pieces of a rule set, in order of keys."""

    def __init__(self, paths: list[str]) -> None:
        self.pieces = [p for p in map(Piece, paths) if len(p.keys)]
        self.first = np.array([int(p.keys[0]) for p in self.pieces], np.uint64)
        self.last = np.array([int(p.keys[-1]) for p in self.pieces], np.uint64)
        self.lengths = sorted({int(n) for p in self.pieces for n in p.lengths})

    def probe(self, hosts: list[str], paths: list[str]) -> list[tuple[str, bool] | None]:
        """For each URL the longest rule that fits and whether it blocks. Of rules with equal texts, blocking wins."""
        suffixes: dict[str, list[str]] = {}
        owner, wanted = [], []
        for row, (host, path) in enumerate(zip(hosts, paths, strict=True)):
            if host not in suffixes:
                parts = host.split(".")
                suffixes[host] = [".".join(parts[i:]) for i in range(len(parts))]
            for suffix in suffixes[host]:
                for n in self.lengths:
                    if n <= len(path):
                        owner.append(row)
                        wanted.append(suffix + path[:n])
        unique = {w: i for i, w in enumerate(dict.fromkeys(wanted))}  # of candidates that many URLs share, one is hashed
        texts = list(unique)
        digests = np.fromiter((key_of(w) for w in texts), np.uint64, len(texts))
        order = np.argsort(digests)
        blocks: dict[int, bool] = {}
        for k, piece in enumerate(self.pieces):
            part = order[np.searchsorted(digests, self.first[k], sorter=order) : np.searchsorted(digests, self.last[k], "right", sorter=order)]
            for c, block in piece.found(digests[part], [texts[i] for i in part]) if len(part) else ():
                blocks[int(part[c])] = blocks.get(int(part[c]), False) or block
        best: list[tuple[str, bool] | None] = [None] * len(hosts)
        rank: dict[int, tuple[int, int]] = {}
        for r, w in zip(owner, wanted, strict=True) if blocks else ():
            block = blocks.get(unique[w])
            mine = (len(w), w.find("/") if "/" in w else len(w))
            if block is not None and (r not in rank or mine > rank[r]):
                rank[r], best[r] = mine, (w, block)
        return best


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row, a piece, of all rules of a partition, which is a range of keys."""
    rules = [row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True)]
    if rules:
        piece = packed(rules)
        yield pa.RecordBatch.from_arrays([pa.array([piece], pa.binary())], names=["piece"])


def ship(spark: SparkSession, rules: DataFrame, piece_bytes: int) -> list[str]:
    """Writes the array of ``rules`` and gives it to all executors; the names of its files, in no order.

    Executors sort and pack the rules by ranges of keys. The driver holds one piece at a time, which it writes to the shared folder,
    from where executors copy it to their own working folder when a task first asks for it.
    """
    size = rules.agg(F.sum(F.length("host") + F.length("path") + 32)).first()[0] or 0
    unsigned = F.xxhash64(F.concat("host", "path")).bitwiseXOR(F.lit(-(2**63)))  # in the order of unsigned keys
    keyed = rules.withColumn("key", unsigned)
    pieces = cut(keyed.repartitionByRange(1 + size // piece_bytes, "key").drop("key").mapInArrow(_packs, "piece binary"), "url-rules")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    names = []
    for row in pieces.toLocalIterator():
        name = f"url-rules-{uuid.uuid4().hex}"
        path = hadoop.Path(f"{shared_folder(spark).rstrip('/')}/{name}")
        store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        out = store.create(path)
        out.write(row["piece"])
        out.close()
        spark.sparkContext.addFile(store.makeQualified(path).toString())
        names.append(name)
    return names


def _probed(names: list[str], host: int, path: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = DigestArray([SparkFiles.get(name) for name in names])
        for batch in batches:
            found = index.probe(batch.column(host).to_pylist(), batch.column(path).to_pylist())
            rule = pa.array([f and f[0] for f in found], pa.string())
            verdict = pa.array([f and ("block" if f[1] else "allow") for f in found], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, rule, verdict], names=[*batch.schema.names, "rule", "verdict"])

    return of


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """All columns of ``pages`` with ``host, path, rule, verdict``; columns of these names are replaced.

    ``rules`` has ``host, path, verdict`` (allow or block; rows with a null are left out). The rule of the longest text wins
    (of two as long the one with the longer host; of equal texts the blocking one); without a rule ``rule`` is null and the
    verdict is ``default``: a URL that the list does not name is let through. Null URLs and URLs without ``://`` have an empty host
    and path. URLs of any length are probed whole; repeated rows get a verdict each. An empty table gives no rows, an empty
    rule set the default verdict. Rule sets of any size go the same way; executors need disk, not memory, for them.
    """
    rules = rules.select("host", "path", "verdict").dropna()
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    rows = pages.select(*kept, url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    names = ship(pages.sparkSession, rules, piece_bytes)
    schema = T.StructType([*rows.schema, T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])
    found = rows.mapInArrow(_probed(names, len(kept), len(kept) + 1), schema)
    return found.withColumn("verdict", F.coalesce("verdict", F.lit(default)))
