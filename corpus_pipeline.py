"""A corpus pipeline of five stages: each is one operator over all that the stage before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skillcorpus.llm import decontamination, jaccard_join, key_filter, language_id, mixing, sharding
from skillcorpus.plans.storage import cut, discard
from skillcorpus.sources.tables import table

DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]
#: What a row is found again by: an id alone may be lacking or repeated.
KEY = ["doc_id", "text_hash"]


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(*DOCUMENTS, F.xxhash64("text").alias("text_hash"))


def _same(a: str, b: str) -> Column:
    """Whether rows of two tables have one key; rows without an id, too."""
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & F.col(f"{a}.text_hash").eqNullSafe(F.col(f"{b}.text_hash"))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language that the model knows; ``und`` goes. One between two languages is flagged, but clean text, and stays.

    The model learns from the labelled documents at hand. Null and empty texts and such without a letter are ``und``. Each row is judged
    by its text alone, so rows without an id, or repeated ones, go or stay like others. An empty table, or one without labels, keeps nothing. Columns beside those of documents go.
    """
    model = language_id.train(docs)
    found = language_id.identify(docs.select(*DOCUMENTS), model)
    return found.filter(F.col("lang_pred") != language_id.UNKNOWN).select(*DOCUMENTS)


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each class of near duplicates: that of the least id (rows without an id last), then of the least hash of its text.

    Of rows with one id and text one stays; rows of one id but unlike texts are of classes of their own and stay. Null and empty texts, and
    texts without words, are in no class and stay, repeated ones too. An empty table gives no rows. Columns beside those of documents go.
    """
    classes = cut(jaccard_join.jaccard_classes(docs).select(*KEY, "class").filter("class is not null"), "classes")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    # written and without classes of one row, so that the join is one that Spark can split where a class is large
    kept = cut(classes.groupBy("class").agg(F.min(order).alias("kept"), F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("class", "kept"), "kept")
    judged = classes.join(kept, "class").select(*KEY, order.eqNullSafe(F.col("kept")).alias("stays")).groupBy(*KEY, "stays").agg(F.count(F.lit(1)).alias("n"))
    judged = cut(judged, "judged")
    discard(classes)
    repeated = cut(judged.filter("stays and n > 1").select(*KEY), "repeated")
    gone = cut(judged.filter("not stays or n > 1").select(*KEY), "gone")
    # rows that no key of these can be are not moved: their texts are most of the input
    docs = key_filter.marked(_keyed(docs), gone, KEY)
    suspects = docs.filter("suspect").alias("d")
    rest = docs.filter("not suspect").select(*DOCUMENTS).union(suspects.join(gone.alias("g"), _same("d", "g"), "left_anti").select(*DOCUMENTS))
    others = [c for c in DOCUMENTS if c != "doc_id"]
    copies = suspects.join(repeated.alias("r"), _same("d", "r"), "left_semi").groupBy(*KEY).agg(F.min(F.struct(*others)).alias("row"))
    return rest.union(copies.select("doc_id", *[F.col(f"row.{c}").alias(c) for c in others]).select(*DOCUMENTS))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which a benchmark item covers its threshold, row by row: a row that shares its id with one of these stays if its text is clean.

    Rows without an id are judged like others, and all rows of one id and text alike. Null and empty texts hold no item and stay. Empty
    tables give no rows, or all documents. Columns beside those of documents go.
    """
    found = cut(decontamination.leaks(docs, table(spark, sf_dir, "benchmark")).select(*KEY).distinct(), "leaks")
    return _keyed(docs).alias("d").join(found.alias("f"), _same("d", "f"), "left_anti").select(*DOCUMENTS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents so that all sources weigh the same, in random order, with as many bytes in all as before.

    A null source is one source; rows without an id are drawn by their text; repeated rows are repeated equally often. Null texts weigh one byte.
    An empty table gives no rows. Columns beside those of documents go.
    """
    return mixing.mix(docs.select(*DOCUMENTS)).select(*DOCUMENTS)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deals the rows, with all columns of documents, to 40 shards of near equal bytes.

    Each row has a place of its own, also where ids lack or repeat; equal rows take theirs in any order. Null texts have 16 bytes. An empty table gives no rows.
    """
    return sharding.shard(docs, 40, carry=("text", "lang", "source", "n_chars"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", known_language),
    ("near_duplicates", one_of_each_class),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: No SQL: the stages learn a model and search similar sets.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, over ``documents``; each result is written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
