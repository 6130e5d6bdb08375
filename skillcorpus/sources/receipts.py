"""Reading run receipts: nested records in JSON files, some of them broken."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skillcorpus.operators import identity
from skillcorpus.operators.receipts import first_wins, summary
from skillcorpus.plans.storage import cut


def read_receipts(spark: SparkSession, path: str, whole: bool = True, max_bytes: int | None = None) -> DataFrame:
    """``file, ord, r, valid``: the receipts below ``path``, a file each, or (``whole`` false) a line each.

    ``r`` is a struct of ``identity.RECEIPT``; unions of kinds are variants, and what a record lacks is null. A record is not valid if it is no JSON object of that form, if it lacks
    an id, or if one of its ids and digests does not follow from its content. ``ord`` orders them: by file, then by start and id. Files beyond ``max_bytes`` are read, but not valid.
    """
    text = spark.read.text(path, wholetext=whole).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"))
    kind = identity.schema(identity.RECEIPT)
    rows = text.filter(F.trim("value") != "").withColumn("r", F.from_json("value", kind))
    is_object = F.startswith(F.schema_of_variant(F.try_parse_json("value")), F.lit("OBJECT"))
    r = F.col("r")
    sound = F.coalesce(is_object, F.lit(False)) & r["receiptId"].isNotNull() & r["invocationId"].isNotNull() & (F.size(identity.receipt_tampered(r)) == 0)
    fits = F.lit(True) if max_bytes is None else F.col("size") <= max_bytes
    ord_ = F.concat_ws("\x01", "file", F.coalesce(r["startedAt"], F.lit("")), F.coalesce(r["receiptId"], F.lit("")), F.md5("value"))
    return rows.select("file", ord_.alias("ord"), "r", (F.coalesce(sound, F.lit(False)) & fits).alias("valid"))


def summarize(receipts: DataFrame, skipped: int = 0) -> DataFrame:
    """One row of totals (see ``receipts.summary``) over what ``read_receipts`` gave: invalid records, duplicates by either id, and ``skipped`` files that were not read."""
    r = F.col("r")
    x = r["result"]
    place = F.concat_ws("\x01", "ord", F.lpad(F.monotonically_increasing_id().cast("string"), 20, "0"))  # copies in one file differ by nothing else
    rows = cut(receipts.select(place.alias("ord"), "valid", r["receiptId"].alias("receipt"), r["invocationId"].alias("invocation"), r["providerKind"].alias("kind"), (identity.is_true(x["goalPassed"]) & (x["evidenceStatus"] == "verified-here")).alias("goal_passed"), x["experimentOutcome"].alias("outcome")), "read-receipts")
    kept = first_wins(rows.filter("valid").select("ord", "receipt", "invocation"))
    return summary(rows.join(kept, "ord", "left"), skipped)
