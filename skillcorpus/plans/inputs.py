"""Inputs that several queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skillcorpus.operators.analysis import analysis
from skillcorpus.plans.storage import cut
from skillcorpus.sources import adapters

_WRITTEN: dict[tuple[str, str], DataFrame] = {}


def analysed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graded skills of the folder, written once per application: the scan is the costly part of every job on top of it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _WRITTEN:
        _WRITTEN[key] = cut(analysis(adapters.skills(spark, sf_dir)), "analysis")
    return _WRITTEN[key]


def forget() -> None:
    """Lets the next query grade the skills anew."""
    _WRITTEN.clear()
