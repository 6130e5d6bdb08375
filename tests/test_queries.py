"""Every registered query against its SQL twin; the others run and keep their schema."""

from __future__ import annotations

import pytest

import skillcorpus.plans.ledger_queries
import skillcorpus.plans.match_queries
import skillcorpus.plans.portfolio_queries
import skillcorpus.plans.rewrite_queries
import skillcorpus.plans.scan_queries  # noqa: F401
from skillcorpus.plans import registry
from tests.conftest import differences


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_sql_twin(spark, sf_dir, name):
    assert differences(registry.QUERIES[name](spark, sf_dir), registry.ORACLES[name], sf_dir) == []


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, sf_dir, name):
    df = registry.QUERIES[name](spark, sf_dir)
    assert df.columns and df.count() >= 0


def test_entry(spark, sf_dir):
    rows = registry.entry(spark, sf_dir).collect()
    assert sum(r.n for r in rows) == 200


def test_twins_do_not_depend_on_partitions(spark, sf_dir):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "40"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            for name in ("conflict_pairs", "goal_rank", "listing_budget", "dup_merge_candidates"):
                assert differences(registry.QUERIES[name](spark, sf_dir), registry.ORACLES[name], sf_dir) == []
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
