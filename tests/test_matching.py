"""Goals against all portfolios."""

from __future__ import annotations

from skillcorpus.operators import matching as M
from skillcorpus.plans import match_queries
from skillcorpus.plans import registry
from skillcorpus.sources.tables import table


def test_gaps_are_told_for_every_goal_and_portfolio(spark):
    goals = spark.createDataFrame([(1, "deploy payment ledger"), (2, "payment budget"), (3, None), (2, "payment budget")], "goal_id long, goal string")
    skills = spark.createDataFrame([("p", 1, "payment", "for deployment"), ("q", 2, "budget", None), ("r", 3, "", ""), (None, 4, "payment", "ledger")], "portfolio_id string, skill_ord long, name string, description string")
    words = {1: {"deploy", "payment", "ledger"}, 2: {"payment", "budget"}}
    have = {"p": {"payment", "deploy"}, "q": {"budget"}, "r": set(), None: set()}  # deploy meets deployment in their first five characters
    want = sorted((str(p), g, w) for p, h in have.items() for g, ws in words.items() for w in ws - h)
    assert sorted((str(r.portfolio_id), r.goal_id, r.need) for r in M.gaps(goals, skills).collect()) == want


def test_goal_gaps_leave_no_portfolio_and_goal_out(spark, sf_dir):
    found = match_queries.goal_gaps(spark, sf_dir).select("portfolio_id", "goal_id").distinct().count()
    portfolios = table(spark, sf_dir, "documents").select("source").distinct().count()
    goals = table(spark, sf_dir, "benchmark").count()
    assert found == portfolios * goals  # no portfolio of the table covers a goal
    assert " ak " not in registry.ORACLES["goal_gaps"]


def test_plan_changes_of_every_portfolio_for_every_goal(spark, sf_dir):
    best = match_queries.rank_goal_topk(spark, sf_dir).count()
    rows = match_queries.plan_changes(spark, sf_dir).groupBy("portfolio_id").count().collect()
    assert len(rows) == table(spark, sf_dir, "documents").select("source").distinct().count()
    assert {r["count"] for r in rows} == {best}  # no portfolio leaves a goal out
    assert " ak " not in registry.ORACLES["plan_changes"]


def test_changes_of_null_and_of_empty_handed_portfolios(spark):
    chosen = spark.createDataFrame([(1, "Kit-2"), (1, "kit-4"), (2, "kit-2")], "goal_id long, name string")
    installed = spark.createDataFrame([("p", "kit-2", True), ("p", "KIT-2", False), ("q", "Kit-4", False), (None, "kit-2", True)], "portfolio_id string, name string, eligible boolean")
    states = {"p": ("installed", "add"), "q": ("add", "replace"), None: ("add", "add")}
    want = sorted((str(p), g, n, states[p][n == "kit-4"]) for p in states for g, n in [(1, "Kit-2"), (1, "kit-4"), (2, "kit-2")])
    assert sorted((str(r.portfolio_id), r.goal_id, r.name, r.change) for r in match_queries._changes(chosen, installed).select("portfolio_id", "goal_id", "name", "change").collect()) == want
