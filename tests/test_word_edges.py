"""Words beside accented letters: the library's edges of words are those of the SQL twins."""

from __future__ import annotations

import duckdb
from pyspark.sql import functions as F

from skillcorpus.functions import intents as I
from skillcorpus.functions import rules as R
from skillcorpus.functions.text import edges
from skillcorpus.operators import analysis as A
from skillcorpus.operators import scan
from skillcorpus.plans.scan_queries import HINTS, hinted_caps, stage_of

TEXTS = ["ésudo", "sudoé x", "à curl", "écurl x", "ünlink unlinkü", "plané", "éfile", "é\ncommandé", "x_sudo", "sudo9", "ÉAPI_KEYÉ", "été 10.1.2.3é", "évalué evalé (", "日sudo本"]


def test_rules_hit_beside_accented_letters(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string")
    got = {(r.i, r.id) for r in rows.select("i", F.inline(A.rule_hits(F.col("text")))).collect()}
    con = duckdb.connect()
    hits = lambda t, p: con.execute("select regexp_matches(?, ?)", [t, p]).fetchall()[0][0]
    expected, seen = set(), set()
    for i, t in enumerate(TEXTS):
        for r in R.RISK_RULES:
            if hits(t, r.sql) and (i, r.title) not in seen:
                seen.add((i, r.title))
                expected.add((i, r.id))
    assert got == expected and (0, "r35") in got and (1, "r35") in got and (3, "r38") in got
    assert {(r.i, r.id) for r in scan.matches(rows, scan.rule_table(spark)).collect()} >= {(0, "r35"), (3, "r38")}
    caps = {r.i: r.c for r in rows.select("i", hinted_caps(F.col("text")).alias("c")).collect()}
    assert caps == {i: [n for n, p in HINTS if hits(t, p)] for i, t in enumerate(TEXTS)} and caps[6] == ["filesystem"]
    assert rows.filter("i = 5").select(stage_of(F.col("text"))).collect()[0][0] == "discover"


def test_edges_keep_escaped_backslashes():
    assert edges(r"a\\b") == r"a\\b"
    assert edges(I.BUILDING).count("(?!\\w)") == I.BUILDING.count(r"\b")
