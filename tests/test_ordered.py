"""Ordered jobs against a plain loop: chains, stars and random conflicts, folded whole, by components, and in rounds."""

from __future__ import annotations

import random

import pytest

from skillcorpus.operators import compose, ordered, receipts


def looped(rows):
    seen_r, seen_i, out = set(), set(), {}
    for ord_, r, i in sorted(rows):
        out[ord_] = r not in seen_r and i not in seen_i
        if out[ord_]:
            seen_r.add(r)
            seen_i.add(i)
    return out


def chain(n):
    return [(k, f"r{k // 2}", f"i{(k + 1) // 2}") for k in range(n)]


def conflicts(n, seed):
    rng = random.Random(seed)
    return [(k, f"r{rng.randrange(n)}", f"i{rng.randrange(n)}") for k in range(n)] + [(n + k, "hot", f"i{rng.randrange(n)}") for k in range(n // 4)]


@pytest.mark.parametrize("limit", [None, 60, 8])
def test_first_wins(spark, limit):
    rows = chain(40) + [(1000 + k, f"x{r}", f"x{i}") for k, r, i in conflicts(120, 3)] + [(5000, "alone", "alone")]
    got = receipts.first_wins(spark.createDataFrame(rows, "ord long, receipt string, invocation string"), limit)
    assert {r.ord: r.kept for r in got.collect()} == looped(rows)


def test_a_long_chain_takes_no_rounds(spark, monkeypatch):
    written = []
    plain = ordered.cut
    for module in (ordered, receipts):
        monkeypatch.setattr(module, "cut", lambda df, name: written.append(name) or plain(df, name))
    counts = []
    for n in (100, 10_000):
        written.clear()
        got = receipts.first_wins(spark.createDataFrame(chain(n), "ord long, receipt string, invocation string"))
        assert {r.ord: r.kept for r in got.collect()} == looped(chain(n))
        counts.append(len(written))
    assert counts[0] == counts[1] <= 3


def merged(pairs, value, blocked):
    gone, out = set(), set()
    for p, a, b, sim, same in sorted(pairs, key=lambda x: (x[0], -x[3], x[1], x[2])):
        if (p, a) in blocked or (p, b) in blocked:
            continue
        hi, lo = (a, b) if value[p, a] >= value[p, b] else (b, a)
        if (p, hi) not in gone and (p, lo) not in gone:
            gone.add((p, lo))
            out.add((p, lo, hi, "drop" if same or sim >= compose.DUPLICATE else "merge"))
    return out


@pytest.mark.parametrize("limit", [None, 30, 6])
def test_resolve(spark, limit):
    rng = random.Random(7)
    skills = [(p, k, float(rng.randrange(20)), rng.random() < 0.05) for p in ("p", "q") for k in range(60)]
    pairs = [("p", k, k + 1, 0.99 - k / 1000, False) for k in range(30)]  # a chain of falling likeness
    pairs += [("q", *sorted(rng.sample(range(60), 2)), rng.choice([0.5, 0.7, 0.9]), rng.random() < 0.2) for _ in range(90)]
    pairs = list({x[:3]: x for x in pairs}.values())
    rows = spark.createDataFrame(skills, "portfolio_id string, skill_ord long, value double, blocked boolean")
    got = compose.resolve(rows, spark.createDataFrame(pairs, "portfolio_id string, a long, b long, sim double, same_name boolean"), limit)
    assert {tuple(r) for r in got.select("portfolio_id", "skill_ord", "into", "action").collect()} == merged(pairs, {x[:2]: x[2] for x in skills}, {x[:2] for x in skills if x[3]})


def test_nothing_to_settle(spark):
    assert receipts.first_wins(spark.createDataFrame([], "ord long, receipt string, invocation string")).collect() == []
