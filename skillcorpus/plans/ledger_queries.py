"""Queries over portfolios' actions, run receipts, outputs, manifests and the artifact catalog."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skillcorpus.functions import rules as R
from skillcorpus.operators import catalog as K
from skillcorpus.operators import compose as C
from skillcorpus.operators import identity as I
from skillcorpus.operators import portfolio as P
from skillcorpus.operators import receipts as V
from skillcorpus.operators.ranks import ranked
from skillcorpus.plans import sql as S
from skillcorpus.plans.inputs import analysed
from skillcorpus.plans.portfolio_queries import _CONFLICTS
from skillcorpus.plans.registry import query
from skillcorpus.plans.storage import cut, partitions
from skillcorpus.sources import adapters
from skillcorpus.sources.tables import table

_CR = f"""cr AS (SELECT portfolio_id, skill_ord, fm_name AS name, CASE WHEN gate = 'block' THEN 0 ELSE score END AS value, gate = 'block' AS blocked, {S.matches("description", R.BROAD)} AS broad, {S.goal_tokens("(fm_name || chr(32) || description)")} AS terms FROM an)"""
_MERGES = f"""{_CR}, ce AS (SELECT portfolio_id, skill_ord, unnest(terms) AS t FROM cr WHERE len(terms) >= 4),
cj AS (SELECT x.portfolio_id, x.skill_ord AS a, y.skill_ord AS b, count(*) AS s FROM ce x JOIN ce y ON x.portfolio_id = y.portfolio_id AND x.t = y.t AND x.skill_ord < y.skill_ord GROUP BY 1, 2, 3),
ck AS (SELECT cj.portfolio_id, a, b, s / (len(p.terms) + len(q.terms) - s)::DOUBLE AS sim, false AS same_name FROM cj JOIN cr p ON p.portfolio_id = cj.portfolio_id AND p.skill_ord = a JOIN cr q ON q.portfolio_id = cj.portfolio_id AND q.skill_ord = b WHERE sim >= 0.45),
cn0 AS (SELECT portfolio_id, first_value(skill_ord) OVER (PARTITION BY portfolio_id, name ORDER BY value DESC, skill_ord) AS x, skill_ord AS y FROM cr WHERE name <> ''),
cn AS (SELECT portfolio_id, least(x, y) AS a, greatest(x, y) AS b, 1.0::DOUBLE AS sim, true AS same_name FROM cn0),
cm AS (SELECT portfolio_id, a, b, max(sim) AS sim, bool_or(same_name) AS same_name FROM (SELECT * FROM ck UNION ALL SELECT * FROM cn WHERE a < b) GROUP BY 1, 2, 3)"""


# Pairs, strongest first, folded over what is gone so far; the first pair always counts, as blocked skills are in none.
_GONE = "list_contains(list_transform(acc, lambda y: y.lo), x[1].{0})"
_COMPOSED = f"""cw AS (SELECT cm.portfolio_id, a, b, sim, CASE WHEN p.value >= q.value THEN a ELSE b END AS hi, CASE WHEN p.value >= q.value THEN b ELSE a END AS lo, CASE WHEN same_name OR sim >= 0.8 THEN 'drop' ELSE 'merge' END AS act
  FROM cm JOIN cr p ON p.portfolio_id = cm.portfolio_id AND p.skill_ord = a JOIN cr q ON q.portfolio_id = cm.portfolio_id AND q.skill_ord = b WHERE NOT p.blocked AND NOT q.blocked),
cx AS (SELECT portfolio_id, unnest(list_reduce(list([{{'lo': lo, 'hi': hi, 'act': act}}] ORDER BY sim DESC, a, b), lambda acc, x: CASE WHEN {_GONE.format("lo")} OR {_GONE.format("hi")} THEN acc ELSE acc || x END)) AS m FROM cw GROUP BY 1),
mv AS (SELECT portfolio_id, m.lo AS skill_ord, m.hi AS target, m.act AS action FROM cx UNION ALL SELECT portfolio_id, skill_ord, NULL, 'drop' FROM cr WHERE blocked),
sd AS (SELECT portfolio_id, skill_ord, broad AND NOT blocked AS broad, unnest(list_filter(terms, lambda t: length(t) > 3)) AS t FROM cr ANTI JOIN mv USING (portfolio_id, skill_ord)),
vi AS (SELECT x.portfolio_id, x.skill_ord, min(y.skill_ord) AS victim FROM sd x JOIN sd y USING (portfolio_id, t) WHERE x.broad AND x.skill_ord <> y.skill_ord GROUP BY 1, 2),
fx AS (SELECT DISTINCT skill_ord, true AS fixable FROM af WHERE category IN ({S.in_list(C.FIXABLE)})),
co AS (SELECT an.portfolio_id, an.skill_ord, cr.value::DOUBLE AS value, cr.relevance, cr.terms, an.tokens_total, an.tokens_desc, an.gate, an.grade, coalesce(mv.target, vi.victim) AS target,
  coalesce(mv.action, CASE WHEN vi.victim IS NOT NULL THEN 'narrow' WHEN an.grade = 'A' AND an.tokens >= 85 AND fixable IS NULL THEN 'keep' ELSE 'optimize' END) AS action
  FROM an JOIN cr ON cr.portfolio_id = an.portfolio_id AND cr.skill_ord = an.skill_ord LEFT JOIN mv ON mv.portfolio_id = an.portfolio_id AND mv.skill_ord = an.skill_ord
  LEFT JOIN vi ON vi.portfolio_id = an.portfolio_id AND vi.skill_ord = an.skill_ord LEFT JOIN fx ON fx.skill_ord = an.skill_ord)"""
_PLAIN = _MERGES.replace("value, gate = 'block' AS blocked", "value, NULL::DOUBLE AS relevance, gate = 'block' AS blocked", 1)
_KEYS = "list_filter(['exact:' || {0}, CASE WHEN length({0}) >= 5 THEN 'p5:' || left({0}, 5) END], lambda k: k IS NOT NULL)"
# The goal of each portfolio, and how far skills cover it.
_GOALS = f"""pn AS (SELECT source AS portfolio_id, ('0x' || left(md5(source), 8))::BIGINT % (SELECT greatest(1, count(*)) FROM benchmark) AS slot FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)),
pg AS (SELECT portfolio_id, list_filter(words, lambda w, i: list_position(words, w) = i) AS needs FROM (SELECT portfolio_id, {S.goal_tokens("goal").removeprefix("list_distinct")} AS words FROM pn JOIN (SELECT *, row_number() OVER (ORDER BY goal_id) - 1 AS slot FROM gl) USING (slot))),
pt AS (SELECT portfolio_id, len(needs) AS n, unnest(needs) AS need, unnest(range(len(needs))) AS pos FROM pg),
pk AS (SELECT *, unnest({_KEYS.format("need")}) AS key FROM pt),
hk AS (SELECT DISTINCT portfolio_id, skill_ord, unnest({_KEYS.format("term")}) AS key FROM (SELECT portfolio_id, skill_ord, unnest({S.goal_tokens("(fm_name || chr(32) || description)")}) AS term FROM an)),
rm AS (SELECT portfolio_id, skill_ord, count(DISTINCT need) AS hit FROM pk JOIN hk USING (portfolio_id, key) GROUP BY 1, 2),
rg AS (SELECT an.portfolio_id, an.skill_ord, coalesce(hit, 0) / n::DOUBLE AS relevance FROM an JOIN (SELECT DISTINCT portfolio_id, n FROM pt) p ON p.portfolio_id = an.portfolio_id LEFT JOIN rm ON rm.portfolio_id = an.portfolio_id AND rm.skill_ord = an.skill_ord)"""
_WEIGHED = (
    _MERGES.replace("CASE WHEN gate = 'block' THEN 0 ELSE score END AS value", "CASE WHEN gate = 'block' THEN 0 ELSE score * CASE WHEN relevance IS NULL THEN 1.0::DOUBLE ELSE 0.35::DOUBLE + 0.65::DOUBLE * relevance END END::DOUBLE AS value, relevance", 1)
    .replace("AS terms FROM an)", "AS terms FROM an LEFT JOIN rg USING (portfolio_id, skill_ord))", 1)
)
_FOR_GOALS = f"{_GOALS},\n{_WEIGHED},\n{_COMPOSED}"
_ORDER = "CASE action " + " ".join(f"WHEN '{a}' THEN {i}" for a, i in C.ORDER.items()) + " END"


@query(S.given("an", f"{_MERGES}\n---\nSELECT portfolio_id, a, b, round(sim, 6) AS sim, same_name FROM cm"))
def dup_merge_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of skills that are copies of each other or overlap heavily."""
    return C.merge_candidates(C.rows_of(analysed(spark, sf_dir))).withColumn("sim", F.round("sim", 6))


@query(S.given("an", f"{_CR}, x AS (SELECT portfolio_id, skill_ord, unnest(terms) AS t FROM cr WHERE NOT blocked AND broad), y AS (SELECT portfolio_id, skill_ord AS victim, unnest(terms) AS t FROM cr WHERE NOT blocked)\n---\nSELECT portfolio_id, skill_ord, min(victim) AS victim FROM x JOIN y USING (portfolio_id, t) WHERE victim <> skill_ord AND length(t) > 3 GROUP BY 1, 2"))
def narrow_victims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which skill each broad skill shadows first, blocked ones aside."""
    rows = C.rows_of(analysed(spark, sf_dir))
    return C.narrow_victims(rows, rows.filter("blocked").select("portfolio_id", "skill_ord"))


@query(S.given("af gl", f"{_FOR_GOALS}\n---\nSELECT portfolio_id, skill_ord, action, target, CASE WHEN action IN ('optimize', 'keep') AND gate = 'review' THEN 'review' WHEN action NOT IN ('drop', 'merge') AND relevance = 0 AND grade IN ('D', 'F') THEN 'offgoal' END AS flag, value, relevance, tokens_total FROM co"))
def job_compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to do with every skill, for the goal of its portfolio."""
    rows = C.compose(analysed(spark, sf_dir), adapters.portfolio_goals(spark, sf_dir))
    return rows.select("portfolio_id", "skill_ord", "action", "target", "flag", "value", "relevance", "tokens_total")


@query(S.given("af gl", f"""{_FOR_GOALS}, st AS (SELECT DISTINCT portfolio_id, unnest({_KEYS.format("term")}) AS key FROM (SELECT portfolio_id, unnest(terms) AS term FROM co WHERE action NOT IN ('drop', 'merge'))),
me AS (SELECT DISTINCT portfolio_id, need FROM pk JOIN st USING (portfolio_id, key)),
un AS (SELECT portfolio_id, need, pos FROM pt ANTI JOIN me USING (portfolio_id, need) WHERE length(need) >= 4)
---
SELECT * FROM (SELECT portfolio_id, row_number() OVER (PARTITION BY portfolio_id ORDER BY pos) AS place, need FROM un) WHERE place <= 6"""))
def plan_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the goal of each portfolio needs that no skill that stays covers, the first six."""
    goals = adapters.portfolio_goals(spark, sf_dir)
    return C.gaps(C.compose(analysed(spark, sf_dir), goals), goals)


@query(S.given("af", f"""{_PLAIN}, {_COMPOSED}, {_CONFLICTS}, nc AS (SELECT portfolio_id, count(*) AS n FROM cf GROUP BY 1)
---
SELECT portfolio_id, count(*) AS total, {", ".join(f"count(*) FILTER (WHERE action = '{a}') AS {chr(34)}{a}{chr(34)}" for a in C.ORDER)}, sum(tokens_total)::BIGINT AS tokens_now, sum(CASE WHEN action IN ('drop', 'merge') THEN 0 ELSE tokens_total END)::BIGINT AS tokens_after,
 sum(tokens_desc + 8)::BIGINT AS always_on, coalesce(any_value(n), 0) AS conflicts FROM co LEFT JOIN nc USING (portfolio_id) GROUP BY 1"""))
def plan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions and conflicts of each portfolio, and its tokens before and after."""
    graded = analysed(spark, sf_dir)
    conflicts = P.conflict_pairs(graded.select("portfolio_id", "skill_ord", F.col("fm_name").alias("name"), "description"), words=False)
    return C.summary(C.compose(graded), conflicts)


@query(S.given("af", f"{_PLAIN}, {_COMPOSED}\n---\nSELECT portfolio_id, skill_ord, action, row_number() OVER (PARTITION BY portfolio_id ORDER BY {_ORDER}, value DESC, skill_ord) AS place FROM co"))
def order_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions in the order in which they are shown."""
    rows = cut(C.compose(analysed(spark, sf_dir)).select("portfolio_id", "skill_ord", "action", "value"), "actions")
    order = [C.rank_of(F.col("action")), -F.col("value"), F.col("skill_ord")]
    return ranked(rows, ["portfolio_id"], order).select("portfolio_id", "skill_ord", "action", F.col("rank").alias("place"))


_PAIRED = """pa AS (SELECT receipt_id, round(coalesce(avg(CASE WHEN status = 'ok' AND arm = 'baseline' THEN pass::INT END) * 100, 0), 3) AS baseline_rate, round(coalesce(avg(CASE WHEN status = 'ok' AND arm = 'proposed' THEN pass::INT END) * 100, 0), 3) AS proposed_rate,
  round(coalesce(avg(CASE WHEN status = 'ok' AND arm = 'baseline' THEN tokens END), 0), 3) AS baseline_tokens, round(coalesce(avg(CASE WHEN status = 'ok' AND arm = 'proposed' THEN tokens END), 0), 3) AS proposed_tokens,
  round(coalesce(avg(CASE WHEN status = 'ok' AND arm = 'baseline' THEN duration_ms END), 0), 3) AS baseline_duration, round(coalesce(avg(CASE WHEN status = 'ok' AND arm = 'proposed' THEN duration_ms END), 0), 3) AS proposed_duration, bool_or(status <> 'ok') AS any_error FROM obs GROUP BY 1),
pr AS (SELECT *, round(proposed_rate - baseline_rate, 3) AS lift FROM pa),
po AS (SELECT *, CASE WHEN any_error THEN 'error' WHEN lift < 0 THEN 'regressed' WHEN baseline_rate >= 95 THEN 'inconclusive' WHEN lift > 0 THEN 'improved' ELSE 'unchanged' END AS outcome FROM pr)"""


@query(S.given("obs", f"{_PAIRED}\n---\nSELECT receipt_id, baseline_rate, proposed_rate, baseline_tokens, proposed_tokens, lift, outcome, CASE WHEN baseline_tokens <> 0 THEN round((proposed_tokens - baseline_tokens) / baseline_tokens * 100, 3) ELSE 0 END AS token_delta, baseline_duration, proposed_duration, CASE WHEN baseline_duration <> 0 THEN round((proposed_duration - baseline_duration) / baseline_duration * 100, 3) ELSE 0 END AS duration_delta, CASE WHEN any_error THEN 'error' ELSE 'complete' END AS run_status, CASE WHEN any_error THEN 'inspected' ELSE 'verified-here' END AS evidence, CASE WHEN NOT any_error THEN proposed_rate / 100 >= 0.8 END AS goal_passed FROM po"))
def paired_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired results of all receipts."""
    return V.paired_results(adapters.observations_from_events(table(spark, sf_dir, "events")))


@query(S.given("obs", "c AS (SELECT receipt_id, task_id, seed, count(*) FILTER (WHERE arm = 'baseline') AS b, count(*) FILTER (WHERE arm = 'proposed') AS p FROM obs GROUP BY 1, 2, 3), s AS (SELECT receipt_id, count(DISTINCT task_id) * count(DISTINCT seed) * 2 AS n_expected FROM obs GROUP BY 1)\n---\nSELECT receipt_id, sum((b > 0)::INT + (p > 0)::INT)::BIGINT AS n_cells, sum(greatest(b - 1, 0) + greatest(p - 1, 0))::BIGINT AS n_duplicate, count(*) FILTER (WHERE (b = 0) <> (p = 0)) AS n_unpaired, any_value(n_expected) AS n_expected FROM c JOIN s USING (receipt_id) GROUP BY 1"))
def ledger_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completeness of the receipts' ledgers."""
    return V.ledger(adapters.observations_from_events(table(spark, sf_dir, "events")))


_FIRST = f"""{_PAIRED.replace("WHEN any_error THEN 'error' WHEN lift", "WHEN any_error THEN 'error' WHEN receipt_id % 10 = 3 THEN 'inconclusive' WHEN lift")},
rc AS (SELECT receipt_id AS ord, receipt_id % 97 AS receipt, receipt_id % 131 AS invocation, CASE WHEN receipt_id % 10 = 3 THEN 'simulated' ELSE 'real' END AS kind, CASE WHEN NOT any_error AND receipt_id % 10 <> 3 THEN proposed_rate / 100 >= 0.8 END AS goal_passed, outcome, receipt_id % 23 <> 7 AS valid FROM po),
rn AS (SELECT *, row_number() OVER (ORDER BY ord) AS i FROM rc WHERE %s),
fw(i, ord, kept, rs, vs) AS (SELECT 0::BIGINT, NULL::BIGINT, false, []::BIGINT[], []::BIGINT[] UNION ALL
 SELECT rn.i, rn.ord, NOT (list_contains(rs, receipt) OR list_contains(vs, invocation)), CASE WHEN list_contains(rs, receipt) OR list_contains(vs, invocation) THEN rs ELSE list_append(rs, receipt) END, CASE WHEN list_contains(rs, receipt) OR list_contains(vs, invocation) THEN vs ELSE list_append(vs, invocation) END FROM fw JOIN rn ON rn.i = fw.i + 1)"""


def _recursive(sql: str) -> str:
    return S.given("obs", sql).replace("WITH ", "WITH RECURSIVE ", 1)


def _receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts with ids that repeat: the receipt id every 97 users, the invocation id every 131; every tenth is simulated, some are invalid."""
    k = F.col("receipt_id")
    rows = V.paired_results(adapters.observations_from_events(table(spark, sf_dir, "events")), simulated=k % 10 == 3)
    return rows.select(k.alias("ord"), (k % 97).alias("receipt"), (k % 131).alias("invocation"), F.when(k % 10 == 3, "simulated").otherwise("real").alias("kind"), "goal_passed", "outcome", (k % 23 != 7).alias("valid"))


@query(_recursive(_FIRST.replace("%s", "true") + "\n---\nSELECT ord, kept FROM fw WHERE i > 0"))
def receipt_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which receipts count, where ids repeat."""
    return V.first_wins(_receipts(spark, sf_dir))


@query(_recursive(_FIRST.replace("%s", "valid") + """, rj AS (SELECT rc.*, kept FROM rc LEFT JOIN (SELECT ord, kept FROM fw WHERE i > 0) f USING (ord)), rr AS (SELECT *, valid AND kept AND kind = 'real' AS counts FROM rj)
---
SELECT count(*) FILTER (WHERE counts) AS real, count(*) FILTER (WHERE counts AND goal_passed AND outcome <> 'regressed') AS successes, count(*) FILTER (WHERE counts AND outcome = 'error') AS errors, count(*) FILTER (WHERE counts AND outcome = 'regressed') AS regressions,
 count(*) FILTER (WHERE counts AND outcome = 'inconclusive') AS inconclusive, count(*) FILTER (WHERE valid AND kept AND kind = 'simulated') AS simulations, count(*) FILTER (WHERE NOT valid) AS invalid, count(*) FILTER (WHERE valid AND NOT kept) AS duplicates, 0::BIGINT AS skipped, round(successes / nullif(real, 0)::DOUBLE * 100, 3) AS rate FROM rr"""))
def receipt_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals over all receipts: invalid ones aside, and of the valid ones each id once."""
    rows = cut(_receipts(spark, sf_dir), "receipts")
    return V.summary(rows.join(V.first_wins(rows.filter("valid")), "ord", "left"))


_OBS_FAULTS = """ox AS (SELECT *, CASE WHEN receipt_id % 29 = 3 AND seed = 0 THEN 'other' ELSE sha256('suite') END AS su, CASE WHEN receipt_id % 31 = 4 AND arm = 'proposed' THEN 'other' WHEN arm = 'baseline' THEN sha256(receipt_id::VARCHAR) ELSE sha256((receipt_id + CASE WHEN receipt_id % 13 = 1 THEN 0 ELSE 1 END)::VARCHAR) END AS se FROM obs),
dc AS (SELECT receipt_id, list_sort(list_distinct(list(task_id))) AS tasks, list_sort(list_distinct(list(seed))) AS seeds FROM obs GROUP BY 1),
of0 AS (SELECT ox.receipt_id, arm, task_id, seed, count(*) AS n, count(*) FILTER (WHERE task_id = 4 AND ox.receipt_id % 37 = 5) AS o, count(*) FILTER (WHERE su <> sha256('suite')) AS d, count(*) FILTER (WHERE se <> CASE WHEN arm = 'baseline' THEN sha256(ox.receipt_id::VARCHAR) ELSE sha256((ox.receipt_id + CASE WHEN ox.receipt_id % 13 = 1 THEN 0 ELSE 1 END)::VARCHAR) END) AS u, count(*) FILTER (WHERE coalesce(tokens < 0, true)) AS x FROM ox GROUP BY 1, 2, 3, 4),
oc AS (SELECT receipt_id, sum(n) AS n_obs, count(*) AS n_cells, sum(n - 1) AS n_dup, sum(o) AS n_out, sum(d) AS n_drift, sum(u) AS n_setup, sum(x) AS n_bad FROM of0 GROUP BY 1),
rv AS (SELECT po.*, oc.* EXCLUDE (receipt_id), CASE WHEN receipt_id % 37 = 5 THEN list_filter(tasks, lambda t: t <> 4) ELSE tasks END AS tasks, seeds FROM po JOIN oc USING (receipt_id) JOIN dc USING (receipt_id)),
rf AS (SELECT *, list_filter([CASE WHEN receipt_id % 41 = 6 THEN 'receipt contains forbidden raw field: prompt' END, CASE WHEN receipt_id % 43 = 7 THEN 'protocolVersion is invalid' END, CASE WHEN receipt_id % 9 = 4 THEN 'receiptId is invalid' END, CASE WHEN receipt_id % 8 = 5 THEN 'invocationId is invalid' END,
  CASE WHEN receipt_id % 47 = 8 THEN 'attestation is invalid' END, CASE WHEN receipt_id % 53 = 9 THEN 'suite identity is invalid' END, CASE WHEN receipt_id % 14 = 6 THEN 'environment identity is invalid' END, CASE WHEN receipt_id % 17 = 2 THEN 'setup identity is invalid' END, CASE WHEN receipt_id % 7 = 2 THEN 'receipt timestamps are invalid' END,
  CASE WHEN receipt_id % 59 = 1 THEN 'limitations are invalid' END, CASE WHEN receipt_id % 61 = 1 THEN 'integrity is invalid' END, CASE WHEN n_obs > 2000 THEN 'observations are invalid' END], lambda x: x IS NOT NULL) AS f,
 list_filter([CASE WHEN receipt_id % 11 = 6 THEN 'provider kind and environment are inconsistent' END, CASE WHEN len(tasks) < 1 THEN 'suite taskIds are invalid' END, CASE WHEN len(seeds) < 3 THEN 'environment seeds are invalid' END, CASE WHEN len(seeds) <> 3 THEN 'environment trials must equal seed count' END, CASE WHEN receipt_id % 13 = 1 THEN 'baseline and proposed setups must differ' END,
  CASE WHEN n_dup > 0 THEN 'duplicate observation' END, CASE WHEN n_out > 0 THEN 'observation is outside the declared suite' END, CASE WHEN n_drift > 0 THEN 'observation identity drift' END, CASE WHEN n_setup > 0 THEN 'observation setup drift' END, CASE WHEN n_bad > 0 THEN 'observation values are invalid' END,
  CASE WHEN n_cells <> len(tasks) * len(seeds) * 2 THEN 'paired ledger is incomplete' END, CASE WHEN receipt_id % 19 = 4 THEN 'derived result does not match observations' END], lambda x: x IS NOT NULL) AS g FROM rv)"""


@query(S.given("obs", f"{_PAIRED}, {_OBS_FAULTS}\n---\nSELECT receipt_id, array_to_string(CASE WHEN len(f) > 0 THEN f ELSE g END, '; ') AS errors FROM rf"))
def job_receipt_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with each receipt: of its form, else of what it says; some are tampered with, in all fields that are checked."""
    obs = adapters.observations_from_events(table(spark, sf_dir, "events"))
    k = F.col("receipt_id")
    sha = lambda c: F.sha2(c.cast("string"), 256)
    says = lambda cond, bad, good: F.when(cond, F.lit(bad)).otherwise(F.lit(good) if isinstance(good, str) else good)
    sets = obs.groupBy("receipt_id").agg(F.sort_array(F.collect_set("task_id")).alias("task_ids"), F.sort_array(F.collect_set("seed")).alias("seeds"))
    results = V.paired_results(obs)
    names = [c for c in results.columns if c != "receipt_id"]
    recorded = F.struct(*names)
    tampered = recorded.withField("lift", F.when(k % 19 == 4, F.col("lift") + 1).otherwise(F.col("lift")))
    rows = sets.join(results.select("receipt_id", tampered.alias("result"), F.struct(*names).alias("derived")), "receipt_id").withColumns({
        "task_ids": F.when(k % 37 == 5, F.filter("task_ids", lambda t: t != 4)).otherwise(F.col("task_ids")), "field_names": F.array(F.lit("receiptId"), says(k % 41 == 6, "Prompt", "suite")), "protocol": says(k % 43 == 7, "0.9", "1.0"),
        "receipt_id_text": F.concat(F.lit("vr_"), says(k % 9 == 4, "zz", F.left(F.md5(k.cast("string")), F.lit(24)))), "invocation": says(k % 8 == 5, "short", F.concat(F.lit("invocation-"), k)), "attestation": says(k % 47 == 8, "remote", "local-self-attested"),
        "kind": F.lit("real"), "suite_sha": F.sha2(F.lit("suite"), 256), "verifier_sha": says(k % 53 == 9, "none", F.sha2(F.lit("verifier"), 256)), "goal_sha": F.sha2(F.lit("goal"), 256), "environment_sha": F.sha2(F.lit("environment"), 256), "adapter": F.lit("chat"), "runner": F.lit("r1"),
        "origin": says(k % 11 == 6, "http://far.example.org", "https://api.example.org"), "model": F.lit("m"), "node": F.lit("v20"), "os": F.lit("linux"), "arch": F.lit("x64"), "temperature": F.when(k % 14 == 6, 2.5).otherwise(0.0), "max_tokens": F.lit(512), "timeout_ms": F.lit(30_000),
        "baseline_sha": sha(k), "proposed_sha": sha(F.when(k % 13 == 1, k).otherwise(k + 1)), "skills": F.array(F.struct(F.concat(F.lit("skill-"), k).alias("name"), sha(k).alias("sha256"), F.when(k % 17 == 2, 0).otherwise(3).alias("files"))),
        "started": F.lit("2026-01-01T00:00:00"), "completed": says(k % 7 == 2, "not a time", "2026-01-01T00:10:00"), "limitations": F.when(k % 59 == 1, F.array().cast("array<string>")).otherwise(F.array(F.lit("one provider"))), "algorithm": F.lit("sha256"), "payload_sha": says(k % 61 == 1, "x", sha(k)),
        "title": F.lit("suite"), "goal_rate": F.lit(0.8), "trials": F.lit(3),
    })
    rows = cut(rows, "receipts")
    arm = F.when(F.col("arm") == "baseline", sha(k)).otherwise(sha(F.when(k % 13 == 1, k).otherwise(k + 1)))
    seen = obs.withColumns({
        "suite_sha": says((k % 29 == 3) & (F.col("seed") == 0), "other", F.sha2(F.lit("suite"), 256)), "environment_sha": F.sha2(F.lit("environment"), 256), "setup_sha": says((k % 31 == 4) & (F.col("arm") == "proposed"), "other", arm),
        "error_code": F.when(F.col("status") == "error", "provider-error"),
    })
    return V.receipt_errors(rows.join(V.observation_faults(seen, rows), "receipt_id"), "1.0", "chat", "r1").select("receipt_id", F.array_join("errors", "; ").alias("errors"))


@query("SELECT conv_id, count(*) * 3 * 2 AS requests, sum(3 * 3 * (64 * 2 + octet_length(encode(text)) * 2))::BIGINT AS input_bytes, count(*) * 3 * 2 * 3 * 512 AS output_tokens, count(*) * 6 > 200 OR sum(3 * 3 * (64 * 2 + octet_length(encode(text)) * 2)) > 20971520 OR count(*) * 3 * 2 * 3 * 512 > 200000 AS over FROM conversations WHERE role = 'user' GROUP BY 1")
def verify_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What running each suite (a conversation's user turns as tasks) would cost at most: 3 trials, 3 attempts, 512 output tokens."""
    rows = table(spark, sf_dir, "conversations").filter("role = 'user'").groupBy("conv_id").agg(
        (F.count(F.lit(1)) * 6).alias("requests"), F.sum(F.lit(9) * (128 + F.octet_length("text") * 2)).cast("long").alias("input_bytes"), (F.count(F.lit(1)) * 6 * 3 * 512).alias("output_tokens")
    )
    return rows.withColumn("over", F.expr("requests > 200 or input_bytes > 20971520 or output_tokens > 200000"))


@query("""WITH a AS (SELECT conv_id, turn, text AS output, CASE turn % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'contains' ELSE 'json' END AS kind, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations WHERE role = 'assistant'),
 b AS (SELECT *, CASE WHEN conv_id % 2 = 0 THEN output || '  ' ELSE coalesce(next, output) END AS value FROM a)
SELECT conv_id, turn, kind, CASE kind WHEN 'exact' THEN regexp_replace(output, '^\\s+|\\s+$', '', 'g') = regexp_replace(value, '^\\s+|\\s+$', '', 'g') WHEN 'contains' THEN contains(lower(output), lower(left(output, 12))) AND NOT contains(lower(output), lower(coalesce(left(next, 9), 'zzz'))) ELSE conv_id % 4 <> 3 AND conv_id % 5 <> 1 END AS pass FROM b""")
def job_grade_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns graded as outputs: against texts of their own or of the next turn, by texts they must and must not contain, and as JSON with keys in another order, other values, or broken."""
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    after = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = rows.withColumns({"next": after, "kind": F.when(F.col("turn") % 3 == 0, "exact").when(F.col("turn") % 3 == 1, "contains").otherwise("json")})
    body = F.to_json(F.struct(F.col("text").alias("t"), F.col("turn").alias("n")))
    other = F.to_json(F.struct(F.col("turn").alias("n"), F.when(F.col("conv_id") % 5 == 1, F.lit("another")).otherwise(F.col("text")).alias("t")))
    is_json = F.col("kind") == "json"
    outputs = rows.select(
        "conv_id", "turn", "kind", F.when(is_json, F.when(F.col("conv_id") % 4 == 3, F.concat(body, F.lit("}"))).otherwise(body)).otherwise(F.col("text")).alias("output"),
        F.when(is_json, other).when(F.col("conv_id") % 2 == 0, F.concat("text", F.lit("  "))).otherwise(F.coalesce("next", "text")).alias("value"),
        F.array(F.left("text", F.lit(12))).alias("all_of"), F.array(F.coalesce(F.left("next", F.lit(9)), F.lit("zzz"))).alias("none_of"),
    )
    return V.grade_outputs(outputs).select("conv_id", "turn", "kind", "pass")


_OTHER = "mg AS (SELECT bundle_id, path, CASE WHEN size % 10 = 3 THEN 493 ELSE mode END AS mode, size, CASE WHEN size % 7 = 1 THEN sha256(sha256) ELSE sha256 END AS sha256 FROM mf WHERE size % 11 <> 4 UNION ALL SELECT bundle_id, 'new/' || path, mode, size, sha256 FROM mf WHERE size % 13 = 5)"


def _installed_manifest(mf: DataFrame) -> DataFrame:
    """The same manifests as found at the target: some files gone, changed, new or of another mode."""
    kept = mf.filter("size % 11 <> 4").withColumns({"mode": F.when(F.col("size") % 10 == 3, 493).otherwise(F.col("mode")), "sha256": F.when(F.col("size") % 7 == 1, F.sha2("sha256", 256)).otherwise(F.col("sha256"))})
    return kept.unionByName(mf.filter("size % 13 = 5").withColumn("path", F.concat(F.lit("new/"), "path")))


@query(S.given("mf", f"{_OTHER}\n---\nSELECT coalesce(a.bundle_id, b.bundle_id) AS bundle_id, coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'removed' WHEN b.path IS NULL THEN 'added' WHEN a.sha256 <> b.sha256 THEN 'changed' ELSE 'mode' END AS change FROM mf a FULL JOIN mg b ON a.bundle_id = b.bundle_id AND a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR a.sha256 <> b.sha256 OR a.mode <> b.mode"))
def manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an installation would change, file by file."""
    mf = adapters.manifests_from_lineitem(table(spark, sf_dir, "lineitem"))
    return K.manifest_diff(mf, _installed_manifest(mf))


@query(S.given("mf", "SELECT bundle_id, count(*) AS files, sum(size)::BIGINT AS total_bytes, sha256('{\"entries\":[' || string_agg('{\"kind\":\"file\",\"mode\":' || mode || ',\"path\":\"' || path || '\",\"sha256\":\"' || sha256 || '\",\"size\":' || size || '}', ',' ORDER BY path) || '],\"files\":' || count(*) || ',\"rootMode\":448,\"totalBytes\":' || sum(size)::BIGINT || ',\"uninterpretedFiles\":[]}') AS bundle_sha256 FROM mf GROUP BY 1"))
def bundle_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals and canonical digests of manifests."""
    return K.bundle_digests(adapters.manifests_from_lineitem(table(spark, sf_dir, "lineitem")))


@query("SELECT lang AS category, CASE WHEN doc_id % 7 = 0 THEN 'seed' WHEN doc_id % 3 = 0 THEN 'curated' ELSE 'community' END AS pool, count(*) AS n FROM documents GROUP BY ALL")
def catalog_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog rows by category and pool."""
    return adapters.catalog_from_documents(table(spark, sf_dir, "documents")).groupBy("category", "pool").agg(F.count(F.lit(1)).alias("n"))


_ENTRIES = "en AS (SELECT p_partkey AS ord, CASE WHEN p_partkey % 17 = 5 THEN 'Bad_' || p_partkey ELSE 'kit-' || (p_partkey - (p_partkey % 40 = 1)::INT) END AS name, 'https://github.com/acme/' || CASE WHEN p_partkey % 19 = 2 THEN 'tree' ELSE 'skills/blob/main/k' END || '/SKILL.md' AS source_url, CASE WHEN p_size % 3 = 0 THEN 'pilot-ready' WHEN p_size % 3 = 1 THEN 'link-only' ELSE 'other' END AS status, CASE WHEN p_size % 2 = 0 THEN 'not-in-v2.1-pilot' ELSE 'because' END AS reason FROM part)"


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An artifact index with entries that break its rules."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        k.alias("ord"), F.when(k % 17 == 5, F.concat(F.lit("Bad_"), k)).otherwise(F.concat(F.lit("kit-"), k - (k % 40 == 1).cast("int"))).alias("name"),
        F.concat(F.lit("https://github.com/acme/"), F.when(k % 19 == 2, "tree").otherwise("skills/blob/main/k"), F.lit("/SKILL.md")).alias("source_url"),
        F.when(F.col("p_size") % 3 == 0, "pilot-ready").when(F.col("p_size") % 3 == 1, "link-only").otherwise("other").alias("status"), F.when(F.col("p_size") % 2 == 0, "not-in-v2.1-pilot").otherwise("because").alias("reason"),
    )


@query(f"WITH {_ENTRIES}, d AS (SELECT *, count(*) OVER (PARTITION BY name) AS n FROM en)\nSELECT ord, array_to_string(list_filter([CASE WHEN NOT regexp_matches(name, '^[a-z0-9]+(?:-[a-z0-9]+)*$') THEN 'name' END, CASE WHEN n > 1 THEN 'duplicate' END, CASE WHEN NOT regexp_matches(source_url, '^https://github\\.com/[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+/blob/[^/]+/.+/SKILL\\.md$') THEN 'url' END, CASE WHEN status NOT IN ('pilot-ready', 'link-only') OR (status = 'link-only' AND reason = 'because') THEN 'status' END], lambda x: x IS NOT NULL), '|') AS errors FROM d")
def job_catalog_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with each entry of the artifact index."""
    return K.index_errors(_entries(spark, sf_dir)).select("ord", F.array_join("errors", "|").alias("errors"))


#: Lines of orders that a task makes artifacts of, about.
LINES = 100_000


def _by_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of orders, dealt by order: bundles, artifacts and payloads are then made and joined where their lines are, and of all that only lines are moved."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.repartition(max(partitions(spark), lines.count() // LINES), "l_orderkey")


def _artifacts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Artifacts and their payloads: an order's lines as files; bytes, files, modes, encodings and git ids of some were changed after they were signed."""
    k = F.col("bundle_id")
    mf = adapters.manifests_from_lineitem(_by_order(spark, sf_dir))
    text = F.concat(F.lit("# "), F.col("path"), F.lit("\n"), F.repeat(F.lit("é "), F.pmod("size", F.lit(40)).cast("int")))
    files = mf.withColumn("content", F.encode(text, "UTF-8")).select(
        "bundle_id", F.struct("path", F.concat(F.lit("skills/"), "path").alias("sourcePath"), F.when(F.col("mode") == 493, "100755").otherwise("100644").alias("gitMode"), K.git_blob(F.col("content"), F.lit("0" * 40)).alias("gitBlobOid"), F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256")).alias("f"),
        F.struct("path", F.when(F.col("mode") == 493, 448).otherwise(384).cast("long").alias("mode"), F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"), K.base64_text(F.col("content")).alias("base64")).alias("g"),
    )
    both = files.groupBy("bundle_id").agg(F.array_sort(F.collect_list(F.struct("f", "g"))).alias("x"))
    own = F.encode(F.lit("MIT"), "UTF-8")
    license_ = F.struct(F.lit("LICENSE").alias("path"), F.sha2(own, 256).alias("sha256"), K.base64_text(own).alias("base64"))
    rows = both.select(k, F.concat(F.lit("sa_"), k).alias("artifactId"), F.concat(F.lit("kit-"), k).alias("name"), F.transform("x", lambda x: x["f"]).alias("files"), F.transform("x", lambda x: x["g"]).alias("given"), license_.alias("license"))
    rows = rows.withColumn("payloadSha256", K.payload_sha(F.lit("p1"), F.col("name"), F.col("given"), F.col("license")))
    first = lambda c, change: F.transform(c, lambda x, i: F.when(i == 0, change(x)).otherwise(x))
    zeros = first(F.col("files"), lambda x: x.withField("gitBlobOid", F.lit("0" * 40)))
    artifacts = rows.select("bundle_id", "artifactId", "name", "payloadSha256", F.struct(F.lit("LICENSE").alias("sourcePath"), F.col("license.sha256").alias("sha256")).alias("license"), F.when(k % 19 == 5, zeros).otherwise(F.col("files")).alias("files"))
    given = F.when(k % 7 == 1, first(F.col("given"), lambda x: x.withField("base64", K.base64_text(F.encode(F.lit("tampered"), "UTF-8"))))).when(k % 11 == 2, F.slice("given", F.lit(1), F.size("given") - 1))
    given = given.when(k % 13 == 3, first(F.col("given"), lambda x: x.withField("mode", 832 - x["mode"]))).when(k % 17 == 4, first(F.col("given"), lambda x: x.withField("base64", F.concat(x["base64"], F.lit("=="))))).otherwise(F.col("given"))
    payloads = rows.filter(k % 23 != 6).select("bundle_id", "artifactId", F.lit("p1").alias("protocolVersion"), "name", "payloadSha256", "license", given.alias("files"))
    return artifacts, payloads


@query(S.given("mf", """f AS (SELECT bundle_id, path, encode('# ' || path || chr(10) || repeat('é ', (size % 40)::INT)) AS b FROM mf),
o AS (SELECT bundle_id, min(path) AS first, max(path) AS last, max(sha1(encode('blob ' || octet_length(b)) || '\\x00'::BLOB || b)) AS most FROM f GROUP BY 1),
e AS (SELECT *, CASE WHEN bundle_id % 23 = 6 THEN 'gone' WHEN bundle_id % 7 = 1 THEN 'first' WHEN bundle_id % 11 = 2 THEN 'cut' WHEN bundle_id % 13 = 3 THEN 'first' WHEN bundle_id % 17 = 4 THEN 'first' END AS t FROM o)
---
SELECT bundle_id, most AS largest_blob, array_to_string(list_filter([CASE WHEN t = 'gone' THEN 'payload identity mismatch' END, CASE WHEN t IS NOT NULL THEN 'payload digest mismatch' END, CASE WHEN t = 'gone' THEN 'license payload mismatch' END, CASE WHEN t IN ('gone', 'cut') THEN 'payload file coverage mismatch' END,
 CASE WHEN t IN ('gone', 'first') OR bundle_id % 19 = 5 THEN 'payload file mismatch: ' || first WHEN t = 'cut' THEN 'payload file mismatch: ' || last END], lambda x: x IS NOT NULL), '; ') AS errors FROM e"""))
def catalog_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the payloads of artifacts hold the bytes that these declare, by size, digest and git object id."""
    artifacts, payloads = _artifacts(spark, sf_dir)
    contents = adapters.manifests_from_lineitem(_by_order(spark, sf_dir)).withColumn("content", F.encode(F.concat(F.lit("# "), F.col("path"), F.lit("\n"), F.repeat(F.lit("é "), F.pmod("size", F.lit(40)).cast("int"))), "UTF-8"))
    largest = contents.groupBy("bundle_id").agg(F.max(K.git_blob(F.col("content"), F.lit(""))).alias("largest_blob"))
    found = K.payload_errors(artifacts, payloads, key="bundle_id")
    return found.join(largest.hint("merge"), "bundle_id").select("bundle_id", "largest_blob", F.array_join("errors", "; ").alias("errors"))


def _skill(name: Column, files: Column) -> Column:
    """A skill of a setup, as receipts name it."""
    return F.struct(name.alias("name"), F.sha2(name, 256).alias("sha256"), files.cast("long").alias("files"), F.lit("A").alias("grade"), F.lit("pass").alias("gate"), F.lit("low").alias("risk"))


def _nested_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``receipt_id, r``: a nested receipt per user of the events, with right ids and digests; up to three skills, some twice in other case."""
    obs = adapters.observations_from_events(table(spark, sf_dir, "events"))
    results = V.paired_results(obs, simulated=F.col("receipt_id") % 10 == 3)
    text = F.col("receipt_id").cast("string")
    seen = F.struct(
        F.col("task_id").cast("string").alias("taskId"), "seed", "arm", F.when(F.col("status") == "ok", "ok").otherwise("provider-error").alias("status"), "pass", F.col("tokens").cast("double").alias("tokens"), F.col("duration_ms").alias("durationMs"),
        F.sha2(F.lit("suite"), 256).alias("suiteSha256"), F.lit("").alias("environmentSha256"), F.lit("").alias("setupSha256"), F.when(F.col("status") != "ok", "provider-error").alias("errorCode"),
    )
    listed = obs.groupBy("receipt_id").agg(F.sort_array(F.collect_list(seen)).alias("observations"), F.sort_array(F.collect_set("seed")).alias("seeds"), F.sort_array(F.collect_set(F.col("task_id").cast("string"))).alias("tasks"))
    k = F.col("receipt_id")
    name = lambda i: F.when((k % 13 == 6) & (i == 1), F.concat(F.lit("KIT-"), (k * 3) % 200)).otherwise(F.concat(F.lit("kit-"), (k * 3 + i * 7) % 200))
    skills = F.transform(F.slice(F.array(F.lit(0), F.lit(1), F.lit(2), F.lit(3)), F.lit(1), (k % 5).cast("int")), lambda i: _skill(name(i), 1 + (k + i) % 2))
    goal = F.parse_json(F.coalesce(F.col("goal_passed").cast("string"), F.lit('"unknown"')))
    none = F.lit("").alias("sha256")
    r = F.struct(
        F.lit("run-1").alias("protocolVersion"), F.lit("").alias("receiptId"), F.concat(F.lit("invocation-"), text).alias("invocationId"), F.lit("2026-01-01T00:00:00Z").alias("startedAt"), F.lit("2026-01-01T00:01:00Z").alias("completedAt"), F.lit("local-self-attested").alias("attestation"),
        F.when(k % 10 == 3, "simulated").otherwise("real").alias("providerKind"),
        F.struct(F.sha2(F.lit("suite"), 256).alias("sha256"), F.sha2(F.lit("v"), 256).alias("verifierSha256"), F.sha2(F.lit("g"), 256).alias("goalSha256"), F.concat(F.lit("Suite \"é\" "), text).alias("title"), F.col("tasks").alias("taskIds"), F.lit(0.8).alias("goalPassRate")).alias("suite"),
        F.struct(F.struct(none, F.array().cast(f"array<struct<{I.SKILL}>>").alias("orderedSkills")).alias("baseline"), F.struct(none, skills.alias("orderedSkills")).alias("proposed")).alias("setups"),
        F.struct(none, F.lit("openai-compatible-chat").alias("adapter"), F.lit("r1").alias("runnerVersion"), F.lit("https://api.example.com").alias("providerOrigin"), F.concat(F.lit("model-"), k % 5).alias("model"), F.lit("v20").alias("node"), F.lit("linux").alias("os"), F.lit("x64").alias("arch"), F.lit(0.0).alias("temperature"),
            F.lit(512).cast("long").alias("maxTokens"), F.lit(30_000).cast("long").alias("timeoutMs"), F.size("seeds").cast("long").alias("trials"), F.col("seeds").alias("seeds")).alias("environment"),
        "observations",
        F.struct(F.col("run_status").alias("runStatus"), F.col("evidence").alias("evidenceStatus"), F.col("outcome").alias("experimentOutcome"), goal.alias("goalPassed"), F.col("baseline_rate").alias("baselinePassRate"), F.col("proposed_rate").alias("proposedPassRate"), F.col("lift").alias("liftPoints"),
            F.col("baseline_tokens").alias("baselineAvgTokens"), F.col("proposed_tokens").alias("proposedAvgTokens"), F.col("token_delta").alias("tokenDeltaPct"), F.col("baseline_duration").alias("baselineAvgDurationMs"), F.col("proposed_duration").alias("proposedAvgDurationMs"), F.col("duration_delta").alias("durationDeltaPct")).alias("result"),
        F.array(F.lit("Local run only.")).alias("limitations"), F.struct(F.lit("sha256").alias("algorithm"), F.lit("").alias("payloadSha256")).alias("integrity"),
    )
    rows = results.join(listed, "receipt_id").select("receipt_id", r.alias("r"))
    for fields in (("baseline_sha", "proposed_sha", "environment_sha"), ("receipt_id",), ("payload_sha",)):  # each follows from those before
        at = {"baseline_sha": "setups.baseline.sha256", "proposed_sha": "setups.proposed.sha256", "environment_sha": "environment.sha256", "receipt_id": "receiptId", "payload_sha": "integrity.payloadSha256"}
        told, whole = I.receipt_digests(F.col("r")), F.col("r")
        for f in fields:
            whole = whole.withField(at[f], told[f])
        rows = cut(rows.select("receipt_id", whole.alias("r")), "nested-receipts")
    return rows


_SKILLS = """ks AS (SELECT receipt_id, i, CASE WHEN receipt_id % 13 = 6 AND i = 1 THEN 'KIT-' || ((receipt_id * 3) % 200) ELSE 'kit-' || ((receipt_id * 3 + i * 7) % 200) END AS name, 1 + (receipt_id + i) % 2 AS files FROM (SELECT receipt_id, unnest(range(0, receipt_id % 5)) AS i FROM po)),
kl AS (SELECT receipt_id, '[' || string_agg('{"files":' || files || ',"gate":"pass","grade":"A","name":"' || name || '","risk":"low","sha256":"' || sha256(name) || '"}', ',' ORDER BY i) || ']' AS skills FROM ks GROUP BY 1),
ev AS (SELECT receipt_id, list_sort(list_distinct(list(seed))) AS seeds FROM obs GROUP BY 1),
di AS (SELECT po.receipt_id, sha256('[]') AS baseline_sha, sha256(coalesce(skills, '[]')) AS proposed_sha, sha256('{"adapter":"openai-compatible-chat","arch":"x64","maxTokens":512,"model":"model-' || (po.receipt_id % 5) || '","node":"v20","os":"linux","providerOrigin":"https://api.example.com","runnerVersion":"r1","seeds":[' || array_to_string(seeds, ',') || '],"temperature":0,"timeoutMs":30000,"trials":' || len(seeds) || '}') AS environment_sha
 FROM po LEFT JOIN kl USING (receipt_id) JOIN ev USING (receipt_id))"""


@query(S.given("obs", f"""{_PAIRED}, {_SKILLS}
---
SELECT receipt_id, baseline_sha, proposed_sha, environment_sha, 'vr_' || left(sha256('{{"baseline":"' || baseline_sha || '","completedAt":"2026-01-01T00:01:00Z","environment":"' || environment_sha || '","invocationId":"invocation-' || receipt_id || '","proposed":"' || proposed_sha || '","suite":"' || sha256('suite') || '"}}'), 24) AS receipt_text_id FROM di"""))
def receipt_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the setups and the environment of nested receipts, and the ids that follow from them."""
    r = F.col("r")
    return _nested_receipts(spark, sf_dir).select("receipt_id", r["setups"]["baseline"]["sha256"].alias("baseline_sha"), r["setups"]["proposed"]["sha256"].alias("proposed_sha"), r["environment"]["sha256"].alias("environment_sha"), r["receiptId"].alias("receipt_text_id"))


def _tampered(rows: DataFrame) -> DataFrame:
    """The receipts with some changed after they were signed: results, models, ids, skills."""
    k, r = F.col("receipt_id"), F.col("r")
    changed = F.when(k % 7 == 2, r.withField("result.experimentOutcome", F.lit("improved!"))).when(k % 11 == 3, r.withField("receiptId", F.lit("vr_0"))).when(k % 13 == 4, r.withField("environment.model", F.lit("other"))).when((k % 17 == 5) & (k % 5 > 0), r.withField("setups.proposed.orderedSkills", F.slice(r["setups"]["proposed"]["orderedSkills"], F.lit(2), F.lit(9))))
    return rows.withColumn("r", changed.otherwise(r))


@query(S.given("obs", """---
SELECT DISTINCT receipt_id, CASE WHEN receipt_id % 7 = 2 THEN 'payload_sha' WHEN receipt_id % 11 = 3 THEN 'receipt_id|payload_sha' WHEN receipt_id % 13 = 4 THEN 'environment_sha|payload_sha' WHEN receipt_id % 17 = 5 AND receipt_id % 5 > 0 THEN 'proposed_sha|payload_sha' ELSE '' END AS tampered FROM obs""".replace("---\n", "zz AS (SELECT 1 AS one)\n---\n", 1)))
def receipt_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which ids and digests of receipts do not follow from what they hold; some were changed after they were signed."""
    return _tampered(_nested_receipts(spark, sf_dir)).select("receipt_id", F.array_join(I.receipt_tampered(F.col("r")), "|").alias("tampered"))


@query(_recursive(_FIRST.replace("receipt_id % 97 AS receipt, receipt_id % 131 AS invocation", "receipt_id AS receipt, receipt_id AS invocation").replace("receipt_id % 23 <> 7 AS valid", "NOT (receipt_id % 23 = 7 OR receipt_id % 7 = 2 OR receipt_id % 11 = 3 OR receipt_id % 13 = 4 OR (receipt_id % 17 = 5 AND receipt_id % 5 > 0)) AS valid").replace("%s", "valid") + """, rj AS (SELECT *, valid AND kind = 'real' AS counts FROM rc), dd AS (SELECT * FROM rj WHERE ord % 9 = 4 AND valid)
---
SELECT count(*) FILTER (WHERE counts) AS real, count(*) FILTER (WHERE counts AND goal_passed AND outcome <> 'regressed') AS successes, count(*) FILTER (WHERE counts AND outcome = 'error') AS errors, count(*) FILTER (WHERE counts AND outcome = 'regressed') AS regressions,
 count(*) FILTER (WHERE counts AND outcome = 'inconclusive') AS inconclusive, count(*) FILTER (WHERE valid AND kind = 'simulated') AS simulations, count(*) FILTER (WHERE NOT valid) + count(*) FILTER (WHERE NOT valid AND ord % 9 = 4) AS invalid, (SELECT count(*) FROM dd) AS duplicates, 0::BIGINT AS skipped, round(successes / nullif(real, 0)::DOUBLE * 100, 3) AS rate FROM rj"""))
def receipt_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals over receipts written to several JSON files and read back: broken lines, tampered records and copies are counted."""
    import uuid

    from skillcorpus.plans.storage import shared_folder
    from skillcorpus.sources.receipts import read_receipts, summarize

    path = f"{shared_folder(spark).rstrip('/')}/receipts-{uuid.uuid4().hex}"
    rows = _tampered(_nested_receipts(spark, sf_dir))
    line = F.when(F.col("receipt_id") % 23 == 7, F.concat(F.lit('{"receiptId": '), F.col("receipt_id"))).otherwise(F.to_json("r"))
    copies = F.explode(F.sequence(F.lit(0), (F.col("receipt_id") % 9 == 4).cast("int")))
    rows.select(line.alias("value"), copies.alias("copy")).repartition(4, "copy", "value").select("value").write.text(path)
    return summarize(read_receipts(spark, path, whole=False))


@query(S.given("obs", f"""{_PAIRED.replace("WHEN any_error THEN 'error' WHEN lift", "WHEN any_error THEN 'error' WHEN receipt_id % 10 = 3 THEN 'inconclusive' WHEN lift")}, {_SKILLS}, {_ENTRIES},
rd AS (SELECT name, min(ord) AS ord FROM en WHERE status = 'pilot-ready' GROUP BY 1),
jn AS (SELECT ks.*, CASE WHEN rd.name IS NULL OR rd.ord % 15 = 4 THEN 1 WHEN rd.ord % 6 = 1 OR ks.files <> 1 + ord % 2 THEN 2 WHEN rd.ord % 10 = 3 THEN 3 END AS fault, rd.ord AS a FROM ks LEFT JOIN rd ON rd.name = ks.name),
ag AS (SELECT receipt_id, count(*) AS n, count(DISTINCT lower(name)) AS names, arg_min(fault, i) FILTER (WHERE fault IS NOT NULL) AS fault, string_agg('sa_' || a, '|' ORDER BY i) AS ids FROM jn GROUP BY 1),
al AS (SELECT po.receipt_id, NOT any_error AND receipt_id % 10 <> 3 AND proposed_rate / 100 >= 0.8 AND outcome IN ('improved', 'unchanged') AS good, coalesce(n, 0) AS n, names, fault, ids FROM po LEFT JOIN ag USING (receipt_id)),
rs AS (SELECT *, CASE WHEN NOT good THEN 'result is not eligible' WHEN n NOT BETWEEN 1 AND 3 THEN 'setup must contain 1 to 3 skills' WHEN names < n THEN 'duplicate skill' WHEN fault = 1 THEN 'no embedded artifact' WHEN fault = 2 THEN 'identity differs' WHEN fault = 3 THEN 'assessment differs' END AS reason FROM al)
---
SELECT receipt_id, reason, CASE WHEN reason IS NULL THEN ids END AS artifact_ids FROM rs"""))
def job_capsule_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which receipts can be shared as exact catalog setups, and why others cannot."""
    k = F.col("ord")
    ready = _entries(spark, sf_dir).filter("status = 'pilot-ready'").groupBy("name").agg(F.min("ord").alias("ord"))
    artifacts = ready.select(
        "name", F.concat(F.lit("sa_"), k).alias("artifact_id"), F.when(k % 15 == 4, "revoked").otherwise("embedded").alias("availability"), F.sha2(F.when(k % 6 == 1, F.lit("other")).otherwise(F.col("name")), 256).alias("verification_sha"), (1 + k % 2).alias("files"),
        F.when(k % 10 == 3, "B").otherwise("A").alias("grade"), F.lit("pass").alias("gate"), F.lit("low").alias("risk"),
    )
    rows = cut(_nested_receipts(spark, sf_dir), "receipts")
    found = I.bridge(rows.select("r"), artifacts)
    ids = rows.select("receipt_id", F.col("r")["receiptId"].alias("receiptId"))
    return ids.join(found, "receiptId").select("receipt_id", "reason", F.array_join("artifact_ids", "|").alias("artifact_ids"))


def _artifact(name: Column, total: Column) -> Column:
    """An artifact of the catalog, in the form that shared setups have."""
    return F.struct(
        name.alias("name"), F.concat(F.lit("sa_"), F.left(F.sha2(name, 256), F.lit(32))).alias("artifactId"), *[F.sha2(F.concat(name, F.lit(x)), 256).alias(f"{x}Sha256") for x in ("verification", "bundle", "payload")], F.lit(2).cast("long").alias("files"), total.cast("long").alias("totalBytes"),
        F.struct(F.lit("acme/skills").alias("repository"), F.sha1(name).alias("commit"), F.sha1(F.concat(name, F.lit("t"))).alias("rootTreeOid"), F.concat(F.lit("skills/"), name).alias("rootPath"), F.concat(F.lit("https://github.com/acme/skills/tree/"), F.sha1(name), F.lit("/skills/"), name).alias("pinnedUrl")).alias("source"),
        F.struct(F.lit("A").alias("grade"), F.lit("pass").alias("gate"), F.lit("low").alias("risk"), F.lit("static/1").alias("rubricVersion"), F.lit("SMV:2.0").alias("vector"), F.lit(0).cast("long").alias("uninterpretedFiles")).alias("assessment"),
        F.struct(F.lit("MIT").alias("spdx"), F.sha2(F.lit("MIT"), 256).alias("sha256"), F.lit("LICENSE").alias("installPath")).alias("license"), F.lit("inspected-exact-version").alias("evidence"), F.array(F.lit("As inspected.")).alias("limitations"),
    )


@query(S.given("obs", f"""{_PAIRED.replace("WHEN any_error THEN 'error' WHEN lift", "WHEN any_error THEN 'error' WHEN receipt_id % 10 = 3 THEN 'inconclusive' WHEN lift")},
c AS (SELECT receipt_id AS k, NOT any_error AND receipt_id % 10 <> 3 AND proposed_rate / 100 >= 0.8 AND outcome IN ('improved', 'unchanged') AS good, list_transform(range(0, receipt_id % 5), lambda i: (receipt_id * 3 + i * 7) % 200) AS xs FROM po WHERE receipt_id % 5 BETWEEN 1 AND 3),
f AS (SELECT *, list_filter([CASE WHEN k % 6 = 1 THEN 'capsule contains missing or unknown top-level fields' END, CASE WHEN k % 9 = 4 THEN 'setup projection is invalid' END, CASE WHEN NOT good THEN 'sender evidence projection is invalid' END], lambda e: e IS NOT NULL) AS form FROM c)
---
SELECT k AS receipt_id, array_to_string(CASE WHEN len(form) > 0 THEN form ELSE list_concat(list_filter([CASE WHEN k % 7 = 2 OR k % 8 = 3 THEN 'capsuleId does not match canonical content' END, CASE WHEN k % 7 = 2 OR k % 8 = 3 THEN 'capsule integrity does not match canonical content' END, CASE WHEN k % 8 = 3 AND len(xs) > 1 THEN 'replay artifact order differs from setup order' END], lambda e: e IS NOT NULL),
 CASE WHEN k % 3 <> 0 THEN list_filter(list_transform(xs, lambda x: CASE WHEN x % 10 = 7 THEN 'artifact is unavailable in this catalog: kit-' || x WHEN x % 10 = 3 THEN 'artifact projection differs from this catalog: kit-' || x END), lambda e: e IS NOT NULL) ELSE [] END) END, '; ') AS errors, len(form) = 0 AND k % 3 <> 0 AS compatible FROM f"""))
def job_capsule_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared setup records checked: closed form, ids and digests by content, the result's arithmetic, and their artifacts against the catalog; some are tampered with."""
    k, r = F.col("receipt_id"), F.col("r")
    rows = _nested_receipts(spark, sf_dir).filter(k % 5 >= 1).filter(k % 5 <= 3)
    arts = F.transform(F.slice(F.array(F.lit(0), F.lit(1), F.lit(2)), F.lit(1), (k % 5).cast("int")), lambda i: _artifact(F.concat(F.lit("kit-"), (k * 3 + i * 7) % 200), F.lit(900)))
    ids = lambda a: F.transform(a, lambda x: x["artifactId"])
    sha = F.sha2(F.when(k % 3 == 0, "old").otherwise("now"), 256)
    body = F.struct(
        F.lit("capsule-1").alias("protocolVersion"), F.lit("").alias("capsuleId"), r["completedAt"].alias("createdAt"), F.struct(F.lit("catalog-2").alias("catalogProtocolVersion"), F.lit("1.0.0").alias("cliVersion"), sha.alias("catalogSha256"), I.setup_sha(arts).alias("setupSha256"), arts.alias("orderedArtifacts")).alias("setup"),
        F.struct(r["protocolVersion"].alias("verificationProtocolVersion"), r["integrity"]["payloadSha256"].alias("sourceReceiptPayloadSha256"), *[r["suite"][a].alias(b) for a, b in (("sha256", "suiteSha256"), ("verifierSha256", "verifierSha256"), ("goalSha256", "goalSha256"))], r["environment"]["sha256"].alias("environmentSha256"),
            F.lit("local-self-attested").alias("attestation"), F.lit("none").alias("authentication"), F.lit("receipt-schema-ledger-and-integrity-only").alias("localValidation"), r["result"].alias("result")).alias("senderEvidence"),
        F.struct(F.lit("exact-catalog-artifacts").alias("setup"), F.lit("unavailable-private-suite").alias("experiment"), ids(arts).alias("artifactIds")).alias("replay"), F.array(F.lit("As sent.")).alias("limitations"), F.struct(F.lit("sha256").alias("algorithm"), F.lit("").alias("payloadSha256")).alias("integrity"),
    )
    rows = cut(rows.select("receipt_id", body.alias("c")), "capsule-bodies")
    rows = cut(rows.select("receipt_id", F.col("c").withField("capsuleId", I.capsule_id(F.col("c"))).alias("c")), "capsule-named")
    rows = rows.select("receipt_id", F.col("c").withField("integrity.payloadSha256", I.capsule_payload_sha(F.col("c"))).alias("c"))
    c = F.col("c")
    changed = F.when(k % 8 == 3, c.withField("replay.artifactIds", F.reverse(c["replay"]["artifactIds"]))).otherwise(c)
    changed = F.when(k % 7 == 2, changed.withField("capsuleId", F.lit("sc_" + "0" * 32))).otherwise(F.when(k % 8 == 3, changed.withField("limitations", F.array(F.lit("Another.")))).otherwise(changed))
    text = F.to_json(changed)
    text = F.when(k % 9 == 4, F.replace(text, F.lit('"repository":'), F.lit('"branch":"main","repository":'))).otherwise(text)
    text = F.when(k % 6 == 1, F.replace(text, F.lit('{"protocolVersion"'), F.lit('{"extra":1,"protocolVersion"'))).otherwise(text)
    names = spark.range(200).filter("id % 10 <> 7").withColumn("name", F.concat(F.lit("kit-"), "id"))
    index = names.select("name", _artifact(F.col("name"), F.when(F.col("id") % 10 == 3, 901).otherwise(900)).alias("artifact"))
    now = {"catalogProtocolVersion": "catalog-2", "cliVersion": "1.0.0"}
    found = I.audit_capsules(rows.select("receipt_id", text.alias("capsule")), index, now | {"catalogSha256": hashlib.sha256(b"now").hexdigest()})
    return found.select("receipt_id", F.array_join("errors", "; ").alias("errors"), "compatible")


@query(S.given("mf", """g AS (SELECT bundle_id, count(*) AS files, sum(size) AS total, max(size) AS largest, max(len(string_split(path, '/'))) AS depth, 'Kit' || (bundle_id // 2) AS kit FROM mf GROUP BY 1),
h AS (SELECT *, CASE WHEN bundle_id % 2 = 0 THEN kit ELSE lower(kit) END AS name FROM g), i AS (SELECT *, count(*) OVER (PARTITION BY lower(name)) AS twins FROM h)
---
SELECT bundle_id, array_to_string(list_filter([CASE WHEN files > 4 THEN 'files' END, CASE WHEN total > 15000 THEN 'bytes' END, CASE WHEN largest > 4900 THEN 'file' END, CASE WHEN depth > 8 THEN 'depth' END, CASE WHEN bundle_id % 11 = 2 THEN 'identity' END, CASE WHEN bundle_id % 7 = 3 OR bundle_id % 13 = 4 OR bundle_id % 17 = 5 THEN 'trust' END,
 CASE WHEN twins > 1 THEN 'collision' END, CASE WHEN bundle_id % 10 = 5 THEN 'target' END], lambda x: x IS NOT NULL), '|') AS reasons, CASE WHEN bundle_id % 5 = 0 AND bundle_id % 10 <> 5 THEN 'replace' ELSE 'add' END AS action FROM i"""))
def job_install_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which bundles may be installed, under tight bounds, and why not; every fifth has its name taken at the target, half of these in another case."""
    mf = adapters.manifests_from_lineitem(table(spark, sf_dir, "lineitem"))
    ids, k = mf.select("bundle_id").distinct(), F.col("bundle_id")
    kit = F.concat(F.lit("Kit"), F.expr("bundle_id div 2"))
    name = F.when(k % 2 == 0, kit).otherwise(F.lower(kit))
    named = ids.select(
        "bundle_id", name.alias("name"), F.when(k % 11 == 2, "another").otherwise(name).alias("declared"), F.when(k % 7 == 3, "C").otherwise("B").alias("grade"), F.when(k % 13 == 4, "review").otherwise("pass").alias("gate"), F.when(k % 17 == 5, "medium").otherwise("low").alias("risk")
    )
    target = ids.filter("bundle_id % 5 = 0").select("bundle_id", F.when(k % 10 == 5, F.upper(name)).otherwise(name).alias("installed"))
    return K.install_gate(mf, named, target, max_files=4, max_total=15_000, max_file=4_900)
