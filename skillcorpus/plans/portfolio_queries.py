"""Queries over portfolios of skills."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skillcorpus.functions import rules as R
from skillcorpus.functions import text as T
from skillcorpus.operators import analysis as A
from skillcorpus.operators import portfolio as P
from skillcorpus.operators.ranks import ranked
from skillcorpus.operators.reports import harden, labels, published
from skillcorpus.plans import sql as S
from skillcorpus.plans.inputs import analysed
from skillcorpus.plans.registry import query
from skillcorpus.plans.storage import cut, shared_folder
from skillcorpus.sources import adapters
from skillcorpus.sources.files import read_scan, write_scan
from skillcorpus.sources.tables import table


def _described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skills with their own names and descriptions."""
    return A.parse(adapters.skills(spark, sf_dir)).select("portfolio_id", "skill_ord", F.col("fm_name").alias("name"), "description", "source", "text")


_TOKENS = f"""tk0 AS (SELECT portfolio_id, skill_ord, fm_name AS name, {S.matches("description", R.BROAD)} AS broad, {S.trigger_tokens("description")} AS tokens FROM pf WHERE {S.trimmed("description")} <> ''),
tkn AS (SELECT portfolio_id, count(*) AS n FROM tk0 GROUP BY 1),
tke AS (SELECT portfolio_id, skill_ord, unnest(tokens) AS token FROM tk0),
tkd AS (SELECT portfolio_id, token, count(*) AS df FROM tke GROUP BY 1, 2),
tk AS (SELECT portfolio_id, skill_ord, token FROM tke JOIN tkd USING (portfolio_id, token) JOIN tkn USING (portfolio_id) WHERE n < 6 OR df <= n // 2),
sz AS (SELECT portfolio_id, skill_ord, count(*) AS m FROM tk GROUP BY 1, 2)"""
_CONFLICTS = f"""{_TOKENS},
pr AS (SELECT x.portfolio_id, x.skill_ord AS a, y.skill_ord AS b, count(*) AS n_shared, list_sort(list(x.token)) AS shared FROM tk x JOIN tk y ON x.portfolio_id = y.portfolio_id AND x.token = y.token AND x.skill_ord < y.skill_ord GROUP BY 1, 2, 3),
pj AS (SELECT pr.*, n_shared / (sa.m + sb.m - n_shared)::DOUBLE AS j, ka.broad OR kb.broad AS broad FROM pr JOIN sz sa ON sa.portfolio_id = pr.portfolio_id AND sa.skill_ord = a JOIN sz sb ON sb.portfolio_id = pr.portfolio_id AND sb.skill_ord = b
  JOIN tk0 ka ON ka.portfolio_id = pr.portfolio_id AND ka.skill_ord = a JOIN tk0 kb ON kb.portfolio_id = pr.portfolio_id AND kb.skill_ord = b WHERE ka.name <> kb.name),
cf AS (SELECT *, CASE WHEN kind = 'shadow' AND j >= 0.4 OR kind = 'overlap' AND j >= 0.55 THEN 'high' ELSE 'medium' END AS severity FROM (SELECT *, CASE WHEN broad AND (j >= 0.16 OR n_shared >= 3) THEN 'shadow' WHEN j >= 0.34 AND n_shared >= 2 THEN 'overlap' END AS kind FROM pj) WHERE kind IS NOT NULL)"""


@query(S.given("pf", f"{_CONFLICTS}\n---\nSELECT portfolio_id, a, b, kind, severity, n_shared::INT AS n_shared, array_to_string(shared, '|') AS shared FROM cf"))
def conflict_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of skills that fight for the same requests."""
    return P.conflict_pairs(_described(spark, sf_dir)).drop("jaccard")


@query(S.given("pf", f"{_CONFLICTS}\n---\nSELECT portfolio_id, a, b, kind, severity, place FROM (SELECT *, row_number() OVER (PARTITION BY portfolio_id ORDER BY severity = 'high' DESC, n_shared DESC, a, b) AS place FROM cf) WHERE place <= 6"))
def rank_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six worst conflicts of each portfolio: by severity, then by shared tokens."""
    return P.worst_conflicts(_described(spark, sf_dir), 6).drop("n_shared")


@query(S.given("pf", f"{_TOKENS}\n---\nSELECT portfolio_id, token, df FROM tkd"))
def token_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many skills of a portfolio each trigger token occurs."""
    rows = _described(spark, sf_dir).select("portfolio_id", F.explode(T.trigger_tokens(F.col("description"))).alias("token"))
    return rows.groupBy("portfolio_id", "token").agg(F.count(F.lit(1)).alias("df"))


_HOSTS = f"list_filter(list_distinct(list_transform(regexp_extract_all(text, {S.sql_text(R.URL_HOST)}, 1), lambda h: lower(h))), lambda h: NOT {S.matches('h', R.WELL_KNOWN)})"
_FRAGS = f"list_distinct(list_transform(list_filter(list_transform(flatten(list_transform(regexp_extract_all(text, '```[\\s\\S]*?```'), lambda f: string_split(f, chr(10)))), lambda x: trim(x)), lambda x: length(x) >= 40 AND NOT starts_with(x, '```') AND NOT starts_with(x, '#') AND {S.matches('x', R.COMMAND_LINE)}), lambda x: regexp_replace(x, '\\s+', ' ', 'g')))"


def _pairs_sql(values: str) -> str:
    return f"e AS (SELECT portfolio_id, skill_ord, unnest({values}) AS value FROM pf)\n---\nSELECT x.portfolio_id, x.skill_ord AS a, y.skill_ord AS b, array_to_string(list_sort(list(x.value)), '|') AS shared FROM e x JOIN e y ON x.portfolio_id = y.portfolio_id AND x.value = y.value AND x.skill_ord < y.skill_ord GROUP BY 1, 2, 3"


@query(S.given("pf", _pairs_sql(_HOSTS)))
def shared_host_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of skills that reach one third-party host."""
    return P.shared_pairs(_described(spark, sf_dir), P.hosts(F.col("text"))).withColumn("shared", F.array_join("shared", "|"))


@query(S.given("pf", _pairs_sql(_FRAGS)))
def shared_fragment_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of skills with one distinctive command in common."""
    return P.shared_pairs(_described(spark, sf_dir), P.fragments(F.col("text"))).withColumn("shared", F.array_join("shared", "|"))


@query(S.given("pf", f"e AS (SELECT portfolio_id, skill_ord, unnest({_HOSTS}) AS value FROM pf)\n---\nSELECT portfolio_id, value, count(*) AS n_skills, min(skill_ord) AS first, (count(*) * (count(*) - 1)) // 2 AS n_pairs FROM e GROUP BY 1, 2 HAVING count(*) > 1"))
def shared_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts that several skills of a portfolio reach, one row each."""
    return P.shared_values(_described(spark, sf_dir), P.hosts(F.col("text")))


@query(S.given("pf", f"s AS (SELECT portfolio_id, {S.matches('text', R.READS_SECRET)} AS r, {S.matches('text', R.SENDS)} AS s FROM pf)\n---\nSELECT portfolio_id, count(*) FILTER (WHERE r AND NOT s) AS n_sources, count(*) FILTER (WHERE s AND NOT r) AS n_sinks, count(*) FILTER (WHERE r AND NOT s) * count(*) FILTER (WHERE s AND NOT r) AS n_pairs FROM s GROUP BY 1 HAVING n_pairs > 0"))
def relay_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pairs of a portfolio split reading secrets and sending between them."""
    return P.relay_counts(_described(spark, sf_dir), F.col("text"))


@query(S.given("pf", f"s AS (SELECT portfolio_id, skill_ord, {S.matches('text', R.READS_SECRET)} AS r, {S.matches('text', R.SENDS)} AS s FROM pf), m AS (SELECT portfolio_id, skill_ord, CASE WHEN r THEN 'source' ELSE 'sink' END AS role FROM s WHERE r <> s)\n---\nSELECT portfolio_id, skill_ord, role FROM m WHERE portfolio_id IN (SELECT portfolio_id FROM m GROUP BY 1 HAVING count(DISTINCT role) = 2)"))
def relay_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relays by membership: every source of a portfolio is linked with each of its sinks."""
    return P.relay_members(_described(spark, sf_dir), F.col("text"))


@query(S.given("pf", f"e AS (SELECT portfolio_id, skill_ord, unnest({_FRAGS}) AS value FROM pf), n AS (SELECT portfolio_id, value, count(*) AS n_skills, min(skill_ord) AS first FROM e GROUP BY 1, 2 HAVING count(*) > 1)\n---\nSELECT portfolio_id, md5(value) AS value_md5, skill_ord, n_skills, first FROM e JOIN n USING (portfolio_id, value)"))
def fragment_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who shares a distinctive command: one row per skill and command, any two of a command being linked."""
    rows = P.sharing_members(_described(spark, sf_dir), P.fragments(F.col("text")))
    return rows.select("portfolio_id", F.md5("value").alias("value_md5"), "skill_ord", "n_skills", "first")


_BLOAT = """bm AS (SELECT portfolio_id, tokens_total AS median FROM (SELECT *, row_number() OVER (PARTITION BY portfolio_id ORDER BY tokens_total, skill_ord) AS i, count(*) OVER (PARTITION BY portfolio_id) AS n FROM an) WHERE i = n // 2 + 1),
bl AS (SELECT *, complete AND (gate = 'block' OR grade = 'F' OR level IN ('high', 'critical')) AS unsafe, greatest(floor(median * 1.6::DOUBLE + 0.5)::BIGINT, 350) AS threshold, complete AND tokens_total > greatest(floor(median * 1.6::DOUBLE + 0.5), 350) AS bloated,
  CASE WHEN median > 0 THEN round(tokens_total / median::DOUBLE, 3) ELSE 1 END AS ratio FROM an JOIN bm USING (portfolio_id)),
bb AS (SELECT *, NOT unsafe AND (NOT complete OR gate = 'review' OR level = 'medium') AS review FROM bl)"""


@query(S.given("an", f"{_BLOAT}\n---\nSELECT portfolio_id, skill_ord, median, threshold, bloated, ratio FROM bb"))
def portfolio_median_bloat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each skill's size against the upper median of its portfolio."""
    return P.bloat(analysed(spark, sf_dir)).select("portfolio_id", "skill_ord", "median", "threshold", "bloated", "ratio")


_SUMMARY = "count(*) AS total, count(*) FILTER (WHERE unsafe) AS unsafe, count(*) FILTER (WHERE review) AS review, count(*) FILTER (WHERE bloated) AS bloated, count(*) FILTER (WHERE NOT complete) AS incomplete, count(*) FILTER (WHERE complete AND NOT unsafe AND NOT review AND NOT bloated) AS ok"


@query(S.given("an", f"{_BLOAT}\n---\nSELECT portfolio_id, source_name AS source, {_SUMMARY} FROM bb GROUP BY GROUPING SETS ((portfolio_id, source_name), (portfolio_id), ())"))
def scan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a scan by portfolio and source, by portfolio, and over all."""
    rows = P.bloat(analysed(spark, sf_dir))
    n = lambda c: F.count_if(F.expr(c))
    return rows.groupingSets([["portfolio_id", "source"], ["portfolio_id"], []], "portfolio_id", "source").agg(
        F.count(F.lit(1)).alias("total"), n("unsafe").alias("unsafe"), n("review").alias("review"), n("bloated").alias("bloated"), n("not complete").alias("incomplete"), n("complete and not unsafe and not review and not bloated").alias("ok")
    )


@query(S.given("an", f"SELECT category, severity, {S.kind('severity', 'category')} AS kind, count(*) AS n FROM fr GROUP BY ALL"))
def finding_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk findings by category, severity and kind."""
    rows = analysed(spark, sf_dir).select(F.inline(F.concat("risk_findings", "notes")))
    return rows.groupBy("category", "severity", A.finding_kind(F.col("severity"), F.col("category")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


_LISTED = f"""l0 AS (SELECT portfolio_id, skill_ord, CASE WHEN source_name ILIKE '%codex%' THEN 'codex' ELSE 'claude-code' END AS harness, fm_name AS name, description FROM pf),
l1 AS (SELECT *, {S.listing("(name || chr(32) || description)")} + 4 AS cost, CASE WHEN harness = 'claude-code' THEN {S.listing("name")} + 4 ELSE 0 END AS bare, harness = 'claude-code' AND length(description) > 1536 AS long FROM l0),
l2 AS (SELECT *, sum(cost) OVER (PARTITION BY portfolio_id, harness) - coalesce(sum(cost - bare) OVER (PARTITION BY portfolio_id, harness ORDER BY cost DESC, skill_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 2000 AS goes FROM l1),
ls AS (SELECT portfolio_id, harness, count(*) AS n_skills, sum(cost)::BIGINT AS tokens, count(*) FILTER (WHERE goes) AS n_dropped, count(*) FILTER (WHERE long) AS n_over_long FROM l2 GROUP BY 1, 2)"""


@query(S.given("pf", f"{_LISTED}\n---\nSELECT *, 2000 AS budget, greatest(0, tokens - 2000) AS over_by, floor(2000 / (tokens / n_skills::DOUBLE))::BIGINT AS cliff, round(tokens / 2000::DOUBLE, 3) AS ratio FROM ls"))
def listing_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing cost against budget, by portfolio and harness."""
    return P.listings(_described(spark, sf_dir))


@query(S.given("pf", f"{_LISTED}\n---\nSELECT portfolio_id, harness, n_dropped FROM ls"))
def listing_drop_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many entries lose their description."""
    return P.listings(_described(spark, sf_dir)).select("portfolio_id", "harness", "n_dropped")


@query(S.given("ax", f"{_LISTED}, t AS (SELECT portfolio_id, sum(tokens_desc + 8)::BIGINT AS described FROM ax GROUP BY 1)\n---\nSELECT portfolio_id, max(tokens) AS always_on, any_value(described) AS described FROM ls JOIN t USING (portfolio_id) GROUP BY 1"))
def always_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standing cost of a portfolio: its largest listing, and the sum over descriptions."""
    rows = _described(spark, sf_dir)
    desc = rows.groupBy("portfolio_id").agg(F.sum(T.estimate_tokens(F.col("description")) + 8).alias("described"))
    return P.listings(rows).groupBy("portfolio_id").agg(F.max("tokens").alias("always_on")).join(desc, "portfolio_id")


@query(S.given("pf", f"{_LISTED}\n---\nSELECT portfolio_id, arg_max(harness, (tokens, harness)) AS harness FROM ls GROUP BY 1"))
def tightest_harness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The harness whose listing is fullest."""
    return P.listings(_described(spark, sf_dir)).groupBy("portfolio_id").agg(F.max_by("harness", F.struct("tokens", "harness")).alias("harness"))


_SIX = """SELECT skill_ord, 'grade' AS field, grade AS value, CASE WHEN grade IN ('A', 'B') THEN 'ok' WHEN grade = 'C' THEN 'warn' ELSE 'bad' END AS state FROM an
UNION ALL SELECT skill_ord, 'gate', gate, CASE gate WHEN 'pass' THEN 'ok' WHEN 'review' THEN 'warn' ELSE 'bad' END FROM an
UNION ALL SELECT skill_ord, 'tokens', (tokens_desc + 8) || '/' || tokens_body, CASE WHEN tokens_body > 5000 THEN 'warn' ELSE 'ok' END FROM an
UNION ALL SELECT an.skill_ord, 'evidence', coalesce(n, 0)::VARCHAR, CASE WHEN coalesce(n, 0) = 0 THEN 'ok' WHEN crit THEN 'bad' ELSE 'warn' END
 FROM an LEFT JOIN (SELECT skill_ord, count(*) FILTER (WHERE severity <> 'low' AND category IN ('injection', 'persistence', 'obfuscation', 'exfil', 'shell', 'secret', 'network', 'privilege', 'install', 'filesystem')) AS n, bool_or(severity = 'critical') AS crit FROM fr GROUP BY skill_ord) USING (skill_ord)
UNION ALL SELECT skill_ord, 'trigger', trigger || '/100', CASE WHEN trigger >= 85 THEN 'ok' WHEN trigger >= 60 THEN 'warn' ELSE 'bad' END FROM an
UNION ALL SELECT skill_ord, 'conflict', CASE WHEN coalesce(sk_n, 0) < 2 THEN 'Needs ≥2 skills' WHEN coalesce(total, 0) = 0 THEN 'None' ELSE total || ' pair' || CASE WHEN total > 1 THEN 's' ELSE '' END || ' (' || shadow || ' shadow · ' || (total - shadow) || ' overlap)' END,
 CASE WHEN coalesce(sk_n, 0) < 2 THEN 'unknown' WHEN coalesce(total, 0) = 0 THEN 'ok' WHEN shadow > 0 THEN 'bad' ELSE 'warn' END FROM an LEFT JOIN (SELECT portfolio_id, count(*) AS sk_n FROM an GROUP BY 1) USING (portfolio_id) LEFT JOIN (SELECT portfolio_id, count(*) AS total, count(*) FILTER (WHERE kind = 'shadow') AS shadow FROM cf GROUP BY 1) USING (portfolio_id)"""


@query(S.given("an pf", f"{_CONFLICTS}\n---\n{_SIX}"))
def six_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six results per skill, each with a state; the conflicts are those of its portfolio, and unknown where it is the only skill."""
    risky = F.size(F.filter("findings", lambda f: (f["severity"] != "low") & f["category"].isin("injection", "persistence", "obfuscation", "exfil", "shell", "secret", "network", "privilege", "install", "filesystem")))
    critical = F.exists("findings", lambda f: f["severity"] == "critical")
    many = F.concat(F.col("total"), F.when(F.col("total") > 1, " pairs (").otherwise(" pair ("), F.col("shadow"), F.lit(" shadow · "), F.col("total") - F.col("shadow"), F.lit(" overlap)"))
    shown = F.when(F.col("n") < 2, "Needs ≥2 skills").when(F.col("total") == 0, "None").otherwise(many)
    row = lambda name, value, state: F.struct(F.lit(name).alias("field"), value.cast("string").alias("value"), state.alias("state"))
    fields = F.array(
        row("grade", F.col("grade"), F.when(F.col("grade").isin("A", "B"), "ok").when(F.col("grade") == "C", "warn").otherwise("bad")),
        row("gate", F.col("gate"), F.when(F.col("gate") == "pass", "ok").when(F.col("gate") == "review", "warn").otherwise("bad")),
        row("tokens", F.concat_ws("/", F.col("tokens_desc") + 8, "tokens_body"), F.when(F.col("tokens_body") > 5000, "warn").otherwise("ok")),
        row("evidence", risky, F.when(risky == 0, "ok").when(critical, "bad").otherwise("warn")),
        row("trigger", F.concat(F.col("trigger"), F.lit("/100")), F.when(F.col("trigger") >= 85, "ok").when(F.col("trigger") >= 60, "warn").otherwise("bad")),
        row("conflict", shown, F.when(F.col("n") < 2, "unknown").when(F.col("total") == 0, "ok").when(F.col("shadow") > 0, "bad").otherwise("warn")),
    )
    graded = analysed(spark, sf_dir)
    pairs = P.conflict_pairs(graded.select("portfolio_id", "skill_ord", F.col("fm_name").alias("name"), "description"), words=False)
    pairs = pairs.groupBy("portfolio_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("kind") == "shadow").alias("shadow"))
    sets = cut(graded.groupBy("portfolio_id").agg(F.count(F.lit(1)).alias("n")).join(pairs, "portfolio_id", "left").na.fill(0, ["total", "shadow"]), "conflict-counts")
    return graded.join(sets, "portfolio_id", "left").select("skill_ord", F.inline(fields))


_RANK = "CASE WHEN unsafe THEN 0 WHEN review THEN 1 WHEN bloated THEN 2 ELSE 3 END"


@query(S.given("an", f"{_BLOAT}\n---\nSELECT portfolio_id, skill_ord, {_RANK} AS class, row_number() OVER (PARTITION BY portfolio_id ORDER BY {_RANK}, tokens_total DESC, skill_ord) AS place FROM bb"))
def rank_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skills of a portfolio, worst first, then largest."""
    rows = cut(P.bloat(analysed(spark, sf_dir)).select("portfolio_id", "skill_ord", "tokens_total", F.expr(_RANK).alias("class")), "classes")
    return ranked(rows, ["portfolio_id"], [F.col("class"), -F.col("tokens_total"), F.col("skill_ord")]).select("portfolio_id", "skill_ord", "class", F.col("rank").alias("place"))


@query(S.given("an", "SELECT skill_ord, CASE WHEN m <= 0 THEN NULL WHEN d1 = m THEN 'structure' WHEN d2 = m THEN 'trigger' WHEN d3 = m THEN 'tokens' ELSE 'risk' END AS limiter FROM (SELECT skill_ord, d1, d2, d3, greatest(d1, d2, d3, d4) AS m FROM (SELECT skill_ord, 0.25::DOUBLE * greatest(0, 85 - structure) AS d1, 0.45::DOUBLE * greatest(0, 85 - trigger) AS d2, 0.3::DOUBLE * greatest(0, 85 - tokens) AS d3, 1.0::DOUBLE * greatest(0, 85 - risk) AS d4 FROM an))"))
def limiter_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The axis that costs a skill most."""
    d = {"structure": 0.25, "trigger": 0.45, "tokens": 0.3, "risk": 1.0}
    lost = {k: F.lit(w) * F.greatest(F.lit(0), 85 - F.col(k)) for k, w in d.items()}
    most = F.greatest(*lost.values())
    out = F.when(most <= 0, F.lit(None))
    for k, c in lost.items():
        out = out.when(c == most, k)
    return analysed(spark, sf_dir).select("skill_ord", out.alias("limiter"))


@query(S.given("an", f"{_BLOAT}, lb AS (SELECT *, row_number() OVER (PARTITION BY portfolio_id ORDER BY skill_ord) AS i FROM bb)\n---\nSELECT portfolio_id, skill_ord, 'skill-' || max(i) OVER (PARTITION BY portfolio_id, fm_name) AS label FROM lb"))
def ordinal_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anonymous labels of skills; a name that occurs twice has the label of its last row."""
    return labels(analysed(spark, sf_dir)).select("portfolio_id", "skill_ord", "label")


_REASON = "CASE WHEN unsafe THEN 'unsafe' WHEN review THEN 'review' WHEN bloated THEN 'bloated' ELSE 'clean' END"


@query(S.given("af", f"""{_BLOAT}, {_CONFLICTS}, lb0 AS (SELECT *, row_number() OVER (PARTITION BY portfolio_id ORDER BY skill_ord) AS i FROM bb), lb AS (SELECT *, 'skill-' || max(i) OVER (PARTITION BY portfolio_id, fm_name) AS label FROM lb0),
fl AS (SELECT skill_ord, string_agg(severity || ':' || category, '|' ORDER BY severity || ':' || category) AS findings FROM af GROUP BY 1)
---
SELECT portfolio_id, 'skill' AS part, label, NULL AS other, NULL AS kind, NULL AS severity, tokens_total, CASE WHEN complete THEN grade ELSE '?' END AS grade, unsafe, review, bloated, ratio, {_REASON} AS reason, coalesce(findings, '') AS findings FROM lb LEFT JOIN fl USING (skill_ord)
UNION ALL SELECT cf.portfolio_id, 'conflict', x.label, y.label, kind, severity, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM cf JOIN lb x ON x.portfolio_id = cf.portfolio_id AND x.skill_ord = a JOIN lb y ON y.portfolio_id = cf.portfolio_id AND y.skill_ord = b
UNION ALL SELECT portfolio_id, 'broad', label, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM lb WHERE {S.matches("description", R.BROAD)}"""))
def sink_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The anonymous report: labels and verdicts of skills, conflicts and broad skills; no names, paths or texts."""
    rows = P.bloat(analysed(spark, sf_dir)).withColumn("broad", A.hit(F.col("description"), R.BROAD))
    return published(rows, P.conflict_pairs(_described(spark, sf_dir), words=False), F.expr(_REASON))


@query(S.given("an", f"{_BLOAT}\n---\nSELECT portfolio_id, skill_ord, fm_name AS name, CASE WHEN complete THEN grade ELSE '?' END AS grade, CASE WHEN complete THEN score END AS score, tokens_total, CASE WHEN complete THEN level ELSE 'unknown' END AS level, {_REASON} AS reason FROM bb"))
def job_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan's skill table, as it is written out."""
    rows, done = P.bloat(analysed(spark, sf_dir)), F.col("complete")
    return rows.select(
        "portfolio_id", "skill_ord", F.col("fm_name").alias("name"), F.when(done, F.col("grade")).otherwise("?").alias("grade"), F.when(done, F.col("score")).alias("score"), "tokens_total",
        F.when(done, F.col("level")).otherwise("unknown").alias("level"), F.expr(_REASON).alias("reason"),
    )


@query(S.given("an", f"""{_BLOAT}, {_CONFLICTS}, {_LISTED},
he AS (SELECT portfolio_id, unnest({_HOSTS}) AS value FROM pf), hv AS (SELECT portfolio_id, value FROM he GROUP BY 1, 2 HAVING count(*) > 1),
js AS (SELECT portfolio_id, 'skills' AS part, {_REASON} || ':' || CASE WHEN complete THEN grade ELSE '?' END AS kind, tokens_total AS amount FROM bb UNION ALL SELECT portfolio_id, 'conflicts', kind || ':' || severity, n_shared FROM cf
 UNION ALL SELECT portfolio_id, 'listings', harness, tokens FROM ls UNION ALL SELECT portfolio_id, 'hosts', value, 1 FROM hv)
---
SELECT portfolio_id, part, kind, count(*) AS n, sum(amount)::BIGINT AS amount FROM js GROUP BY 1, 2, 3"""))
def sink_scan_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes a scan (skills, conflicts, listings, shared hosts) as JSON datasets in a folder per portfolio, reads them back and counts."""
    rows, described, done = P.bloat(analysed(spark, sf_dir)), _described(spark, sf_dir), F.col("complete")
    skills = rows.select(
        "portfolio_id", "skill_ord", F.col("fm_name").alias("name"), "path", "source", "tokens_total", "unsafe", "review", "bloated", "ratio", "median", "threshold", "findings", F.when(done, F.col("grade")).otherwise("?").alias("grade"),
        F.when(done, F.col("score")).alias("score"), F.when(done, F.col("level")).otherwise("unknown").alias("level"), F.expr(_REASON).alias("reason"),
    )
    conflicts = P.conflict_pairs(described)
    parts = {"skills": skills, "conflicts": conflicts, "listings": P.listings(described), "hosts": P.shared_values(described, P.hosts(F.col("text")))}
    kinds = {"skills": ("concat(reason, ':', grade)", "tokens_total"), "conflicts": ("concat(kind, ':', severity)", "n_shared"), "listings": ("harness", "tokens"), "hosts": ("value", "1")}
    path = write_scan(parts, shared_folder(spark))
    read = [read_scan(spark, path, name, df.schema).select("portfolio_id", F.lit(name).alias("part"), F.expr(kinds[name][0]).alias("kind"), F.expr(kinds[name][1]).cast("long").alias("amount")) for name, df in parts.items()]
    return reduce(DataFrame.unionByName, read).groupBy("portfolio_id", "part", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))


_N = "doc_id % 60"
_SAFE_LANG = "CASE WHEN lang = 'zh' THEN 'zh' ELSE 'en' END"


@query(f"""SELECT doc_id, doc_id % 9 = 8 AS refused, CASE WHEN doc_id % 9 <> 8 THEN coalesce(left(text, 120), '') END AS name, CASE WHEN doc_id % 9 <> 8 THEN CASE WHEN doc_id % 3 = 0 THEN 'A' ELSE 'F' END END AS grade,
 CASE WHEN doc_id % 9 <> 8 THEN CASE doc_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE n_chars END::DOUBLE END AS tokens, CASE WHEN doc_id % 9 <> 8 THEN doc_id % 5 = 0 END AS unsafe,
 CASE WHEN doc_id % 9 <> 8 THEN least(40, {_N}) END AS n_findings, CASE WHEN doc_id % 9 <> 8 THEN least(40, {_N}) // 2 END AS n_high, CASE WHEN doc_id % 9 <> 8 THEN least(100, doc_id % 130) END AS n_conflicts,
 CASE WHEN doc_id % 9 <> 8 THEN least(100, doc_id % 130) // 2 END AS n_shadow, CASE WHEN doc_id % 9 <> 8 THEN least(12, doc_id % 17) * (doc_id % 130 > 0)::INT END AS n_shared, CASE WHEN doc_id % 9 <> 8 THEN coalesce({_SAFE_LANG}, 'en') END AS lang,
 CASE WHEN doc_id % 9 <> 8 THEN CASE WHEN doc_id % 2 = 0 THEN coalesce(left(text, 200), '') ELSE '' END END AS change FROM documents""")
def sink_harden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports from others, one for each document and every ninth a mere string, made safe: known enums, finite numbers, only a literal true, strings and lists cut."""
    k, items = F.col("doc_id"), lambda n: F.filter(F.sequence(F.lit(1), n.cast("int") + 1), lambda i: i <= n)
    finding = lambda i: F.struct(F.when(i % 2 == 0, "high").otherwise(F.col("source")).alias("severity"), F.col("lang").alias("category"), i.alias("title"))
    shared = F.transform(items(k % 17), lambda i: F.concat(F.lit("word-"), i))
    conflict = lambda i: F.struct(F.lit("x").alias("a"), F.col("source").alias("b"), F.when(i % 2 == 0, "shadow").otherwise(F.col("lang")).alias("kind"), shared.alias("shared"))
    start, end = F.lit('{"skills":[{"name":'), F.lit("}")
    tokens = F.when(k % 4 == 0, F.to_json(F.array("lang"))).when(k % 4 == 1, "true").when(k % 4 == 2, F.concat(F.lit('"'), "n_chars", F.lit('"'))).otherwise(F.col("n_chars").cast("string"))
    quoted = lambda c: F.regexp_extract(F.to_json(F.array(F.coalesce(c, F.lit("")))), r"(?s)^\[(.*)\]$", 1)
    raw = F.concat(
        start, quoted(F.col("text")), F.lit(',"grade":'), quoted(F.when(k % 3 == 0, "A").otherwise(F.col("source"))), F.lit(',"tokens":'), tokens, F.lit(',"unsafe":'), F.when(k % 5 == 0, "true").otherwise('"true"'), F.lit(',"changes":['),
        F.when(k % 2 == 0, quoted(F.col("text"))).otherwise("5"), F.lit('],"a":{"findings":'), F.to_json(F.transform(items(k % 60), finding)), F.lit('}}],"conflicts":'), F.to_json(F.transform(items(k % 130), conflict)), F.lit(',"lang":'), quoted(F.col("lang")), end,
    )
    out = harden(table(spark, sf_dir, "documents").select("doc_id", F.when(k % 9 == 8, quoted(F.col("text"))).otherwise(raw).alias("raw")), "raw")
    skill, size = F.get("report.skills", F.lit(0)), lambda c: F.when(F.col("report").isNotNull(), F.size(c)).cast("long")
    return out.withColumn("skill", skill).select(
        "doc_id", F.col("report").isNull().alias("refused"), "skill.name", "skill.grade", "skill.tokens", "skill.unsafe", size("skill.findings").alias("n_findings"), size(F.filter("skill.findings", lambda f: f["severity"] == "high")).alias("n_high"),
        size("report.conflicts").alias("n_conflicts"), size(F.filter("report.conflicts", lambda c: c["kind"] == "shadow")).alias("n_shadow"), F.when(F.col("report").isNotNull(), F.coalesce(F.size(F.get("report.conflicts", F.lit(0))["shared"]), F.lit(0))).cast("long").alias("n_shared"),
        "report.lang", F.get("skill.changes", F.lit(0)).alias("change"),
    )
