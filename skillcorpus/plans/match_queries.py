"""Queries that match goals with catalog skills and installed portfolios."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skillcorpus.functions import intents as I
from skillcorpus.operators import analysis as A
from skillcorpus.operators import matching as M
from skillcorpus.operators import portfolio as P
from skillcorpus.plans import sql as S
from skillcorpus.plans.inputs import analysed
from skillcorpus.plans.registry import query
from skillcorpus.plans.scan_queries import _ELIGIBLE, _STUB, HINTS, hinted_caps, stage_of, STAGES
from skillcorpus.plans.storage import cut
from skillcorpus.sources import adapters
from skillcorpus.sources.tables import table


def _goals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.goals_from_benchmark(table(spark, sf_dir, "benchmark"))


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.catalog_from_documents(table(spark, sf_dir, "documents"))


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(M.pool(_catalog(spark, sf_dir), F.expr(_ELIGIBLE), F.rlike("description", F.lit(_STUB))), "pool")


def _hinted():
    return hinted_caps(F.concat_ws(" ", "name", "description", "category"))


_POOL = f"po AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY CASE pool WHEN 'seed' THEN 0 WHEN 'curated' THEN 1 ELSE 2 END, ord) AS i FROM cat WHERE {_ELIGIBLE} AND NOT regexp_matches(description, '{_STUB}')) WHERE i = 1)"
_CONSTRAINED = f"""cn0 AS (SELECT goal_id, goal, list_transform(list_zip(regexp_extract_all(goal, {S.sql_text(I.NEGATION)}, 1), regexp_extract_all(goal, {S.sql_text(I.NEGATION)}, 2)), lambda z: trim(concat(z[1], z[2]))) AS clauses FROM gl),
cn AS (SELECT goal_id, goal, list_distinct(list_transform(list_filter(flatten(list_transform(clauses, lambda c: {S.match_tokens("c")})), lambda w: w NOT IN ({S.in_list(I.NEGATION_STOP)})), lambda w: regexp_replace(w, 's$', ''))) AS forbidden,
  list_filter([{", ".join(f"CASE WHEN len(list_filter(clauses, lambda c: regexp_matches(lower(c), '{p}'))) > 0 THEN '{c}' END" for c, p in I.FORBIDS)}], lambda x: x IS NOT NULL) AS forbidden_caps,
  trim(regexp_replace(trim(regexp_replace(goal, {S.sql_text(I.NEGATION)}, '', 'g')), '(?i)\\b(?:but|and)\\s*$', '')) AS positive FROM cn0)"""


@query(S.given("gl", f"{_CONSTRAINED}\n---\nSELECT goal_id, positive, array_to_string(list_sort(forbidden), '|') AS forbidden, array_to_string(forbidden_caps, '|') AS caps FROM cn"))
def flt_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What goals exclude."""
    rows = M.constraints(_goals(spark, sf_dir))
    return rows.select("goal_id", "positive", F.array_join(F.array_sort("forbidden"), "|").alias("forbidden"), F.array_join("forbidden_caps", "|").alias("caps"))


@query(S.given("cat", f"{_POOL}\n---\nSELECT ord, name, pool FROM po"))
def pool_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The match pool, one row per name."""
    return M.pool(_catalog(spark, sf_dir), F.expr(_ELIGIBLE), F.rlike("description", F.lit(_STUB))).select("ord", "name", "pool")


@query(S.given("cat", f"{_POOL}\n---\nSELECT pool, count(*) AS n FROM po GROUP BY pool"))
def set_pool_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union of the pools, by how many rows each brings in."""
    cat = _catalog(spark, sf_dir)
    parts = [cat.filter(F.col("pool") == p) for p in ("seed", "curated", "community")]
    union = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return M.pool(union, F.expr(_ELIGIBLE), F.rlike("description", F.lit(_STUB))).groupBy("pool").agg(F.count(F.lit(1)).alias("n"))


_SEARCH = "(replace(name, '-', ' ') || ' ' || description || ' ' || category)"
_IDF = f"te AS (SELECT ord, unnest({S.match_tokens(_SEARCH)}) AS term FROM po), df AS (SELECT term, count(*) AS df FROM te GROUP BY 1), nn AS (SELECT count(*) AS n FROM po)"


@query(S.given("cat", f"{_POOL}, {_IDF}\n---\nSELECT term, df, round(ln(1 + (n + 1) / (df + 1)::DOUBLE), 6) AS idf FROM df, nn"))
def idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of catalog words."""
    return M.idf(_pool(spark, sf_dir)).select("term", "df", F.round("idf", 6).alias("idf"))


_TAGS = "flatten(list_filter([" + ", ".join(f"CASE WHEN {S.matches('positive', '(?i)' + p)} THEN {S.sql_list(t.split())} END" for p, t in I.INTENTS) + "], lambda x: x IS NOT NULL))"
_KEYS = "CASE WHEN length({0}) >= 5 THEN ['exact:' || {0}, 'p5:' || left({0}, 5)] ELSE ['exact:' || {0}] END"
_CAPS = "list_distinct(list_concat(caps, list_filter([" + ", ".join(f"CASE WHEN {S.matches('(name || chr(32) || description || chr(32) || category)', p)} THEN '{n}' END" for n, p in HINTS) + "], lambda x: x IS NOT NULL)))"
_RANKED = f"""{_POOL}, {_IDF}, {_CONSTRAINED},
tg AS (SELECT goal_id, tag, list_contains(own, tag) AS literal FROM (SELECT goal_id, own, unnest(list_distinct(list_concat(own, {_TAGS}))) AS tag FROM (SELECT goal_id, positive, {S.match_tokens("positive")} AS own FROM cn))),
tw AS (SELECT tg.*, ln(1 + (n + 1) / (coalesce(df, 0) + 1)::DOUBLE) AS idf, unnest({_KEYS.format("tag")}) AS key FROM tg LEFT JOIN df ON term = tag, nn),
ix AS (SELECT DISTINCT ord, unnest({_KEYS.format("term")}) AS key FROM te),
hi AS (SELECT DISTINCT goal_id, ord, tag, literal, idf FROM tw JOIN ix USING (key)),
nm AS (SELECT ord, lower(replace(name, '-', ' ')) AS plain, {S.match_tokens("replace(name, '-', ' ')")} AS own, {S.match_tokens(_SEARCH)} AS terms, caps, {_CAPS} AS all_caps, grade, tokens, name, description, category FROM po),
sc AS (SELECT goal_id, ord, sum(idf * (CASE WHEN literal THEN 4 ELSE 1.15::DOUBLE END + CASE WHEN list_contains(own, tag) THEN CASE WHEN literal THEN 3 ELSE 1.5::DOUBLE END ELSE 0 END)) AS value, count(*) AS n_matched, count(*) FILTER (WHERE literal) AS n_literal, list(tag) AS matched FROM hi JOIN nm USING (ord) GROUP BY 1, 2),
rg AS (SELECT goal_id, ord, n_matched, n_literal, matched, nm.name, nm.grade, nm.tokens, nm.description, nm.category, round(value + CASE WHEN {S.matches("positive", I.BUILDING)} AND list_contains(own, 'builder') THEN 9 ELSE 0 END - CASE WHEN len(list_filter({S.sql_list(I.PLATFORMS)}, lambda p: list_contains(own, p) AND NOT contains(lower(positive), p))) > 0 THEN 7 ELSE 0 END
  + CASE WHEN contains(lower(positive), plain) OR contains(plain, lower(positive)) THEN 5 ELSE 0 END + CASE WHEN grade = 'A' THEN 0.25 ELSE 0 END, 3) AS score
 FROM sc JOIN cn USING (goal_id) JOIN nm USING (ord) WHERE len(list_filter(forbidden, lambda f: list_contains(terms, f) OR (length(f) >= 5 AND list_contains(list_transform(list_filter(terms, lambda t: length(t) >= 5), lambda t: left(t, 5)), left(f, 5))))) = 0
  AND NOT list_has_any(forbidden_caps, all_caps) AND NOT (len(forbidden_caps) > 0 AND len(caps) = 0)),
rt AS (SELECT *, row_number() OVER (PARTITION BY goal_id ORDER BY score DESC, grade = 'A' DESC, tokens, name, ord) AS place FROM rg)"""


@query(S.given("cat gl", f"{_RANKED}\n---\nSELECT goal_id, ord, score, n_matched, n_literal FROM rg"))
def goal_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well each skill of the pool serves each goal."""
    return M.rank_goals(_goals(spark, sf_dir), _pool(spark, sf_dir), _hinted()).drop("matched")


@query(S.given("cat gl", f"{_RANKED}\n---\nSELECT goal_id, place::INT AS place, ord, score FROM rt WHERE place <= 3"))
def rank_goal_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best skills of each goal."""
    pool = _pool(spark, sf_dir)
    return M.top_k(M.rank_goals(_goals(spark, sf_dir), pool, _hinted()), pool).select("goal_id", "place", "ord", "score")


@query(S.given("cat gl", f"{_RANKED}, cv AS (SELECT goal_id, count(DISTINCT tag) AS coverable FROM (SELECT goal_id, unnest(matched) AS tag FROM rg) GROUP BY 1)\n---\nSELECT goal_id, round(n_matched / coverable::DOUBLE, 6) AS coverage, CASE WHEN score >= 10 AND n_matched / coverable::DOUBLE >= 0.5 THEN 'high' WHEN score >= 4 THEN 'medium' ELSE 'low' END AS confidence FROM rt JOIN cv USING (goal_id) WHERE place = 1"))
def coverage_conf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of a goal its best skill covers, and how sure that makes the match."""
    pool = _pool(spark, sf_dir)
    ranked = cut(M.rank_goals(_goals(spark, sf_dir), pool, _hinted()), "ranked")
    coverable = ranked.select("goal_id", F.explode("matched").alias("tag")).groupBy("goal_id").agg(F.count_distinct("tag").alias("coverable"))
    rows = M.top_k(ranked, pool, 1).join(coverable, "goal_id").withColumn("c", F.col("n_matched") / F.col("coverable"))
    return rows.select("goal_id", F.round("c", 6).alias("coverage"), F.when((F.col("score") >= 10) & (F.col("c") >= 0.5), "high").when(F.col("score") >= 4, "medium").otherwise("low").alias("confidence"))


_STAGE = "CASE " + " ".join(f"WHEN regexp_matches(lower(name || ' ' || category || ' ' || description), {S.sql_text(p)}) THEN '{n}'" for n, p in STAGES) + " ELSE 'general' END"


@query(S.given("cat gl", f"{_RANKED}, st AS (SELECT goal_id, place, ord, CASE place WHEN 1 THEN 'discover' ELSE {_STAGE} END AS stage FROM rt WHERE place <= 3)\n---\nSELECT goal_id, place::INT AS place, ord, CASE WHEN lag(stage) OVER w <> stage THEN lag(ord) OVER w END AS depends_on FROM st WINDOW w AS (PARTITION BY goal_id ORDER BY place)"))
def depends_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which skill of a goal's best three each builds on: the one before, if its stage differs. The first counts as discovery."""
    pool = _pool(spark, sf_dir)
    best = M.top_k(M.rank_goals(_goals(spark, sf_dir), pool, _hinted()), pool).select("goal_id", "place", "ord").join(pool.select("ord", "name", "category", "description"), "ord")
    rows = best.withColumn("stage", F.when(F.col("place") == 1, "discover").otherwise(stage_of(F.concat_ws(" ", "name", "category", "description"))))
    w = Window.partitionBy("goal_id").orderBy("place")
    return rows.select("goal_id", "place", "ord", F.when(F.lag("stage").over(w) != F.col("stage"), F.lag("ord").over(w)).alias("depends_on"))


def _high_conflicts(pool: DataFrame) -> DataFrame:
    named = pool.select(F.lit("catalog").alias("portfolio_id"), F.col("ord").alias("skill_ord"), "name", "description")
    return P.conflict_pairs(named, only_high=True, words=False).select("a", "b")


@query()
def job_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The skills chosen for each goal, or that it abstains."""
    pool = _pool(spark, sf_dir)
    ranked = cut(M.rank_goals(_goals(spark, sf_dir), pool, _hinted()), "ranked")
    return M.select_skills(_goals(spark, sf_dir), ranked, pool, _high_conflicts(pool))


def _named_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.parse(adapters.skills(spark, sf_dir)).select("portfolio_id", "skill_ord", F.col("fm_name").alias("name"), "description")


_HAVE = f"gt AS (SELECT goal_id, unnest({S.goal_tokens('goal')}) AS token FROM gl), gn AS (SELECT goal_id, count(*) AS n FROM gt GROUP BY 1), gk AS (SELECT goal_id, token, unnest({_KEYS.format('token')}) AS key FROM gt), st0 AS (SELECT portfolio_id, skill_ord, unnest({S.goal_tokens('(fm_name || chr(32) || description)')}) AS token FROM pf), sk0 AS (SELECT DISTINCT portfolio_id, skill_ord, unnest({_KEYS.format('token')}) AS key FROM st0)"


@query(S.given("pf gl", f"{_HAVE}\n---\nSELECT goal_id, skill_ord, round(count(DISTINCT token) / any_value(n)::DOUBLE, 6) AS relevance FROM gk JOIN sk0 USING (key) JOIN gn USING (goal_id) GROUP BY 1, 2"))
def goal_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What share of a goal each installed skill covers."""
    return M.relevance(_goals(spark, sf_dir), _named_skills(spark, sf_dir))


@query(S.given("pf gl", f"{_HAVE}, pk AS (SELECT DISTINCT portfolio_id, key FROM sk0), ev AS (SELECT portfolio_id, goal_id, token, key FROM gk, (SELECT DISTINCT portfolio_id FROM pf) WHERE length(token) >= 4)\n---\nSELECT portfolio_id, goal_id, token AS need FROM ev LEFT JOIN pk USING (portfolio_id, key) GROUP BY ALL HAVING count(pk.key) = 0"))
def goal_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Goal words that no skill of a portfolio covers, for every goal and portfolio."""
    return M.gaps(_goals(spark, sf_dir), _named_skills(spark, sf_dir))


_INSTALLED = "ins AS (SELECT portfolio_id, 'kit-' || (skill_ord - skill_ord % 2) AS name, grade IN ('A', 'B') AND gate = 'pass' AND level = 'low' AS eligible, skill_ord FROM an)"


def _installed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Installed skills under catalog names."""
    ok = F.col("grade").isin("A", "B") & (F.col("gate") == "pass") & (F.col("level") == "low")
    return analysed(spark, sf_dir).select("portfolio_id", "skill_ord", F.concat(F.lit("kit-"), (F.col("skill_ord") - F.col("skill_ord") % 2).cast("string")).alias("name"), ok.alias("eligible"))


def _changes(chosen: DataFrame, installed: DataFrame) -> DataFrame:
    """What each portfolio would do for each chosen skill; portfolios times chosen skills is the output's size. Those that have a skill of the name replace it or are served, all others add it."""
    have = installed.groupBy("portfolio_id", F.lower("name").alias("key")).agg(F.bool_or("eligible").alias("eligible"))
    wanted = chosen.select(F.lower("name").alias("key")).distinct()
    have = have.join(wanted, "key", "left_semi")  # of all that is installed, what a goal may want
    rows = chosen.withColumn("key", F.lower("name")).crossJoin(installed.select("portfolio_id").distinct()).join(have, ["portfolio_id", "key"], "left")
    return rows.select("portfolio_id", "goal_id", "name", F.when(F.col("eligible"), "installed").when(F.col("eligible").isNotNull(), "replace").otherwise("add").alias("change"))


@query(S.given("an cat gl", f"{_RANKED}, {_INSTALLED}, hv AS (SELECT portfolio_id, lower(name) AS key, bool_or(eligible) AS eligible FROM ins GROUP BY 1, 2), ev AS (SELECT portfolio_id, goal_id, name FROM rt, (SELECT DISTINCT portfolio_id FROM ins) WHERE place <= 3)\n---\nSELECT ev.portfolio_id, goal_id, name, CASE WHEN eligible THEN 'installed' WHEN eligible IS NOT NULL THEN 'replace' ELSE 'add' END AS change FROM ev LEFT JOIN hv ON hv.portfolio_id = ev.portfolio_id AND hv.key = lower(ev.name)"))
def plan_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each portfolio would add or replace for the best three skills of each goal."""
    pool = _pool(spark, sf_dir)
    best = cut(M.top_k(M.rank_goals(_goals(spark, sf_dir), pool, _hinted()), pool).select("goal_id", "name"), "best")
    return _changes(best, _installed(spark, sf_dir))


@query()
def job_goal_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For the goal of each portfolio (see ``portfolio_goals``): the skills that a match selects, installed ones first, and what to add or replace."""
    mine = adapters.portfolio_goals(spark, sf_dir)
    have = analysed(spark, sf_dir).join(mine, "portfolio_id", "left_semi")
    ok = F.col("grade").isin("A", "B") & (F.col("gate") == "pass") & (F.col("level") == "low") & (F.col("fm_name") != "")
    caps = F.transform("capabilities", lambda c: c["cap"])
    installed = have.select(
        "portfolio_id", (-1 - F.col("skill_ord")).alias("ord"), F.lit("installed").alias("pool"), F.col("fm_name").alias("name"), "description", F.lit("Installed").alias("category"), "grade", "gate", F.col("level").alias("risk"), F.col("tokens_total").alias("tokens"), caps.alias("caps"), ok.alias("eligible")
    )
    first = Window.partitionBy("portfolio_id", F.lower("name")).orderBy(F.desc("ord"))
    own = installed.filter("eligible").withColumn("i", F.row_number().over(first)).filter("i = 1").drop("i", "eligible")
    pool = cut(_pool(spark, sf_dir).withColumn("portfolio_id", F.lit(None).cast("string")).unionByName(own), "plan-pool")
    goals = mine.select("portfolio_id", "goal_id", "goal")
    ranked = cut(M.rank_goals(goals, pool, _hinted()), "ranked")
    picked = M.select_skills(goals, ranked, pool, _high_conflicts(pool)).select("goal_id", F.posexplode("selected").alias("place", "ord"))
    rows = picked.join(pool.select("ord", "name"), "ord").join(goals.select("goal_id", "portfolio_id"), "goal_id")
    there = installed.groupBy("portfolio_id", F.lower("name").alias("key")).agg(F.bool_or("eligible").alias("eligible"))
    rows = rows.withColumn("key", F.lower("name")).join(there, ["portfolio_id", "key"], "left")
    change = F.when(F.col("ord") < 0, "installed").when(F.col("eligible") == F.lit(False), "replace").otherwise("add")
    return rows.select("portfolio_id", "goal_id", "place", "name", change.alias("change"))


#: The artifact index of a catalog: every fifth name is ready, every seventh failed the full gate.
_INDEX = "ai AS (SELECT DISTINCT name, CASE WHEN ord // 2 % 5 = 0 THEN 'pilot-ready' ELSE 'link-only' END AS status, CASE WHEN ord // 2 % 5 = 0 THEN NULL WHEN ord // 2 % 7 = 0 THEN 'full-gate-failed' ELSE 'not-in-v2.1-pilot' END AS reason FROM cat)"


def artifact_index(catalog: DataFrame) -> DataFrame:
    k = F.expr("ord div 2")
    status = F.when(k % 5 == 0, "pilot-ready").otherwise("link-only")
    return catalog.select("name", status.alias("status"), F.when(k % 5 == 0, F.lit(None)).when(k % 7 == 0, "full-gate-failed").otherwise("not-in-v2.1-pilot").alias("reason")).distinct()


@query(S.given("cat", f"{_INDEX}\n---\nSELECT ord, cat.name FROM cat ANTI JOIN (SELECT name FROM ai WHERE reason = 'full-gate-failed') r ON r.name = cat.name"))
def flt_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog skills whose whole package did not fail the gate."""
    cat = _catalog(spark, sf_dir)
    return cat.select("ord", "name").join(artifact_index(cat).filter("reason = 'full-gate-failed'"), "name", "left_anti")


@query(S.given("cat gl", f"{_RANKED}, {_INDEX}\n---\nSELECT goal_id, count(*) FILTER (WHERE status = 'pilot-ready') AS n_ready, count(*) FILTER (WHERE reason = 'full-gate-failed') AS n_rejected, bool_and(coalesce(status = 'pilot-ready', false)) AS all_ready FROM rt LEFT JOIN ai USING (name) WHERE place <= 3 GROUP BY 1"))
def artifact_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the skills chosen for a goal are ready as pinned artifacts."""
    pool = _pool(spark, sf_dir)
    best = M.top_k(M.rank_goals(_goals(spark, sf_dir), pool, _hinted()), pool).select("goal_id", "name")
    rows = best.join(artifact_index(_catalog(spark, sf_dir)), "name", "left")
    return rows.groupBy("goal_id").agg(F.count_if(F.col("status") == "pilot-ready").alias("n_ready"), F.count_if(F.col("reason") == "full-gate-failed").alias("n_rejected"), F.bool_and(F.coalesce(F.col("status") == "pilot-ready", F.lit(False))).alias("all_ready"))


_KITS = f"""kt AS (SELECT category || '/' || pool AS id, min(ord) AS o, lower(min(name)) AS kit, lower(min(description)) AS who FROM po GROUP BY 1), kd AS (SELECT DISTINCT goal_id, unnest({S.match_tokens('goal')}) AS word FROM gl UNION ALL SELECT goal_id, b FROM (SELECT goal_id, unnest(flatten(list_transform(regexp_extract_all(goal, '[一-鿿]+'), lambda r: list_transform(range(1, length(r)), lambda i: substr(r, i, 2))))) AS b FROM gl) WHERE b NOT IN ({S.in_list(I.CJK_STOP)}))"""


@query(S.given("cat gl", f"{_POOL}, {_KITS}, kx AS (SELECT DISTINCT word FROM kd), kh AS (SELECT word, id, o, CASE WHEN contains(kit, word) THEN 4 ELSE 2 END AS p FROM kx JOIN kt ON contains(kit, word) OR contains(who, word)), ks AS (SELECT goal_id, id, o, sum(p) AS score FROM kd JOIN kh USING (word) GROUP BY 1, 2, 3)\n---\nSELECT goal_id, id, score::BIGINT AS score FROM (SELECT *, row_number() OVER (PARTITION BY goal_id ORDER BY score DESC, o) AS i FROM ks) WHERE i = 1 AND score >= 4"))
def nearest_kit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ready-made kit closest to each goal, by words and pairs of Chinese characters in its name (4) or introduction (2)."""
    pool = _pool(spark, sf_dir)
    kits = pool.groupBy(F.concat_ws("/", "category", "pool").alias("id")).agg(F.min("ord").alias("ord"), F.lower(F.min("name")).alias("kit"), F.lower(F.min("description")).alias("who"))
    return M.nearest_kit(_goals(spark, sf_dir), kits)
