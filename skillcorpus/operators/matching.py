"""Matching goals to catalog skills: constraints, ranking on an inverted index, selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skillcorpus.functions import intents as I
from skillcorpus.functions.text import edges, goal_tokens, match_tokens
from skillcorpus.operators.analysis import hit
from skillcorpus.plans.storage import cut


def constraints(goals: DataFrame) -> DataFrame:
    """Adds ``positive`` (the goal without exclusions), ``forbidden`` (terms) and ``forbidden_caps`` to ``goal_id, goal``."""
    clauses = F.transform(F.arrays_zip(F.regexp_extract_all("goal", F.lit(edges(I.NEGATION)), F.lit(1)).alias("a"), F.regexp_extract_all("goal", F.lit(edges(I.NEGATION)), F.lit(2)).alias("b")), lambda z: F.trim(F.concat(z["a"], z["b"])))
    words = F.filter(F.flatten(F.transform("clauses", match_tokens)), lambda w: ~w.isin(I.NEGATION_STOP))
    low = F.transform("clauses", F.lower)
    caps = F.array_compact(F.array(*[F.when(F.exists(low, _fits(p)), F.lit(c)) for c, p in I.FORBIDS]))
    rows = goals.withColumn("clauses", clauses)
    rows = rows.withColumns({"forbidden": F.array_distinct(F.transform(words, lambda w: F.regexp_replace(w, "s$", ""))), "forbidden_caps": caps, "positive": F.trim(F.regexp_replace(F.trim(F.regexp_replace("goal", edges(I.NEGATION), "")), edges(r"(?i)\b(?:but|and)\s*$"), ""))})
    return rows.drop("clauses")


def _fits(pattern: str):
    return lambda x: F.rlike(x, F.lit(edges(pattern)))


def tags(goals: DataFrame) -> DataFrame:
    """``goal_id, tag, literal``: a goal's own words, and the tags of the intent rows that fit it."""
    fired = F.flatten(F.array_compact(F.array(*[F.when(hit(F.col("positive"), f"(?i){p}"), F.array(*[F.lit(t) for t in ts.split()])) for p, ts in I.INTENTS])))
    own = match_tokens(F.col("positive"))
    rows = goals.select("goal_id", own.alias("own"), F.array_union(own, fired).alias("tags"))
    return rows.select("goal_id", F.explode("tags").alias("tag"), "own").select("goal_id", "tag", F.array_contains("own", F.col("tag")).alias("literal"))


def keys(term: Column) -> Column:
    """Where two terms meet: the term itself, and its first five characters if it has as many."""
    return F.array_compact(F.array(F.concat(F.lit("exact:"), term), F.when(F.length(term) >= 5, F.concat(F.lit("p5:"), F.left(term, F.lit(5))))))


def searchable(catalog: DataFrame) -> Column:
    return match_tokens(F.concat_ws(" ", F.replace("name", F.lit("-"), F.lit(" ")), "description", "category"))


def idf(catalog: DataFrame) -> DataFrame:
    """``term, df, idf``: ln(1 + (N + 1) / (df + 1)) over the catalog's search words."""
    n = catalog.count()
    terms = catalog.select(F.explode(searchable(catalog)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return terms.withColumn("idf", F.log(1 + F.lit(n + 1) / (F.col("df") + 1)))


def _weights(wanted: DataFrame, catalog: DataFrame) -> DataFrame:
    """``goal_id, tag, idf``: the weight of each goal's tags, by how many rows of its pool have them as a word.

    Shared rows of the catalog count in all pools; rows of a portfolio (``portfolio_id`` not null) in the pools of its goals only, where they take the place of shared
    rows of the same name (see ``rank_goals``).
    """
    words = catalog.select("portfolio_id", F.explode("terms").alias("tag"))
    shared = words.filter("portfolio_id is null").groupBy("tag").agg(F.count(F.lit(1)).alias("df"))
    own = words.filter("portfolio_id is not null").groupBy("portfolio_id", "tag").agg(F.count(F.lit(1)).alias("own_df"))
    hidden = _hidden(catalog)
    gone = hidden.join(catalog.select("ord", F.explode("terms").alias("tag")), "ord").groupBy("portfolio_id", "tag").agg(F.count(F.lit(1)).alias("gone_df"))
    n = catalog.filter("portfolio_id is null").count()
    sizes = catalog.filter("portfolio_id is not null").groupBy("portfolio_id").agg(F.count(F.lit(1)).alias("own_n")).join(hidden.groupBy("portfolio_id").agg(F.count(F.lit(1)).alias("gone_n")), "portfolio_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    rows = wanted.join(shared, "tag", "left").join(own, ["portfolio_id", "tag"], "left").join(gone, ["portfolio_id", "tag"], "left").join(sizes, "portfolio_id", "left")
    total, df = F.lit(n) + zero("own_n") - zero("gone_n"), zero("df") + zero("own_df") - zero("gone_df")
    return rows.select("goal_id", "portfolio_id", "tag", "literal", F.log(1 + (total + 1) / (df + 1)).alias("idf"))


def _hidden(catalog: DataFrame) -> DataFrame:
    """``portfolio_id, ord``: shared rows that a portfolio has a row of its own for, by name in any case."""
    own = catalog.filter("portfolio_id is not null").select("portfolio_id", F.lower("name").alias("key"))
    return own.join(catalog.filter("portfolio_id is null").select("ord", F.lower("name").alias("key")), "key").select("portfolio_id", "ord").distinct()


def rank_goals(goals: DataFrame, catalog: DataFrame, hinted: Column) -> DataFrame:
    """``goal_id, ord, score, n_matched, n_literal, matched``: how well catalog skills serve goals, exclusions applied.

    A goal's tags and a skill's words meet on equal keys (see ``keys``), each (goal, tag, skill) once. Rare tags weigh more;
    tags that the goal says weigh 4, those that intents add 1.15; words in a skill's name 3 and 1.5 more. ``hinted`` is the
    expression of capabilities that a catalog row's text hints at. Scores are rounded to three decimals. Where goals have a ``portfolio_id``, rows of the
    catalog with one, too, are installed skills: they serve the goals of their portfolio only, and there hide shared rows of their name.
    """
    if "portfolio_id" not in goals.columns:
        goals = goals.withColumn("portfolio_id", F.lit(None).cast("string"))
    if "portfolio_id" not in catalog.columns:
        catalog = catalog.withColumn("portfolio_id", F.lit(None).cast("string"))
    asked = constraints(goals)
    cat = cut(catalog.withColumns({"terms": searchable(catalog), "plain": F.lower(F.replace("name", F.lit("-"), F.lit(" "))), "all_caps": F.array_union("caps", hinted)}), "catalog")
    wanted = cut(tags(asked).join(asked.select("goal_id", "portfolio_id"), "goal_id"), "goal-tags")
    weighed = cut(_weights(wanted, cat), "weights")
    index = cat.select("ord", F.col("portfolio_id").alias("owner"), F.explode("terms").alias("term")).select("ord", "owner", F.explode(keys(F.col("term"))).alias("key")).distinct()
    mine = F.col("owner").isNull() | (F.col("owner") == F.col("portfolio_id"))
    hits = weighed.withColumn("key", F.explode(keys(F.col("tag")))).join(index, "key").filter(mine).select("goal_id", "portfolio_id", "ord", "tag", "literal", "idf").distinct().join(_hidden(cat), ["portfolio_id", "ord"], "left_anti")
    names = cat.select("ord", F.explode(match_tokens(F.col("plain"))).alias("tag"), F.lit(True).alias("named"))
    scored = hits.join(names, ["ord", "tag"], "left").groupBy("goal_id", "ord").agg(
        F.sum(F.col("idf") * (F.when(F.col("literal"), 4.0).otherwise(1.15) + F.when(F.col("named"), F.when(F.col("literal"), 3.0).otherwise(1.5)).otherwise(0.0))).alias("value"),
        F.count(F.lit(1)).alias("n_matched"), F.count_if("literal").alias("n_literal"), F.array_sort(F.collect_list("tag")).alias("matched"),
    )
    facts = cat.select("ord", "plain", "caps", "all_caps", "grade")
    rows = scored.join(asked.select("goal_id", "positive", "forbidden_caps"), "goal_id").join(facts, "ord")
    # a skill with a forbidden word is out: forbidden words and skills' words meet on the same keys
    banned = asked.select("goal_id", F.explode("forbidden").alias("word")).select("goal_id", F.explode(keys(F.col("word"))).alias("key")).join(index, "key").select("goal_id", "ord").distinct()
    rows = rows.join(banned, ["goal_id", "ord"], "left_anti").filter(~F.arrays_overlap("forbidden_caps", "all_caps") & ~((F.size("forbidden_caps") > 0) & (F.size("caps") == 0)))
    phrase, own = F.lower("positive"), match_tokens(F.col("plain"))
    unasked = F.array_size(F.filter(F.array(*[F.lit(p) for p in I.PLATFORMS]), lambda p: F.array_contains(own, p) & ~F.contains(phrase, p))) > 0
    extra = (
        F.when(hit(F.col("positive"), I.BUILDING) & F.array_contains(own, "builder"), 9).otherwise(0) - F.when(unasked, 7).otherwise(0)
        + F.when(F.contains(phrase, F.col("plain")) | F.contains(F.col("plain"), phrase), 5).otherwise(0) + F.when(F.col("grade") == "A", 0.25).otherwise(0.0)
    )
    return rows.select("goal_id", "ord", F.round(F.col("value") + extra, 3).alias("score"), "n_matched", "n_literal", "matched")


def top_k(ranked: DataFrame, catalog: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` best skills of each goal: by score, grade A first, fewer tokens first, then name and ordinal."""
    order = Window.partitionBy("goal_id").orderBy(F.desc("score"), F.desc(F.col("grade") == "A"), "tokens", "name", "ord")
    rows = ranked.join(catalog.select("ord", "name", "grade", "tokens"), "ord")
    return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def select_skills(goals: DataFrame, ranked: DataFrame, catalog: DataFrame, conflicts: DataFrame, most: int = 3) -> DataFrame:
    """One row per goal: ``goal_id, selected, coverage, confidence, abstained``.

    A goal that an intent row fits needs a best score of 1.45, else 5. Every anchor concept of the goal (the first ``most``) needs a skill of its own
    that matches it, two tags at least, and has no high conflict with those chosen; where one lacks it, the goal abstains.
    Without anchors the best skill is chosen, and two literal words are asked for if no intent row fits. All ranked skills are looked at: for each anchor in
    turn the first in rank is chosen, after those are taken out that share a name, or conflict, with one chosen before. ``conflicts`` has ``a, b``: catalog
    ordinals in high conflict.
    """
    asked = constraints(goals)
    fired = F.greatest(*[hit(F.col("positive"), f"(?i){p}") for p, _ in I.INTENTS])
    anchors = F.array_compact(F.array(*[F.when(hit(F.col("positive"), f"(?i){p}"), F.struct(F.split(F.lit(t), " ").alias("tags"), F.lit(m).alias("hits"))) for p, t, m in I.ANCHORS]))
    facts = cut(asked.select("goal_id", fired.alias("fired"), F.slice(anchors, 1, most).alias("anchors"), F.when(fired, 1.45).otherwise(5.0).alias("need")), "goal-facts")
    place = F.struct((-F.col("score")).alias("s"), (F.col("grade") != "A").alias("g"), "tokens", "name", "ord")
    rows = cut(ranked.join(catalog.select("ord", "name", "grade", "tokens"), "ord").select("goal_id", "ord", "name", "score", "n_literal", "matched", place.alias("place")), "ranked-skills")
    best = rows.groupBy("goal_id").agg(F.max("score").alias("top"), F.min_by(F.struct("ord", "name", "matched", "n_literal"), "place").alias("first"))
    coverable = rows.select("goal_id", F.explode("matched").alias("tag")).distinct().groupBy("goal_id").agg(F.count(F.lit(1)).alias("coverable"))
    judged = cut(facts.join(best, "goal_id", "left").withColumn("able", F.coalesce(F.col("top") >= F.col("need"), F.lit(False))), "goals-judged")

    fits = rows.join(judged.filter("able").select("goal_id", "need", F.posexplode("anchors").alias("k", "anchor")), "goal_id")
    fits = cut(fits.filter((F.col("score") >= F.col("need")) & (F.size("matched") >= 2) & (F.size(F.array_intersect("matched", F.col("anchor.tags"))) >= F.col("anchor.hits"))).select("goal_id", "k", "ord", "name", "matched", "place"), "anchored")
    enemies = conflicts.select("a", "b").union(conflicts.select("b", "a")).toDF("ord", "enemy")
    chosen = fits.limit(0).select("goal_id", "k", F.struct("ord", "name", "matched").alias("c"))
    for k in range(most):
        names = chosen.select("goal_id", F.col("c.name").alias("name"))
        hostile = chosen.select("goal_id", F.col("c.ord").alias("ord")).join(enemies, "ord").select("goal_id", F.col("enemy").alias("ord"))
        free = fits.filter(F.col("k") == k).join(names, ["goal_id", "name"], "left_anti").join(hostile, ["goal_id", "ord"], "left_anti")
        chosen = cut(chosen.union(free.groupBy("goal_id", "k").agg(F.min_by(F.struct("ord", "name", "matched"), "place").alias("c"))), "chosen")
    sets = chosen.groupBy("goal_id").agg(F.array_sort(F.collect_list(F.struct("k", "c"))).alias("all"))
    done = judged.join(sets, "goal_id", "left").join(coverable, "goal_id", "left")
    none = F.array().cast(sets.schema["all"].dataType)
    alone = F.array(F.struct(F.lit(0).alias("k"), F.struct(F.col("first.ord").alias("ord"), F.col("first.name").alias("name"), F.col("first.matched").alias("matched")).alias("c")))
    literal = F.col("fired") | (F.col("first.n_literal") >= 2)
    picked = F.when(~F.col("able"), none).when(F.size("anchors") == 0, F.when(literal, alone).otherwise(none)).when(F.size(F.coalesce("all", none)) == F.size("anchors"), F.col("all")).otherwise(none)
    done = done.withColumn("picked", picked)
    share = F.size(F.array_distinct(F.flatten(F.transform("picked", lambda x: x["c"]["matched"])))) / F.col("coverable")
    some = F.size("picked") > 0
    level = F.when(~some, "none").when((F.col("top") >= 10) & (share >= 0.5), "high").when(F.col("top") >= 4, "medium").otherwise("low")
    return done.select("goal_id", F.transform("picked", lambda x: x["c"]["ord"]).alias("selected"), F.when(some, F.round(share, 6)).otherwise(0.0).alias("coverage"), level.alias("confidence"), (~some).alias("abstained"))


def relevance(goals: DataFrame, skills: DataFrame) -> DataFrame:
    """``goal_id, skill_ord, relevance``: the share of a goal's tokens that a skill's name and description cover, where any."""
    asked = goals.select("goal_id", goal_tokens(F.col("goal")).alias("t")).select("goal_id", F.size("t").alias("n"), F.explode("t").alias("token"))
    have = skills.select("skill_ord", F.explode(goal_tokens(F.concat_ws(" ", "name", "description"))).alias("token"))
    meet = asked.withColumn("key", F.explode(keys(F.col("token")))).join(have.select("skill_ord", F.explode(keys(F.col("token"))).alias("key")).distinct(), "key")
    return meet.groupBy("goal_id", "skill_ord", "n").agg(F.count_distinct("token").alias("hit")).select("goal_id", "skill_ord", F.round(F.col("hit") / F.col("n"), 6).alias("relevance"))


def gaps(goals: DataFrame, skills: DataFrame) -> DataFrame:
    """``portfolio_id, goal_id, need``: goal tokens of four characters or more that no skill of the portfolio covers, for every goal and portfolio (which is also the output's size).

    Tokens of many goals are met once: what a portfolio lacks is told of distinct tokens, and only then of the goals that have them. A null portfolio's skills cover nothing.
    """
    needs = cut(goals.select("goal_id", F.explode(goal_tokens(F.col("goal"))).alias("need")).filter(F.length("need") >= 4).distinct(), "goal-needs")
    have = skills.select("portfolio_id", F.explode(goal_tokens(F.concat_ws(" ", "name", "description"))).alias("token")).distinct()
    have = have.select("portfolio_id", F.explode(keys(F.col("token"))).alias("key")).distinct()
    tokens = needs.select("need").distinct()
    met = tokens.withColumn("key", F.explode(keys(F.col("need")))).join(have, "key").select("portfolio_id", "need").distinct()
    lacks = skills.select("portfolio_id").distinct().crossJoin(tokens).join(met, ["portfolio_id", "need"], "left_anti")
    return lacks.join(needs, "need").select("portfolio_id", "goal_id", "need")


def pool(catalog: DataFrame, eligible: Column, stub: Column) -> DataFrame:
    """The match pool: eligible rows, one per name, seed before curated before community, then by ordinal.

    A row that the filters reject does not claim its name.
    """
    rank = F.when(F.col("pool") == "seed", 0).when(F.col("pool") == "curated", 1).otherwise(2)
    rows = catalog.filter(eligible & ~stub).withColumn("i", F.row_number().over(Window.partitionBy("name").orderBy(rank, "ord")))
    return rows.filter("i = 1").drop("i")


def nearest_kit(goals: DataFrame, kits: DataFrame, members: DataFrame | None = None, least: int = 4) -> DataFrame:
    """``goal_id, id, score`` of the kit (``id, ord, kit, who``: name and introduction in lower case) closest to each goal, if it scores ``least``; the first of equals.

    Each distinct word of the goals, and each pair of neighbouring Chinese characters, weighs 4 in a kit's name, else 2 in its introduction; ``members`` (``id, goal_id, score``), if given,
    adds what the kit's skills score for the goal. Substrings of kits' texts are found by the pairs of characters that they begin with, so words and kits meet on keys.
    """
    runs = F.regexp_extract_all("goal", F.lit("([一-鿿]+)"), F.lit(1))
    pairs = F.flatten(F.transform(runs, lambda r: F.filter(F.transform(F.sequence(F.lit(1), F.length(r)), lambda i: F.substr(r, i, F.lit(2))), lambda b: (F.length(b) == 2) & ~b.isin(I.CJK_STOP))))
    asked = goals.select("goal_id", F.explode(F.concat(match_tokens(F.col("goal")), pairs)).alias("word"))
    words = asked.select("word").distinct().withColumn("key", F.left("word", F.lit(2)))
    starts = lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - 1)), lambda i: F.substr(F.col(c), i, F.lit(2)))
    keyed = kits.select("id", "ord", "kit", "who", F.explode(F.array_union(starts("kit"), starts("who"))).alias("key"))
    points = F.when(F.contains("kit", "word"), 4).when(F.contains("who", "word"), 2).otherwise(0)
    hits = words.join(keyed, "key").select("word", "id", "ord", points.alias("points")).filter("points > 0")
    scores = asked.join(hits, "word").select("goal_id", "id", "ord", "points")
    if members is not None:
        scores = scores.union(members.join(kits.select("id", "ord"), "id").select("goal_id", "id", "ord", "score"))
    totals = scores.groupBy("goal_id", "id", "ord").agg(F.sum("points").alias("score"))
    best = totals.withColumn("i", F.row_number().over(Window.partitionBy("goal_id").orderBy(F.desc("score"), "ord")))
    return best.filter((F.col("i") == 1) & (F.col("score") >= least)).select("goal_id", "id", "score")
