"""Jobs over sets of skills: trigger conflicts, shared hosts and commands, listing budgets, bloat."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skillcorpus.functions import rules as R
from skillcorpus.functions.text import edges, js_trim, listing_tokens, trigger_tokens
from skillcorpus.operators.analysis import hit
from skillcorpus.operators.ranks import ranked
from skillcorpus.operators.set_pairs import Judge, Pairs, set_pairs
from skillcorpus.plans.storage import cut, partitions

#: Skills that share a value and are joined with all others of it in one task.
PART = 512
# Cut-offs of token overlap; listing rules of the two harnesses.
SHADOW, SHADOW_HIGH, OVERLAP, OVERLAP_HIGH = 0.16, 0.4, 0.34, 0.55
HARNESSES = [("claude-code", 2000, 1536, True), ("codex", 2000, None, False)]


def token_sets(skills: DataFrame) -> DataFrame:
    """``portfolio_id, skill_ord, name, broad, tokens``: trigger tokens of skills with a description, without those that
    more than half of a portfolio of six or more shares. Tokens are ordered by how many skills of the portfolio have them."""
    rows = skills.filter(js_trim(F.coalesce("description", F.lit(""))) != "").select("portfolio_id", "skill_ord", "name", hit(F.col("description"), R.BROAD).alias("broad"), trigger_tokens(F.col("description")).alias("tokens"))
    rows = cut(rows, "trigger-tokens")
    sizes = rows.groupBy("portfolio_id").agg(F.count(F.lit(1)).alias("n"))
    df = rows.select("portfolio_id", F.explode("tokens").alias("token")).groupBy("portfolio_id", "token").agg(F.count(F.lit(1)).alias("df"))
    kept = df.join(sizes, "portfolio_id").filter("n < 6 or df <= floor(n / 2)").select("portfolio_id", "token", "df")
    exploded = rows.select("portfolio_id", "skill_ord", F.explode("tokens").alias("token")).join(kept, ["portfolio_id", "token"])
    ordered = exploded.groupBy("portfolio_id", "skill_ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "token"))), lambda x: x["token"]).alias("tokens"))
    return rows.drop("tokens").join(ordered, ["portfolio_id", "skill_ord"])


def conflict_pairs(skills: DataFrame, only_high: bool = False, words: bool = True) -> DataFrame:
    """``portfolio_id, a, b, kind, severity, n_shared, shared, jaccard``: pairs of skills that fire on the same requests.

    ``skills`` has ``portfolio_id, skill_ord, name, description``. A pair with a broad member shadows at Jaccard 0.16 or
    three shared tokens, others overlap at 0.34 and two tokens; skills of one name never conflict. Shared tokens are counted by blocks of skills (see
    ``set_pairs``), so only conflicts leave a task. Without ``words``, what is shared is not listed.
    """
    found = set_pairs(_conflict_sets(skills), ["name", "broad"], _conflicts(only_high), CONFLICT, words)
    return found.select(*_told(), *([F.col("shared")] if words else []), "jaccard")


def worst_conflicts(skills: DataFrame, most: int) -> DataFrame:
    """``portfolio_id, a, b, kind, severity, n_shared, place``: the ``most`` worst conflicts of each portfolio, by severity, then shared tokens, then ordinals.

    Every two blocks of skills bring their own worst ones, so what meets in a portfolio's window grows with its blocks, not with its conflicts.
    """
    order = lambda c: (c["b"], c["a"], -c["n_shared"], ~c["high"])
    found = set_pairs(_conflict_sets(skills), ["name", "broad"], _conflicts(False), CONFLICT, best=(most, order))
    place = F.row_number().over(Window.partitionBy("portfolio_id").orderBy(F.desc("high"), F.desc("n_shared"), "a", "b"))
    return found.withColumn("place", place.cast("long")).filter(F.col("place") <= most).select(*_told(), "place")


CONFLICT = "shadow boolean, high boolean, jaccard double"


def _conflict_sets(skills: DataFrame) -> DataFrame:
    return cut(token_sets(skills).filter("name is not null"), "tokens")


def _told() -> list[Column]:
    return ["portfolio_id", "a", "b", F.when(F.col("shadow"), "shadow").otherwise("overlap").alias("kind"), F.when(F.col("high"), "high").otherwise("medium").alias("severity"), F.col("n_shared")]


def _conflicts(only_high: bool) -> Judge:
    def judge(pairs: Pairs) -> tuple[Pairs, dict]:
        pairs = pairs.where(pairs.a("name") != pairs.b("name"))
        j, broad = pairs.jaccard(), pairs.a("broad") | pairs.b("broad")
        shadow = broad & ((j >= SHADOW) | (pairs.n >= 3))
        high = np.where(shadow, j >= SHADOW_HIGH, j >= OVERLAP_HIGH)
        keep = shadow | ((j >= OVERLAP) & (pairs.n >= 2))
        keep &= high | (not only_high)
        return pairs.where(keep), {"shadow": shadow[keep], "high": high[keep], "jaccard": j[keep]}

    return judge


def hosts(text: Column) -> Column:
    """Hosts of a text's URLs but for well-known ones."""
    return F.filter(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(R.URL_HOST), F.lit(1)), F.lower)), lambda h: ~F.rlike(h, F.lit(R.WELL_KNOWN)))


def fragments(text: Column) -> Column:
    """Distinctive command lines of a text's fences: 40 characters or more, no comment, doing something."""
    lines = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(r"(```[\s\S]*?```)"), F.lit(1)), lambda f: F.split(f, "\n", -1)))
    kept = F.filter(F.transform(lines, js_trim), lambda x: (F.length(x) >= 40) & ~x.startswith("```") & ~x.startswith("#") & F.rlike(x, F.lit(edges(R.COMMAND_LINE))))
    return F.array_distinct(F.transform(kept, lambda x: F.regexp_replace(x, r"\s+", " ")))


def shared_pairs(skills: DataFrame, values: Column) -> DataFrame:
    """``portfolio_id, a, b, shared``: pairs of a portfolio's skills with a value of ``values`` in common.

    The output grows with the square of how many skills share a value; ``shared_values`` gives one row per value instead. A pair meets on each value that it shares, and
    comes out where it meets on the first, so pairs are not gathered again. Skills with a common value are dealt to parts of ``PART``, each joined with all of them.
    """
    each = skills.select("portfolio_id", "skill_ord", F.explode(values).alias("value"))
    own = cut(each.groupBy("portfolio_id", "skill_ord").agg(F.array_sort(F.collect_set("value")).alias("values")), "shared-values")
    rows = own.withColumn("value", F.explode("values"))
    parts = rows.groupBy("portfolio_id", "value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").withColumn("parts", F.ceil(F.col("n") / PART)).drop("n")
    met = rows.join(parts, ["portfolio_id", "value"])
    key = ["portfolio_id", "value", "part"]
    x = met.select("portfolio_id", "value", F.pmod(F.xxhash64("skill_ord"), "parts").alias("part"), F.col("skill_ord").alias("a"), F.col("values").alias("x"))
    y = met.select("portfolio_id", "value", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("skill_ord").alias("b"), F.col("values").alias("y"))
    tasks = max(partitions(skills.sparkSession), 4 * skills.sparkSession.sparkContext.defaultParallelism)
    shared = F.when(F.size("x") == 1, F.col("x")).when(F.size("y") == 1, F.col("y")).otherwise(F.array_intersect("x", "y"))
    pairs = x.repartition(tasks, *key).join(y.repartition(tasks, *key).hint("merge"), key).filter("a < b")
    return pairs.select("portfolio_id", "a", "b", "value", shared.alias("shared")).filter(F.get("shared", F.lit(0)) == F.col("value")).drop("value")


def shared_values(skills: DataFrame, values: Column) -> DataFrame:
    """``portfolio_id, value, n_skills, first, n_pairs``: values that two skills of a portfolio or more share."""
    each = skills.select("portfolio_id", "skill_ord", F.explode(values).alias("value"))
    found = each.groupBy("portfolio_id", "value").agg(F.count(F.lit(1)).alias("n_skills"), F.min("skill_ord").alias("first")).filter("n_skills > 1")
    return found.withColumn("n_pairs", F.expr("n_skills * (n_skills - 1) div 2"))


def relay_counts(skills: DataFrame, text: Column) -> DataFrame:
    """``portfolio_id, n_sources, n_sinks, n_pairs``: skills that read secrets and do not send, and the other way round.

    Every source with every sink is a relay; as that is a product, it is counted and not listed.
    """
    rows = skills.select("portfolio_id", hit(text, R.READS_SECRET).alias("reads"), hit(text, R.SENDS).alias("sends"))
    found = rows.groupBy("portfolio_id").agg(F.count_if(F.expr("reads and not sends")).alias("n_sources"), F.count_if(F.expr("sends and not reads")).alias("n_sinks"))
    return found.withColumn("n_pairs", F.col("n_sources") * F.col("n_sinks")).filter("n_pairs > 0")


def relay_members(skills: DataFrame, text: Column) -> DataFrame:
    """``portfolio_id, skill_ord, role``: the relays of every portfolio in a form that is linear in skills: each ``source`` is linked with each ``sink`` of its portfolio.

    Portfolios without both have no rows. ``relays_of`` expands the links of one skill or of some.
    """
    rows = skills.select("portfolio_id", "skill_ord", F.when(hit(text, R.READS_SECRET), "source").alias("a"), F.when(hit(text, R.SENDS), "sink").alias("b"))
    one = rows.filter(F.col("a").isNull() != F.col("b").isNull()).select("portfolio_id", "skill_ord", F.coalesce("a", "b").alias("role"))
    both = one.groupBy("portfolio_id").agg(F.count_distinct("role").alias("n")).filter("n = 2").select("portfolio_id")
    return one.join(both, "portfolio_id", "left_semi").select("portfolio_id", "skill_ord", "role")


def relays_of(members: DataFrame, asked: DataFrame) -> DataFrame:
    """``portfolio_id, source, sink``: the relays that the skills of ``asked`` (``portfolio_id, skill_ord``) take part in, as many as these have."""
    mine = members.join(asked.select("portfolio_id", "skill_ord").distinct(), ["portfolio_id", "skill_ord"])
    other = members.select("portfolio_id", F.col("skill_ord").alias("other"), F.col("role").alias("other_role"))
    met = mine.join(other, "portfolio_id").filter("role <> other_role")
    source = F.when(F.col("role") == "source", F.col("skill_ord")).otherwise(F.col("other"))
    return met.select("portfolio_id", source.alias("source"), F.when(F.col("role") == "source", F.col("other")).otherwise(F.col("skill_ord")).alias("sink")).distinct()


def sharing_members(skills: DataFrame, values: Column) -> DataFrame:
    """``portfolio_id, value, skill_ord, n_skills, first``: who shares a value, one row per skill and value: any two rows of a value are linked. ``first`` stands for the class."""
    each = skills.select("portfolio_id", "skill_ord", F.explode(values).alias("value"))
    return each.join(shared_values(skills, values).select("portfolio_id", "value", "n_skills", "first"), ["portfolio_id", "value"])


def bloat(graded: DataFrame) -> DataFrame:
    """Adds each portfolio's upper median of tokens, the bloat threshold, the ratio, and flags; incomplete rows are never bloated."""
    sizes = graded.groupBy("portfolio_id").agg(F.count(F.lit(1)).alias("n"))
    placed = ranked(graded.select("portfolio_id", "tokens_total", "skill_ord"), ["portfolio_id"], [F.col("tokens_total"), F.col("skill_ord")])
    median = placed.join(sizes, "portfolio_id").filter("rank = n div 2 + 1").select("portfolio_id", F.col("tokens_total").alias("median"))
    rows = graded.join(median, "portfolio_id").withColumn("threshold", F.greatest(F.floor(F.col("median") * 1.6 + 0.5), F.lit(350)))
    unsafe = F.col("complete") & ((F.col("gate") == "block") | (F.col("grade") == "F") | F.col("level").isin("high", "critical"))
    review = ~unsafe & (~F.col("complete") | (F.col("gate") == "review") | (F.col("level") == "medium"))
    ratio = F.when(F.col("median") > 0, F.round(F.col("tokens_total") / F.col("median"), 3)).otherwise(F.lit(1.0))
    return rows.withColumns({"unsafe": unsafe, "review": review, "bloated": F.col("complete") & (F.col("tokens_total") > F.col("threshold")), "ratio": ratio})


def listings(skills: DataFrame) -> DataFrame:
    """One row per portfolio and harness that has skills there: what the listing costs, what it may, and what gives way.

    ``skills`` has ``portfolio_id, skill_ord, name, description, source``. Entries lose their description in order of cost, the
    dearest first, until the rest fits; where the harness keeps names, a name still costs.
    """
    harness = F.when(F.lower("source").contains("codex"), "codex").when(F.lower("source").contains("claude"), "claude-code")
    rows = skills.withColumn("harness", harness).filter("harness is not null")
    keeps = F.col("harness") == "claude-code"
    rows = rows.withColumns({"cost": listing_tokens(F.concat_ws(" ", "name", "description")) + 4, "bare": F.when(keeps, listing_tokens(F.col("name")) + 4).otherwise(0), "long": keeps & (F.length("description") > 1536)})
    key = ["portfolio_id", "harness"]
    rows = cut(rows.select(*key, "skill_ord", "cost", "bare", "long"), "listed")
    placed = ranked(rows, key, [-F.col("cost"), F.col("skill_ord")], add=F.col("cost") - F.col("bare"))
    goes = placed.join(rows.groupBy(*key).agg(F.sum("cost").alias("total")), key).withColumn("goes", F.col("total") - F.col("before") > 2000)
    found = goes.groupBy("portfolio_id", "harness").agg(F.count(F.lit(1)).alias("n_skills"), F.sum("cost").alias("tokens"), F.count_if("goes").alias("n_dropped"), F.count_if("long").alias("n_over_long"))
    return found.withColumns({"budget": F.lit(2000), "over_by": F.greatest(F.lit(0), F.col("tokens") - 2000), "cliff": F.floor(F.lit(2000) / (F.col("tokens") / F.col("n_skills"))), "ratio": F.round(F.col("tokens") / 2000, 3)})
