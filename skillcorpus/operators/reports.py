"""Reports: what is published of a scan, and reports from others, made safe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Known enums, and the most that a report from others may hold of each list.
SEVERITIES = ["critical", "high", "medium", "low"]
GRADES = ["A", "B", "C", "D", "F"]
KINDS = ["shadow", "overlap"]
MOST = {"skills": 300, "findings": 40, "conflicts": 100, "shared": 12, "locations": 20, "broad": 40, "changes": 40}


def labels(rows: DataFrame) -> DataFrame:
    """Adds ``label``: the ordinal of a skill in its portfolio; a name that occurs twice has that of its last row."""
    i = F.row_number().over(Window.partitionBy("portfolio_id").orderBy("skill_ord"))
    return rows.withColumn("i", i).withColumn("label", F.concat(F.lit("skill-"), F.max("i").over(Window.partitionBy("portfolio_id", "fm_name"))))


def published(rows: DataFrame, conflicts: DataFrame, reason: Column) -> DataFrame:
    """The anonymous report in parts (``skill``, ``conflict``, ``broad``): ordinal labels and verdicts, no names, paths, titles or texts.

    ``rows`` are graded skills with flags (``portfolio.bloat``) and ``broad``; both sides of ``conflicts`` carry labels, and not what they share.
    """
    named = labels(rows)
    done = F.col("complete")
    kinds = F.array_join(F.array_sort(F.transform("findings", lambda f: F.concat_ws(":", f["severity"], f["category"]))), "|")
    none = lambda name, kind="string": F.lit(None).cast(kind).alias(name)
    skills = named.select(
        "portfolio_id", F.lit("skill").alias("part"), "label", none("other"), none("kind"), none("severity"), "tokens_total", F.when(done, F.col("grade")).otherwise("?").alias("grade"), "unsafe", "review", "bloated", "ratio",
        reason.alias("reason"), kinds.alias("findings"),
    )
    rest = [none(c, skills.schema[c].dataType.simpleString()) for c in skills.columns[6:]]
    side = lambda s, name: named.select("portfolio_id", F.col("skill_ord").alias(s), F.col("label").alias(name))
    joined = conflicts.select("portfolio_id", "a", "b", "kind", "severity").join(side("a", "label"), ["portfolio_id", "a"]).join(side("b", "other"), ["portfolio_id", "b"])
    pairs = joined.select("portfolio_id", F.lit("conflict").alias("part"), "label", "other", "kind", "severity", *rest)
    broad = named.filter("broad").select("portfolio_id", F.lit("broad").alias("part"), "label", none("other"), none("kind"), none("severity"), *rest)
    return skills.unionByName(pairs).unionByName(broad)


def _at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, f"$.{path}", "variant")


def _text(v: Column, most: int) -> Column:
    """A string, cut; what is no string is empty."""
    return F.when(F.schema_of_variant(v) == "STRING", F.left(F.try_variant_get(v, "$", "string"), F.lit(most))).otherwise("")


def _number(v: Column) -> Column:
    """A finite number, also from a numeric string or a boolean; else 0."""
    x = F.try_variant_get(v, "$", "double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def _one_of(v: Column, known: list[str], default: str) -> Column:
    x = _text(v, 40)
    return F.when(x.isin(known), x).otherwise(default)


def _true(v: Column) -> Column:
    """Only a literal true is true."""
    return (F.schema_of_variant(v) == "BOOLEAN") & F.coalesce(F.try_variant_get(v, "$", "boolean"), F.lit(False))


def _list(v: Column, path: str) -> Column:
    """The first items of a list; what is no list has none."""
    of = F.try_variant_get(v, f"$.{path}", "array<variant>")
    return F.slice(F.coalesce(of, F.array().cast("array<variant>")), 1, MOST[path.rsplit(".", 1)[-1]])


def harden(rows: DataFrame, raw: str) -> DataFrame:
    """Reads a report from JSON text into ``report``, trusting nothing: enums are known values or the default, numbers finite, strings and lists cut.

    A report has ``skills`` (with ``findings``, and ``changes`` where it lists any), ``conflicts``, ``locations``, ``broad`` and totals. Fields that are not known are
    left out. A list is a report
    without fields; other values, and what is no JSON, are no report (null).
    """
    report = F.try_parse_json(raw)
    v = F.col("__report")
    safe = lambda x, name, most: _text(_at(x, name), most).alias(name)
    finding = lambda f: F.struct(_one_of(_at(f, "severity"), SEVERITIES, "low").alias("severity"), safe(f, "category", 40), safe(f, "title", 200), safe(f, "detail", 500))
    given = lambda x, name, value: F.when(_at(x, name).isNotNull(), value).alias(name)
    skill = lambda s: F.struct(
        safe(s, "name", 120), safe(s, "source", 80), safe(s, "path", 200), F.transform(_list(s, "a.findings"), finding).alias("findings"), _number(_at(s, "tokens")).alias("tokens"), _one_of(_at(s, "grade"), GRADES, "F").alias("grade"),
        *[F.coalesce(_true(_at(s, c)), F.lit(False)).alias(c) for c in ("unsafe", "review", "bloated")], _number(_at(s, "bloatRatio")).alias("bloatRatio"), safe(s, "reason", 200),
        given(s, "optTokens", _number(_at(s, "optTokens"))), given(s, "savedPct", _number(_at(s, "savedPct"))), given(s, "changes", F.transform(_list(s, "changes"), lambda c: _text(c, 200))),
    )
    conflict = lambda c: F.struct(safe(c, "a", 120), safe(c, "b", 120), _one_of(_at(c, "kind"), KINDS, "overlap").alias("kind"), F.transform(_list(c, "shared"), lambda x: _text(x, 40)).alias("shared"))
    place = lambda p: F.struct(safe(p, "source", 80), safe(p, "dir", 200), _number(_at(p, "count")).alias("count"))
    made = F.struct(
        safe(v, "generatedAt", 40), F.transform(_list(v, "locations"), place).alias("locations"), F.transform(_list(v, "skills"), skill).alias("skills"), F.transform(_list(v, "conflicts"), conflict).alias("conflicts"),
        F.transform(_list(v, "broad"), lambda x: _text(x, 60)).alias("broad"), _number(_at(v, "median")).alias("median"), _number(_at(v, "bloatThresh")).alias("bloatThresh"), F.coalesce(_true(_at(v, "optimizable")), F.lit(False)).alias("optimizable"),
        _one_of(_at(v, "lang"), ["en", "zh"], "en").alias("lang"),
    )
    out = rows.withColumn("__report", report).drop(raw)
    nested = F.coalesce(F.try_variant_get(v, "$", "map<string,variant>").isNotNull() | F.try_variant_get(v, "$", "array<variant>").isNotNull(), F.lit(False))
    return out.withColumn("report", F.when(nested, made)).drop("__report")
