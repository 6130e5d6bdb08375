"""Queries over single skills: parsing, tokens, axes, findings, grades and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skillcorpus.functions import chinese as Z
from skillcorpus.functions import rules as R
from skillcorpus.functions import text as T
from skillcorpus.operators import analysis as A
from skillcorpus.operators.localize import dictionary, localized
from skillcorpus.plans import sql as S
from skillcorpus.plans.inputs import analysed
from skillcorpus.plans.registry import query
from skillcorpus.sources import adapters
from skillcorpus.sources.tables import table

KEY = ["portfolio_id", "skill_ord"]


def joined(c) -> F.Column:
    return F.array_join(c, "|")


@query(S.given("pf", "SELECT portfolio_id, skill_ord, has_frontmatter, fm_name, description, tools_raw, length(body)::BIGINT AS n_body FROM pf"))
def fm_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frontmatter of all skills."""
    return A.parse(adapters.skills(spark, sf_dir)).select(*KEY, "has_frontmatter", "fm_name", "description", "tools_raw", F.length("body").cast("long").alias("n_body"))


@query(S.given("ax", "SELECT portfolio_id, skill_ord, array_to_string(tools, '|') AS tools FROM ax WHERE tools_raw <> ''"))
def fm_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bare names of the declared tools."""
    rows = A.parse(adapters.skills(spark, sf_dir)).filter("tools_raw <> ''")
    return rows.select(*KEY, joined(A.allowed_tools(F.col("tools_raw"))).alias("tools"))


@query(S.given("ax", "SELECT portfolio_id, skill_ord, tokens_total, tokens_desc, tokens_body FROM ax"))
def tok_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token estimates of document, description and body."""
    rows = A.parse(adapters.skills(spark, sf_dir))
    return rows.select(*KEY, *[T.estimate_tokens(F.col(c)).alias(n) for c, n in (("text", "tokens_total"), ("description", "tokens_desc"), ("body", "tokens_body"))])


@query(S.given("pf", f"SELECT portfolio_id, skill_ord, {S.listing('(fm_name || chr(32) || description)')} + 4 AS listing_cost FROM pf"))
def tok_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a skill's entry costs in the listing that an agent always reads."""
    rows = A.parse(adapters.skills(spark, sf_dir))
    return rows.select(*KEY, (T.listing_tokens(F.concat_ws(" ", "fm_name", "description")) + 4).alias("listing_cost"))


@query(S.given("ax", "SELECT portfolio_id, skill_ord, structure FROM ax"))
def struct_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the structure axis."""
    return analysed(spark, sf_dir).select(*KEY, "structure")


@query(S.given("ax", "SELECT portfolio_id, skill_ord, trigger, len(broad_words)::INT AS n_broad FROM ax"))
def trig_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the trigger axis."""
    return analysed(spark, sf_dir).select(*KEY, "trigger", F.size("broad_words").alias("n_broad"))


@query(S.given("ax", "SELECT portfolio_id, skill_ord, tokens, n_repeated, n_lines::INT AS n_lines, n_headings::INT AS n_headings, defers FROM ax"))
def tokens_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the token axis and what moves it."""
    return analysed(spark, sf_dir).select(*KEY, "tokens", "n_repeated", "n_lines", F.col("n_headings").cast("int").alias("n_headings"), "defers")


@query(S.given("ax", "SELECT portfolio_id, skill_ord, array_to_string(over_tools, '|') AS over_tools, no_bash FROM ax WHERE len(tools) > 0"))
def tool_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tools declared without use, and shell blocks without Bash declared."""
    rows = analysed(spark, sf_dir).filter(F.size("tools") > 0)
    no_bash = F.exists("quality_findings", lambda f: f["title"] == "Uses shell but doesn’t declare Bash in allowed-tools")
    return rows.select(*KEY, joined("over_tools").alias("over_tools"), no_bash.alias("no_bash"))


@query(S.given("ax", "SELECT portfolio_id, skill_ord, array_to_string(list_sort(missing_refs), '|') AS missing_refs FROM ax WHERE len(missing_refs) > 0"))
def ref_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Referenced files that the bundle lacks."""
    return analysed(spark, sf_dir).filter("size(missing_refs) > 0").select(*KEY, joined(F.array_sort("missing_refs")).alias("missing_refs"))


@query(S.given("ht", "SELECT skill_ord, id, severity, category, title FROM ht"))
def risk_hits_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of all risk rules, without context guards."""
    rows = A.parse(adapters.skills(spark, sf_dir))
    return rows.select("skill_ord", F.inline(A.rule_hits(F.col("text"))))


@query(S.given("rk", "SELECT skill_ord, n_tag_chars::INT AS n_tag_chars, n_tag_chars >= 4 AS smuggles FROM rk4"))
def risk_tagchars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invisible tag characters in skills."""
    n = F.regexp_count("text", F.lit(r"[\x{E0000}-\x{E007F}]"))
    return A.parse(adapters.skills(spark, sf_dir)).select("skill_ord", n.alias("n_tag_chars"), (n >= 4).alias("smuggles"))


@query(S.given("rk", "SELECT skill_ord, bool_or(severity = 'critical') AS critical, bool_or(severity = 'medium') AS verify FROM fr WHERE title LIKE 'Credential read +%' OR title LIKE 'Reads credentials and%' GROUP BY skill_ord"))
def risk_exfil_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skills that read secrets and reach the network: a chain, or a destination to verify."""
    rows = analysed(spark, sf_dir).select("skill_ord", F.explode("findings").alias("f"))
    rows = rows.filter(F.col("f.title").startswith("Credential read +") | F.col("f.title").startswith("Reads credentials and"))
    return rows.groupBy("skill_ord").agg(F.bool_or(F.col("f.severity") == "critical").alias("critical"), F.bool_or(F.col("f.severity") == "medium").alias("verify"))


_CAP_ROWS = " UNION ALL ".join(f"SELECT skill_ord, '{c}' AS cap, c_{c} AS severity FROM cp WHERE c_{c} IS NOT NULL" for c in dict.fromkeys(b[0] for b in R.BEHAVIORS))


@query(S.given("cp", _CAP_ROWS))
def script_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capabilities of fenced scripts with their worst severity."""
    return analysed(spark, sf_dir).select("skill_ord", F.explode("capabilities").alias("c")).select("skill_ord", "c.cap", "c.severity")


@query(S.given("rk", "SELECT skill_ord, contradiction FROM rk4 WHERE contradiction IS NOT NULL"))
def claim_contradiction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptions that claim what the body does not hold."""
    return analysed(spark, sf_dir).filter("contradiction is not null").select("skill_ord", "contradiction")


@query(S.given("an", "SELECT skill_ord, risk FROM an"))
def risk_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the risk axis."""
    return analysed(spark, sf_dir).select("skill_ord", "risk")


@query(S.given("an", "SELECT skill_ord, level, gate FROM an"))
def risk_level_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk levels and gates."""
    return analysed(spark, sf_dir).select("skill_ord", "level", "gate")


@query(S.given("an", "SELECT portfolio_id, skill_ord, structure, trigger, tokens, risk, score, gate, grade, loadable, evidence FROM an"))
def grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades of all skills."""
    return analysed(spark, sf_dir).select(*KEY, "structure", "trigger", "tokens", "risk", "score", "gate", "grade", "loadable", "evidence")


@query(S.given("an", "SELECT portfolio_id, gate, grade, count(*) AS n FROM an GROUP BY ALL"))
def grade_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of graded skills by portfolio, gate and grade."""
    return analysed(spark, sf_dir).groupBy("portfolio_id", "gate", "grade").agg(F.count(F.lit(1)).alias("n"))


@query(S.given("rk", f"SELECT skill_ord, title, {S.kind('severity', 'category')} AS kind FROM fr"))
def finding_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each risk finding is a threat, a capability or a defect."""
    rows = analysed(spark, sf_dir).select("skill_ord", F.inline(F.concat("risk_findings", "notes")))
    return rows.select("skill_ord", "title", A.finding_kind(F.col("severity"), F.col("category")).alias("kind"))


_VECTOR = "'SMV:2.0/S:' || structure || '/T:' || trigger || '/K:' || tokens || '/R:' || risk || '/O:' || score || '/G:' || grade || '/GATE:' || upper(left(gate, 1)) || '/E:' || evidence || CASE WHEN level = 'critical' THEN '/X:1' ELSE '' END || CASE WHEN loadable THEN '' ELSE '/L:0' END"


@query(S.given("an", f"SELECT skill_ord, {_VECTOR} AS vector FROM an"))
def vector_make(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grade vectors."""
    return analysed(spark, sf_dir).select("skill_ord", "vector")


#: Every ninth vector gets another score, every eleventh loses an axis.
_TAMPER = "CASE WHEN skill_ord % 9 = 0 THEN regexp_replace(vector, '/O:[0-9]+', '/O:7') WHEN skill_ord % 11 = 0 THEN regexp_replace(vector, '/K:[0-9]+', '') ELSE vector END"
_AGAIN = S.clamp("s * 0.25::DOUBLE + t * 0.45::DOUBLE + k * 0.3::DOUBLE - (100 - r)")


@query(S.given("an", rf"""v0 AS (SELECT skill_ord, {_VECTOR} AS vector FROM an), v1 AS (SELECT skill_ord, {_TAMPER} AS vector FROM v0),
v2 AS (SELECT *, try_cast(regexp_extract(vector, '/S:([^/]+)', 1) AS INT) AS s, try_cast(regexp_extract(vector, '/T:([^/]+)', 1) AS INT) AS t, try_cast(regexp_extract(vector, '/K:([^/]+)', 1) AS INT) AS k, try_cast(regexp_extract(vector, '/R:([^/]+)', 1) AS INT) AS r,
 try_cast(regexp_extract(vector, '/O:([^/]+)', 1) AS INT) AS o, regexp_extract(vector, '/G:([^/]+)', 1) AS g, regexp_extract(vector, '/GATE:([^/]+)', 1) AS gate, vector LIKE '%/X:1%' AS x, vector NOT LIKE '%/L:0%' AS l FROM v1),
v3 AS (SELECT *, {_AGAIN} AS again FROM v2 WHERE s IS NOT NULL AND t IS NOT NULL AND k IS NOT NULL AND r IS NOT NULL)
---
SELECT skill_ord, again AS again_score, CASE WHEN gate = 'B' OR x THEN 'F' WHEN again >= 85 THEN 'A' WHEN again >= 72 THEN 'B' WHEN again >= 58 THEN 'C' WHEN again >= 42 OR l THEN 'D' ELSE 'F' END AS again_grade,
 o = again AND g = CASE WHEN gate = 'B' OR x THEN 'F' WHEN again >= 85 THEN 'A' WHEN again >= 72 THEN 'B' WHEN again >= 58 THEN 'C' WHEN again >= 42 OR l THEN 'D' ELSE 'F' END AS reproducible FROM v3
UNION ALL SELECT skill_ord, NULL, NULL, NULL FROM v2 WHERE k IS NULL"""))
def vector_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published vectors, some tampered with, re-derived."""
    rows = analysed(spark, sf_dir).select("skill_ord", F.expr(_TAMPER).alias("vector"))
    return A.vector_parse(rows).select("skill_ord", "again_score", "again_grade", "reproducible")


@query(S.given("an", rf"""v0 AS (SELECT skill_ord, score, {_VECTOR} AS vector FROM an), v1 AS (SELECT skill_ord, score, {_TAMPER} AS vector FROM v0)
---
SELECT count(*) AS n, count(*) FILTER (WHERE vector NOT LIKE '%/K:%') AS malformed, count(*) FILTER (WHERE vector LIKE '%/O:7/%' AND vector LIKE '%/K:%' AND skill_ord % 9 = 0 AND score <> 7) AS changed FROM v1"""))
def job_vector_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many published vectors do not parse, or do not derive to what they say."""
    rows = A.vector_parse(analysed(spark, sf_dir).select("skill_ord", F.expr(_TAMPER).alias("vector")))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("reproducible").isNull(), 1)).alias("malformed"), F.count(F.when(~F.col("reproducible"), 1)).alias("changed"))


_METHODS = [("published", 0.25, 0.45, 0.3, 85, 72, 58, 42), ("even", 0.34, 0.33, 0.33, 85, 72, 58, 42), ("strict", 0.25, 0.45, 0.3, 90, 80, 70, 60)]
_BAND = "CASE WHEN gate = 'block' THEN 'F' WHEN sc >= a THEN 'A' WHEN sc >= b THEN 'B' WHEN sc >= c THEN 'C' WHEN sc >= d OR loadable THEN 'D' ELSE 'F' END"


@query(S.given("an", f"""m(method, ws, wt, wk, a, b, c, d) AS (VALUES {", ".join(str(m) for m in _METHODS)}), g AS (SELECT m.*, an.gate, an.grade, an.loadable, {S.clamp("structure * ws::DOUBLE + trigger * wt::DOUBLE + an.tokens * wk::DOUBLE - (100 - risk)")} AS sc FROM an, m)
---
SELECT method, grade, {_BAND} AS other, count(*) AS n FROM g GROUP BY ALL"""))
def job_methodology_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades under other weights and cuts: how many skills change band."""
    methods = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(m, ("method", "ws", "wt", "wk", "a", "b", "c", "d"), strict=True)]) for m in _METHODS])
    rows = analysed(spark, sf_dir).select("structure", "trigger", "tokens", "risk", "gate", "grade", "loadable", F.inline(methods))
    rows = rows.withColumn("sc", A.clamp(F.col("structure") * F.col("ws") + F.col("trigger") * F.col("wt") + F.col("tokens") * F.col("wk") - (100 - F.col("risk"))))
    return rows.groupBy("method", "grade", F.expr(_BAND).alias("other")).agg(F.count(F.lit(1)).alias("n"))


@query(S.given("pf", f"SELECT skill_ord, array_to_string(list_sort({S.trigger_tokens('description')}), '|') AS tokens FROM pf"))
def stem_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trigger tokens of descriptions."""
    return A.parse(adapters.skills(spark, sf_dir)).select("skill_ord", joined(F.array_sort(T.trigger_tokens(F.col("description")))).alias("tokens"))


@query(S.given("gl", f"SELECT goal_id, array_to_string(list_sort({S.goal_tokens('goal')}), '|') AS tokens FROM gl"))
def goal_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Goal tokens of goals."""
    return adapters.goals_from_benchmark(table(spark, sf_dir, "benchmark")).select("goal_id", joined(F.array_sort(T.goal_tokens(F.col("goal")))).alias("tokens"))


_SEARCHABLE = "(replace(name, '-', ' ') || ' ' || description || ' ' || category)"


@query(S.given("cat", f"SELECT ord, array_to_string(list_sort({S.match_tokens(_SEARCHABLE)}), '|') AS tokens FROM cat"))
def match_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search words of catalog skills."""
    words = T.match_tokens(F.concat_ws(" ", F.replace("name", F.lit("-"), F.lit(" ")), "description", "category"))
    return adapters.catalog_from_documents(table(spark, sf_dir, "documents")).select("ord", joined(F.array_sort(words)).alias("tokens"))


# Stages and capability hints of catalog texts.
STAGES = [("deliver", "deploy|launch|release|ship|publish|deliver"), ("verify", "review|verify|verification|debug|test|audit|quality"), ("discover", r"research|discover|brainstorm|strategy|planning|plan\b|analysis"), ("produce", "build|create|design|write|content|frontend|generate|implement")]
HINTS = [
    ("network", r"(?i)\b(?:network|internet|web|browse|browser|search|research|competitive|intelligence|market|fetch|scrap|crawl|http|online|github|cloud)\b|联网|网络|网页|搜索|调研|市场"),
    ("exec", r"(?i)\b(?:shell|terminal|command|execute|exec|subprocess|script)\b|命令|终端|执行"), ("install", r"(?i)\b(?:install|package|dependency|npm|pip|brew)\b|安装|依赖|软件包"),
    ("secret", r"(?i)\b(?:secret|credential|api.?key|token|password)\b|密钥|凭证|密码"), ("filesystem", r"(?i)\b(?:filesystem|file|directory|folder|write|edit)\b|文件|目录|写入|编辑"),
]


@query(S.given("pf", "SELECT skill_ord, CASE " + " ".join(f"WHEN regexp_matches(lower(fm_name || ' ' || description), {S.sql_text(p)}) THEN '{n}'" for n, p in STAGES) + " ELSE 'general' END AS stage FROM pf"))
def skill_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stage of work that a skill is for."""
    return A.parse(adapters.skills(spark, sf_dir)).select("skill_ord", stage_of(F.concat_ws(" ", "fm_name", "description")).alias("stage"))


def stage_of(text) -> F.Column:
    out, low = None, F.lower(text)
    for name, pattern in STAGES:
        cond = F.rlike(low, F.lit(T.edges(pattern)))
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise("general")


def hinted_caps(text) -> F.Column:
    return F.array_compact(F.array(*[F.when(A.hit(text, p), F.lit(n)) for n, p in HINTS]))


@query(S.given("pf", "SELECT skill_ord, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {S.matches('(fm_name || chr(32) || description)', p)} THEN '{n}' END" for n, p in HINTS) + "], lambda x: x IS NOT NULL), '|') AS caps FROM pf"))
def inferred_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capabilities that a skill's text hints at."""
    return A.parse(adapters.skills(spark, sf_dir)).select("skill_ord", joined(hinted_caps(F.concat_ws(" ", "fm_name", "description"))).alias("caps"))


_ELIGIBLE = "grade IN ('A', 'B') AND gate = 'pass' AND risk = 'low'"
_RUNTIME = "CASE WHEN ord % 6 = 0 AND tokens > 0 THEN 'runtime-verified' WHEN ord % 6 < 2 THEN 'incomplete' ELSE 'not-tested' END"
_EVIDENCE = "CASE ord % 4 WHEN 0 THEN 'full-bundle' WHEN 1 THEN 'manifest-only' ELSE 'unknown' END"


@query(S.given("cat", f"SELECT ord, {_ELIGIBLE} AS eligible, {_RUNTIME} AS runtime, {_EVIDENCE} AS evidence, CASE WHEN {_RUNTIME} = 'runtime-verified' THEN 'verified-here' ELSE 'inspected' END AS status FROM cat"))
def trust_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which catalog skills may be matched automatically, and how far they are evidenced.

    A run counts as verified if it is measured with environment, harness, model and trials all known, and as incomplete
    if it is measured without; here measured runs and scopes follow from the ordinal.
    """
    cat = adapters.catalog_from_documents(table(spark, sf_dir, "documents")).withColumns({"measured": F.col("ord") % 6 < 2, "trials": F.when(F.col("ord") % 6 == 0, F.col("tokens")), "scope": F.get(F.array(F.lit("bundle"), F.lit("manifest")), (F.col("ord") % 4).cast("int"))})
    runtime = F.when(F.col("measured") & (F.coalesce("trials", F.lit(0)) > 0), "runtime-verified").when(F.col("measured"), "incomplete").otherwise("not-tested")
    evidence = F.when(F.col("scope") == "bundle", "full-bundle").when(F.col("scope") == "manifest", "manifest-only").otherwise("unknown")
    rows = cat.select("ord", F.expr(_ELIGIBLE).alias("eligible"), runtime.alias("runtime"), evidence.alias("evidence"))
    return rows.withColumn("status", F.when(F.col("runtime") == "runtime-verified", "verified-here").otherwise("inspected"))


@query(S.given("cat", f"SELECT category, pool, CASE WHEN count(DISTINCT {_EVIDENCE}) = 1 THEN min({_EVIDENCE}) ELSE 'mixed' END AS evidence, count(*) AS n FROM cat GROUP BY category, pool"))
def combo_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Package evidence of combinations: one label if all members share it, else mixed."""
    cat = adapters.catalog_from_documents(table(spark, sf_dir, "documents"))
    found = cat.groupBy("category", "pool").agg(F.collect_set(F.expr(_EVIDENCE)).alias("labels"), F.count(F.lit(1)).alias("n"))
    return found.select("category", "pool", F.when(F.size("labels") == 1, F.get("labels", F.lit(0))).when(F.size("labels") > 1, "mixed").otherwise("unknown").alias("evidence"), "n")


@query("SELECT doc_id, regexp_replace(regexp_replace(chr(27) || '[31m' || text || chr(8203) || chr(7), '\\x{1b}\\[[0-?]*[ -/]*[@-~]', '', 'g'), '[\\x{00}-\\x{1f}\\x{7f}-\\x{9f}\\x{200b}-\\x{200f}\\x{202a}-\\x{202e}\\x{2060}-\\x{2069}\\x{feff}\\x{e0000}-\\x{e007f}]', '', 'g') AS label FROM documents")
def text_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts, put between an escape and invisible characters, freed from such."""
    raw = F.concat(F.lit("\x1b[31m"), F.col("text"), F.lit("​\x07"))
    return table(spark, sf_dir, "documents").select("doc_id", T.text_safe(raw).alias("label"))


@query(S.given("cat", f"SELECT ord, name, pool FROM cat WHERE {_ELIGIBLE}"))
def flt_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog skills that pass the trust filter."""
    return adapters.catalog_from_documents(table(spark, sf_dir, "documents")).filter(F.expr(_ELIGIBLE)).select("ord", "name", "pool")


_STUB = "(?i)deprecated|redirect|router for|index and router|central router"


@query(S.given("cat", f"SELECT ord, name FROM cat WHERE NOT regexp_matches(description, '{_STUB}')"))
def flt_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog skills that are not mere pointers to others."""
    return adapters.catalog_from_documents(table(spark, sf_dir, "documents")).filter(~F.rlike("description", F.lit(_STUB))).select("ord", "name")


@query(S.given("an", "SELECT skill_ord, CASE WHEN complete THEN grade ELSE '?' END AS grade, CASE WHEN complete THEN gate ELSE 'review' END AS gate, complete AND (gate = 'block' OR grade = 'F' OR level IN ('high', 'critical')) AS unsafe FROM an"))
def flt_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades that fail closed where a bundle was not read in full."""
    complete = F.col("complete")
    unsafe = complete & ((F.col("gate") == "block") | (F.col("grade") == "F") | F.col("level").isin("high", "critical"))
    return analysed(spark, sf_dir).select("skill_ord", F.when(complete, F.col("grade")).otherwise("?").alias("grade"), F.when(complete, F.col("gate")).otherwise("review").alias("gate"), unsafe.alias("unsafe"))


_ZH = "z(en, zh) AS (VALUES " + ", ".join(f"({S.sql_text(a)}, {S.sql_text(b)})" for a, b in Z.TITLES.items()) + "), c(en, zh) AS (VALUES " + ", ".join(f"({S.sql_text(a)}, {S.sql_text(b)})" for a, b in Z.CAPABILITIES.items()) + ")"


@query(S.given("ht", _ZH + """, t AS (SELECT skill_ord, id, title FROM ht)
---
SELECT skill_ord, id, coalesce(zh, title) || CASE WHEN skill_ord % 3 = 1 THEN ' —— 出现在警告里' ELSE '' END AS title FROM t LEFT JOIN z ON en = title
UNION ALL SELECT DISTINCT skill_ord, 'edit', CASE skill_ord % 4 WHEN 0 THEN '删除了 ' || skill_ord || ' 行重复内容' WHEN 1 THEN '触发描述更精准了 —— 评分从 C 提到 A' WHEN 2 THEN '正文压缩 ' || (skill_ord % 90) || '% —— 2,' || (100 + skill_ord % 800) || ' → ' || skill_ord || ' token' ELSE 'Removed 3 odd words' END FROM t
UNION ALL SELECT DISTINCT skill_ord, 'capability', CASE WHEN skill_ord % 5 = 0 THEN '脚本能力：juggles' ELSE '脚本能力：' || zh END FROM t, c WHERE c.en = CASE WHEN skill_ord % 2 = 0 THEN 'reads secrets' ELSE 'network egress' END"""))
def localize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles, edits with numbers and capabilities in Chinese where there is an entry, else as they are; some titles stand in a warning."""
    k = F.col("skill_ord")
    hits = A.parse(adapters.skills(spark, sf_dir)).select("skill_ord", F.inline(A.rule_hits(F.col("text"))))
    titles = hits.select("skill_ord", "id", F.concat("title", F.when(k % 3 == 1, Z.WARNED[0]).otherwise("")).alias("text"))
    ids = titles.select("skill_ord").distinct()
    edit = F.when(k % 4 == 0, F.concat(F.lit("Removed "), k, F.lit(" duplicate lines"))).when(k % 4 == 1, F.lit("Grade C → A — sharper description/trigger")).when(k % 4 == 2, F.concat(F.lit("−"), k % 90, F.lit("% tokens (2,"), 100 + k % 800, F.lit(" → "), k, F.lit(")"))).otherwise(F.lit("Removed 3 odd words"))
    capability = F.concat(F.lit(Z.CAPABILITY[0]), F.when(k % 5 == 0, "juggles").when(k % 2 == 0, "reads secrets").otherwise("network egress"))
    rows = titles.union(ids.select("skill_ord", F.lit("edit"), edit)).union(ids.select("skill_ord", F.lit("capability"), capability))
    return localized(rows, "text", dictionary(spark)).select("skill_ord", "id", F.col("zh").alias("title"))


_LOCATED = " UNION ALL ".join(f"SELECT skill_ord, '{r.id}' AS id, {S.sql_text(r.sql)} AS p FROM pf WHERE {S.matches('text', r.sql)}" for r in R.RISK_RULES if r.id in ("r25", "r34", "r35", "r36", "r38"))


@query(S.given("pf", rf"""h AS ({_LOCATED}), m AS (SELECT h.skill_ord, h.id, text, CASE id {" ".join(f"WHEN '{r.id}' THEN regexp_extract(text, {S.sql_text(r.sql)}, 0)" for r in R.RISK_RULES if r.id in ("r25", "r34", "r35", "r36", "r38"))} END AS found FROM h JOIN pf USING (skill_ord))
---
SELECT skill_ord, id, (length(left(text, instr(text, found) - 1)) - length(replace(left(text, instr(text, found) - 1), chr(10), '')) + 1)::INT AS line, CASE WHEN length(snip) > 160 THEN left(snip, 157) || '…' ELSE snip END AS snippet
 FROM (SELECT *, trim(regexp_replace(found, '\s+', ' ', 'g')) AS snip FROM m)"""))
def evidence_locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a rule hits: the line, and what stands there in one line of 160 characters at most."""
    chosen = [r for r in R.RISK_RULES if r.id in ("r25", "r34", "r35", "r36", "r38")]
    rows = A.parse(adapters.skills(spark, sf_dir)).select("skill_ord", "text", F.explode(F.array(*[F.struct(F.lit(r.id).alias("id"), F.regexp_extract("text", T.edges(r.sql), 0).alias("found")) for r in chosen])).alias("m")).filter("m.found <> ''")
    line = F.size(F.split(F.left("text", F.instr("text", F.col("m.found")) - 1), "\n", -1))
    snip = F.trim(F.regexp_replace("m.found", r"\s+", " "))
    return rows.select("skill_ord", "m.id", line.alias("line"), F.when(F.length(snip) > 160, F.concat(F.left(snip, F.lit(157)), F.lit("…"))).otherwise(snip).alias("snippet"))
