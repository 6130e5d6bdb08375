"""Grading of skill documents: frontmatter, quality axes, risk findings, gate, grade and vector, all as column expressions."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skillcorpus.functions import rules as R
from skillcorpus.functions.text import WS, edges, estimate_tokens, half_up, js_trim

FINDING = "struct<severity:string,category:string,title:string>"


def hit(c: Column, pattern: str) -> Column:
    return F.coalesce(F.rlike(c, F.lit(edges(pattern))), F.lit(False))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body has it."""
    return F.transform(F.array(value), body)[0]


def any_hit(texts: Column | str, pattern: str) -> Column:
    return F.exists(texts, lambda c: hit(c, pattern))


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), half_up(c.cast("double")))).cast("int")


def finding(severity: str | Column, category: str, title: str) -> Column:
    return F.struct((F.lit(severity) if isinstance(severity, str) else severity).alias("severity"), F.lit(category).alias("category"), F.lit(title).alias("title"))


def found(*pairs: tuple[Column, Column]) -> Column:
    """The findings whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(cond, f) for cond, f in pairs]))


def frontmatter(block: Column) -> Column:
    """A frontmatter block as a map: keys in lower case, a later key wins, indented lines go on with the value before."""
    put = lambda m, k, v: F.map_concat(F.map_filter(m, lambda x, _: x != k), F.create_map(k, v))

    def step(acc: Column, line: Column) -> Column:
        key = F.lower(F.regexp_extract(line, r"^([A-Za-z0-9_-]+)\s*:\s*(.*)$", 1))
        raw = js_trim(F.regexp_extract(line, r"^([A-Za-z0-9_-]+)\s*:\s*(.*)$", 2))
        value = F.when(F.rlike(raw, F.lit(r"^[|>][+-]?\d*\z")), "").otherwise(F.regexp_replace(raw, r"""^["']|["']\z""", ""))
        more = js_trim(F.concat(F.coalesce(F.element_at(acc["m"], acc["last"]), F.lit("")), F.lit(" "), js_trim(line)))
        return (
            F.when(key != "", F.struct(put(acc["m"], key, value).alias("m"), key.alias("last")))
            .when((acc["last"] != "") & F.rlike(line, F.lit(r"^\s+\S")), F.struct(put(acc["m"], acc["last"], more).alias("m"), acc["last"].alias("last")))
            .otherwise(acc)
        )

    begin = F.struct(F.create_map().cast("map<string,string>").alias("m"), F.lit("").alias("last"))
    return F.aggregate(F.split(block, "\n", -1), begin, step, lambda acc: acc["m"])


def parse(skills: DataFrame) -> DataFrame:
    """Adds ``text`` (line ends normalised, whole), ``has_frontmatter, fm, fm_name, description, tools_raw, body``."""
    text = F.regexp_replace(F.coalesce(F.col("md"), F.lit("")), "\r\n?", "\n")
    head = r"\A\x{feff}?\s*---\s*\n([\s\S]*?)\n---"
    rows = skills.withColumn("text", text).withColumn("__head", F.regexp_extract("text", head, 0)).withColumn("has_frontmatter", F.col("__head") != "")
    rows = rows.withColumn("fm", F.when(F.col("has_frontmatter"), frontmatter(F.regexp_extract("text", head, 1))).otherwise(F.create_map().cast("map<string,string>")))
    get = lambda k: F.element_at("fm", F.lit(k))
    return rows.withColumns({
        "fm_name": F.coalesce(get("name"), F.lit("")), "description": F.coalesce(get("description"), F.lit("")),
        "tools_raw": F.coalesce(get("allowed-tools"), get("allowedtools"), get("allowed_tools"), F.lit("")), "body": F.substr("text", F.length("__head") + 1),
    }).drop("__head")


def allowed_tools(raw: Column) -> Column:
    """Bare tool names of an allowed-tools value, in lower case."""
    parts = F.split(F.regexp_replace(raw, r"^\[|\]$", ""), r"[,\n]|\s-\s|(?<=\))\s+(?=[A-Za-z])", -1)
    name = lambda t: js_trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(js_trim(t), r"^-\s*", ""), r"""^["']|["']$""", ""), r"\([\s\S]*$", ""))
    return F.filter(F.transform(parts, lambda t: F.lower(name(t))), lambda t: t != "")


def missing_references(body: Column, files: Column) -> Column:
    """Distinct referenced bundle paths that are in the bundle neither by path nor by base name; null without a file list."""
    pattern = r"""(?im)(?:^|[\s(`'"\[])\.?\/?((?:references?|scripts?|assets?|templates?|examples?|resources?|data|bin)\/[\w./-]{1,120}?\.[a-z0-9]{1,8})(?![A-Za-z0-9_])"""
    base = lambda p: F.element_at(F.split(p, "/"), -1)
    bare = lambda p: F.lower(F.regexp_replace(p, r"^\./", ""))
    have = F.array_union(F.transform(files, bare), F.transform(files, lambda p: base(bare(p))))
    refs = F.array_distinct(F.regexp_extract_all(body, F.lit(pattern), F.lit(1)))
    return F.when(files.isNotNull(), F.filter(refs, lambda r: ~F.array_contains(have, bare(r)) & ~F.array_contains(have, base(bare(r)))))


def over_declared(tools: Column, body: Column) -> Column:
    """Declared powerful tools that the body shows no sign of using."""
    return F.array_compact(F.array(*[F.when(F.array_contains(tools, t) & ~hit(body, p), F.lit(t)) for t, p in R.TOOL_FOOTPRINTS.items()]))


def broad_words(desc: Column) -> Column:
    """Words of unlimited breadth in a description, each once; those that a concrete condition limits do not count."""
    nouns = R.GENERIC_NOUN.removeprefix("(?i)^")
    scoped = rf"(?:\.?[a-z][\w.+-]*\s+(?:file|files|document|documents)\b|\.[a-z0-9]{{2,6}}\b|the\s+user\b|time\s+(?:a|an|the|you|it)\b|(?:a|an|the|each|this|that)\s+\.?(?!{nouns})[a-z0-9])"
    idiom = r"(?:way|time|point|case|means|manner|form|kind|sort)s?\b"
    words = []
    for w in ("any", "all", "every", "always", "whenever", "anytime", "everytime", "anything", "everything"):
        open_ = rf"(?:(?<!\b(?:in|at|by|of)\s{{0,2}})\b{w}\b|\b{w}\b(?!\s*{idiom}))"
        limit = "" if w in ("anything", "everything", "always") else rf"(?!\s*{scoped})"
        words.append(F.when(hit(desc, f"(?i){open_}{limit}"), F.lit(w)))
    return F.array_compact(F.array(*words))


def repeated_lines(body: Column) -> Column:
    """How many prose lines of more than 24 characters, outside fences, repeat an earlier one."""
    blank = WS.replace(r"\s", r" \t\x0b\f\r")
    fence = rf"(?dm)^{blank}*(?:```|~~~)[^\n]*(?:\n[\s\S]*?)??(?:\n{blank}*(?:```|~~~)[^\n]*|\z)"
    prose = F.when(F.contains(body, F.lit("```")) | F.contains(body, F.lit("~~~")), F.regexp_replace(body, fence, "")).otherwise(body)
    lines = F.filter(F.transform(F.split(prose, "\n", -1), js_trim), lambda x: F.length(x) > 24)
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def axes(parsed: DataFrame) -> DataFrame:
    """Adds tokens, the three quality axes and their findings (``quality_findings``)."""
    d, body, name = F.col("description"), F.col("body"), F.col("fm_name")
    rows = parsed.withColumns({
        "tokens_total": estimate_tokens(F.col("text")), "tokens_desc": estimate_tokens(d), "tokens_body": estimate_tokens(body), "tools": allowed_tools(F.col("tools_raw")),
        "missing_refs": missing_references(body, F.col("bundle_files")), "broad_words": broad_words(d), "n_repeated": repeated_lines(body),
        "n_lines": F.size(F.split(body, "\n", -1)), "n_headings": F.regexp_count(body, F.lit(r"(?m)^#{2,6}\s")),
        "defers": F.rlike("text", F.lit(r"(?i)(^|\n)references?\s*:|references?/")) | hit(body, r"""(?i)\bsee\s+[`'"(]?[\w./-]+\.(?:md|txt)\b|\]\(\s*\.?\/?[\w./-]*(?:references?|docs?)\/|\b(?:progressive disclosure|load(?:ed)? on demand|on-demand|reference files?)\b"""),
    })
    rows = rows.withColumn("over_tools", over_declared(F.col("tools"), body))
    homoglyph, shape, generic = F.rlike(name, F.lit(r"[\x{0400}-\x{04ff}\x{0370}-\x{03ff}]")), F.rlike(name, F.lit(r"^[a-z0-9][a-z0-9-]{0,63}\z")), hit(name, R.GENERIC_NAME)
    named = F.when(name == "", 20).when(homoglyph, 12).when(~shape, 8).when(generic, 8).otherwise(0)
    described = F.when(d == "", 30).when(F.length(d) > 1024, 10).otherwise(0)
    short, plain = F.length(js_trim(body)) < 40, (F.length(body) > 600) & ~F.rlike(body, F.lit(r"(^|\n)#{1,6}\s"))
    first = clamp(100 - F.when(F.col("has_frontmatter"), 0).otherwise(45) - named - described - F.when(short, 15).when(plain, 8).otherwise(0))
    no_bash = (F.size("tools") > 0) & hit(body, r"(?i)```(?:bash|sh|shell|zsh)\b") & ~F.array_contains("tools", "bash")
    dangling = F.coalesce(F.size("missing_refs") > 0, F.lit(False)) & F.col("missing_refs").isNotNull()
    structure = clamp(clamp(first - F.when(no_bash, 6).otherwise(0)) - F.when(dangling, 12).otherwise(0))

    eff = F.length(d) + 3 * F.regexp_count(d, F.lit(r"[\x{3000}-\x{9fff}\x{ac00}-\x{d7a3}\x{f900}-\x{faff}\x{ff00}-\x{ffef}]"))
    rows = rows.withColumn("cue", hit(d, R.TRIGGER_CUES_LATIN) | (F.rlike(d, F.lit("[用时]")) & hit(d, R.TRIGGER_CUES_CJK)))
    rows = rows.withColumns({"silent": ~(F.col("cue") | hit(d, R.TRIGGER_CUES_EXTRA) | hit(d, R.CONCRETE_OPENER)), "filler": hit(d, R.FILLER_WORDS)})
    cue, silent, n_broad = F.col("cue"), F.col("silent"), F.size("broad_words")
    cost = (
        F.when(eff < 40, 35).when(F.length(d) > 500, 20).when(F.length(d) > 350, 8).otherwise(0) + F.when(silent, 25).otherwise(0) + F.least(F.lit(30), 12 * n_broad)
        + F.when(F.col("filler"), 12).otherwise(0) + F.when((F.length(d) < 40) & ~cue & hit(d, R.VAGUE_OPENER), 10).otherwise(0)
    )
    trigger = F.when(d == "", 0).otherwise(clamp(100 - cost))

    curve = clamp(200 - 18 * F.log(F.greatest(F.lit(1), F.col("tokens_total")).cast("double")))
    tokens = F.when(F.col("n_repeated") >= 2, clamp(curve - 10)).otherwise(curve)
    over = (F.col("tokens_body") > 5000) | (F.col("n_lines") > 500)
    monolith = (F.col("tokens_total") > 2500) & (F.col("n_headings") >= 4) & ~F.col("defers")
    named_desc = d != ""
    quality = found(
        (~F.col("has_frontmatter"), finding("medium", "spec", "Missing YAML frontmatter")),
        (name == "", finding("low", "spec", "Missing name field")),
        ((name != "") & homoglyph, finding("medium", "injection", "Possible homoglyph name impersonation")),
        ((name != "") & ~homoglyph & ~shape, finding("low", "spec", "Non-standard name")),
        (shape & generic, finding("low", "trigger", "Vague / generic name")),
        (~named_desc, finding("medium", "spec", "Missing description field")),
        (F.length(d) > 1024, finding("medium", "spec", "Description over the spec limit")),
        (~short & plain, finding("low", "spec", "Body has no section headings")),
        (named_desc & (eff < 40), finding("medium", "trigger", "Description too short / vague")),
        (named_desc & (eff >= 40) & (F.length(d) > 500), finding("low", "trigger", "Description too long")),
        (named_desc & silent, finding("medium", "trigger", "Description doesn’t say WHEN to use it")),
        (named_desc & (n_broad > 0), finding("medium", "trigger", "Trigger is too broad")),
        (named_desc & F.col("filler"), finding("low", "trigger", "Description contains filler")),
        (F.size("over_tools") > 0, finding("low", "privilege", "Over-declared tools (least privilege)")),
        (no_bash, finding("low", "spec", "Uses shell but doesn’t declare Bash in allowed-tools")),
        (dangling, finding("medium", "spec", "References a bundled file that isn’t present")),
        (F.col("tokens_body") > 5000, finding("medium", "bloat", "Over the spec’s body budget")),
        (F.col("n_lines") > 500, finding("medium", "bloat", "Over the spec’s line budget")),
        (F.col("n_repeated") >= 2, finding("low", "bloat", "Repeated content")),
        (monolith & over, finding("medium", "bloat", "Monolithic — should use progressive disclosure")),
        (monolith & ~over, finding("low", "bloat", "Could defer detail to references/")),
    )
    return rows.withColumns({"structure": structure, "trigger": trigger, "tokens": tokens, "quality_findings": quality})


def rule_hit(text: Column, low: Column, rule: R.Rule) -> Column:
    """Whether a rule hits; where its needed literals are known, the pattern only runs on texts that have one of them."""
    here = hit(text, rule.sql)
    needs = [F.contains(low, F.lit(n)) for n in R.NEEDS.get(rule.id, [])]
    return functools.reduce(lambda a, b: a | b, needs) & here if needs else here


def rule_hits(text: Column, rules: list[R.Rule] = R.RISK_RULES, fields: tuple[str, ...] = ("id", "severity", "category", "title")) -> Column:
    """The rules that hit a text, one per title (the first of the table), without context guards."""

    def of(t: Column) -> Column:
        seen: dict[str, Column] = {}
        out = []
        for r in rules:
            here = rule_hit(t["text"], t["low"], r)
            out.append(F.when(here & ~seen[r.title] if r.title in seen else here, F.struct(*[F.lit(getattr(r, f)).alias(f) for f in fields])))
            seen[r.title] = here
        return F.array_compact(F.array(*out))

    return let(F.struct(text.alias("text"), F.lower(text).alias("low")), of)


def fenced(text: Column, pattern: str) -> Column:
    """All fences of a text that a pattern describes; a text without back-ticks is not searched."""
    return F.when(F.contains(text, F.lit("```")), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))


def scripts(text: Column) -> Column:
    """The code of fenced scripts: blocks of a script language, or of none that look like shell."""
    fence = r"```([a-zA-Z0-9_+-]*)[^\n]{0,240}\n([\s\S]*?)```"
    pairs = F.transform(fenced(text, fence), lambda x: F.struct(F.regexp_extract(x, fence, 1).alias("lang"), F.regexp_extract(x, fence, 2).alias("code")))
    is_script = lambda p: F.lower(p["lang"]).isin(R.SCRIPT_LANGS) | ((p["lang"] == "") & F.rlike(p["code"], F.lit(edges(R.SHELLISH))))
    return F.transform(F.filter(pairs, is_script), lambda p: p["code"])


def capabilities(code: Column) -> Column:
    """Capabilities of scripts with their worst severity, worst first, then in table order."""
    per_cap: dict[str, list[tuple[str, str, str]]] = {}
    for cap, severity, label, pattern in R.BEHAVIORS:
        per_cap.setdefault(cap, []).append((severity, label, pattern))
    hits = []
    for i, (cap, rows) in enumerate(per_cap.items()):
        worst = None
        for severity, _, pattern in sorted(rows, key=lambda r: R.SEVERITIES.index(r[0])):
            cond = any_hit(code, pattern)
            worst = F.when(cond, severity) if worst is None else worst.when(cond, severity)
        rank = F.array_position(F.array(*[F.lit(s) for s in R.SEVERITIES]), worst).cast("int")
        hits.append(F.when(worst.isNotNull(), F.struct(rank.alias("rank"), F.lit(i).alias("i"), F.lit(cap).alias("cap"), worst.alias("severity"), F.lit(rows[0][1]).alias("label"))))
    ordered = F.array_sort(F.array_compact(F.array(*hits)))
    return F.transform(ordered, lambda x: F.struct(x["cap"].alias("cap"), x["severity"].alias("severity"), x["label"].alias("label")))


def finding_kind(severity: Column, category: Column) -> Column:
    """threat, capability or quality."""
    return (
        F.when((severity == "critical") | category.isin(R.THREATS), "threat").when((category == "exfil") & (severity == "high"), "threat")
        .when((category == "exfil") | category.isin(R.CAPABILITIES), "capability").otherwise("quality")
    )


def finding_cost(severity: Column, category: Column) -> Column:
    """Points off the risk axis: none for everyday capabilities."""
    cost = F.lit(0)
    for s, c in R.COSTS.items():
        cost = F.when(severity == s, c).otherwise(cost)
    return F.when((finding_kind(severity, category) == "capability") & severity.isin("medium", "low"), 0).otherwise(cost)


def risk(rows: DataFrame) -> DataFrame:
    """Adds ``rule_findings`` (unless given, from ``rule_hits``), ``capabilities``, ``risk_findings`` (charged), ``notes`` (not charged)."""
    text, d = F.col("text"), F.col("description")
    if "rule_findings" not in rows.columns:
        rows = rows.withColumn("rule_findings", rule_hits(text, fields=("severity", "category", "title")))
    rows = rows.withColumn("__code", scripts(text)).withColumn("capabilities", capabilities(F.col("__code")))
    rows = rows.withColumn("n_tag_chars", F.regexp_count(text, F.lit(r"[\x{E0000}-\x{E007F}]"))).withColumn("defensive", hit(d, R.DEFENSIVE_PURPOSE))
    tags = finding("high", "obfuscation", "Hidden instructions smuggled in invisible Unicode")
    rows = rows.withColumn("__rules", F.concat("rule_findings", found((F.col("n_tag_chars") >= 4, tags))))
    cats = F.array_distinct(F.transform(F.filter("__rules", lambda f: f["severity"] != "low"), lambda f: f["category"]))
    rows = rows.withColumn("__cats", F.concat(cats, F.transform(F.filter("quality_findings", lambda f: f["severity"] != "low"), lambda f: f["category"])))
    has = lambda c: F.array_contains("__cats", c)
    chain = has("secret") & has("egress") & ~has("exfil")
    key_material = F.exists("rule_findings", lambda f: (f["category"] == "secret") & (f["severity"] == "high"))
    malice = (key_material & ~F.col("defensive")) | hit(text, R.SECRET_TO_SINK) | hit(text, R.RISK_RULES[7].pattern)
    cap = lambda name, sev=None: F.exists("capabilities", lambda c: (c["cap"] == name) & (F.lit(True) if sev is None else c["severity"] == sev))
    critical = lambda label: F.exists("capabilities", lambda c: (c["severity"] == "critical") & (c["label"] == label))
    sensitive = any_hit("__code", R.SENSITIVE_SECRET)
    raw_ip = F.exists(F.flatten(F.transform("__code", lambda c: F.regexp_extract_all(c, F.lit(R.URL_IP), F.lit(1)))), lambda ip: ~F.rlike(ip, F.lit(R.LOCAL_IP)))
    path = cap("secret") & cap("network") & (sensitive | cap("encoded", "critical") | raw_ip)
    mild = F.col("defensive") & ~(cap("encoded", "critical") | (raw_ip & sensitive))
    blocks = F.array_join(fenced(text, r"```[\s\S]*?```"), "\n")
    claim = lambda name: hit(d, R.CLAIMS[name])
    found_crit = [F.when(critical(label), finding("critical", "shell", f"Script capability: {label.lower()}")) for label in dict.fromkeys(b[2] for b in R.BEHAVIORS)]
    rows = rows.withColumn("__chain", F.concat(
        found((chain & malice, finding("critical", "exfil", "Credential read + network egress + risk signal = likely exfiltration chain"))),
        found((path & mild, finding("medium", "exfil", "Credential + network in a security-analysis skill — verify it is an example")), (path & ~mild, finding("critical", "exfil", "Exfiltration path in an embedded script"))),
        F.array_compact(F.array(*found_crit)),
    ))
    rows = rows.withColumn("notes", found((chain & ~malice, finding("medium", "exfil", "Reads credentials and makes network calls — verify the destination"))))
    behaves = lambda *names: F.exists(F.concat("__rules", "__chain", "notes", "quality_findings"), lambda f: (f["severity"] != "low") & f["category"].isin(*names))
    deletes = behaves("destructive") | hit(blocks, R.DEEDS["deletes"])
    network = behaves("egress", "exfil") | hit(blocks, R.DEEDS["network"])
    shell = behaves("shell") | hit(blocks, R.DEEDS["shell"])
    rows = rows.withColumn("contradiction", F.coalesce(F.when(claim("read_only") & deletes, "read_only"), F.when(claim("no_delete") & deletes, "no_delete"), F.when(claim("no_network") & network, "no_network"), F.when(claim("no_shell") & shell, "no_shell")))
    broken = found((F.col("contradiction").isNotNull(), finding("medium", "injection", "Description contradicts the skill’s behavior")))
    return rows.withColumn("risk_findings", F.concat("__rules", "__chain", broken)).drop("__code", "__rules", "__cats", "__chain")


def overall(structure: Column, trigger: Column, tokens: Column, risk_score: Column) -> Column:
    return clamp(structure * 0.25 + trigger * 0.45 + tokens * 0.3 - (100 - risk_score))


def grade_of(score: Column, critical: Column, loadable: Column) -> Column:
    out = F.when(critical, "F")
    for cut, g in R.GRADE_CUTS:
        out = out.when(score >= cut, g)
    return out.when(loadable, "D").otherwise("F")


def grades(rows: DataFrame) -> DataFrame:
    """Adds ``findings, risk, level, gate, score, grade, loadable, evidence, vector``."""
    rows = rows.withColumn("findings", F.concat("quality_findings", "risk_findings", "notes"))
    penalty = F.aggregate("risk_findings", F.lit(0), lambda a, f: a + finding_cost(f["severity"], f["category"]))
    rows = rows.withColumn("risk", clamp(100 - penalty))
    any_ = lambda cond: F.exists("findings", cond)
    level = (
        F.when(any_(lambda f: f["severity"] == "critical"), "critical")
        .when(any_(lambda f: (f["severity"] == "high") & f["category"].isin(R.BLOCKING)), "high")
        .when(any_(lambda f: (f["severity"] == "high") | ((f["severity"] == "medium") & f["category"].isin(R.SECURITY))) | (F.col("risk") < 72), "medium").otherwise("low")
    )
    rows = rows.withColumn("level", level)
    gate = F.when(F.col("level").isin("critical", "high"), "block").when(F.col("level") == "medium", "review").otherwise("pass")
    rows = rows.withColumns({"gate": gate, "score": overall(F.col("structure"), F.col("trigger"), F.col("tokens"), F.col("risk")), "loadable": F.col("has_frontmatter") & (F.col("fm_name") != "")})
    rows = rows.withColumn("grade", F.when(F.col("gate") == "block", "F").otherwise(grade_of(F.col("score"), F.col("level") == "critical", F.col("loadable"))))
    rows = rows.withColumn("evidence", F.when(F.length(js_trim(F.col("text"))) < 8, "empty").when(F.col("bundle_files").isNotNull(), "full").otherwise("partial"))
    return rows.withColumn("vector", vector_make())


def vector_make() -> Column:
    """The grade vector of a graded row, from its columns."""
    part = lambda k, c: F.concat(F.lit(f"/{k}:"), F.col(c))
    gate = F.upper(F.substring("gate", 1, 1))
    return F.concat(
        F.lit("SMV:2.0"), part("S", "structure"), part("T", "trigger"), part("K", "tokens"), part("R", "risk"), part("O", "score"), part("G", "grade"), F.lit("/GATE:"), gate, part("E", "evidence"),
        F.when(F.col("level") == "critical", "/X:1").otherwise(""), F.when(F.col("loadable"), "").otherwise("/L:0"),
    )


def vector_parse(vectors: DataFrame, column: str = "vector") -> DataFrame:
    """Adds the parts of each vector, score and grade derived anew, and ``reproducible``; null where an axis is missing."""
    get = lambda k: F.nullif(F.regexp_extract(column, f"(?:^|/){k}:([^/]+)", 1), F.lit(""))
    num = lambda k: F.expr(f"try_cast(regexp_extract({column}, '(?:^|/){k}:([^/]+)', 1) as int)")
    rows = vectors.withColumns({"v_structure": num("S"), "v_trigger": num("T"), "v_tokens": num("K"), "v_risk": num("R"), "v_score": num("O"), "v_grade": F.coalesce(get("G"), F.lit(""))})
    rows = rows.withColumns({"v_gate": F.when(get("GATE") == "P", "pass").when(get("GATE") == "B", "block").otherwise("review"), "v_critical": F.coalesce(get("X") == "1", F.lit(False)), "v_loadable": F.coalesce(get("L") != "0", F.lit(True))})
    rows = rows.withColumn("again_score", overall(F.col("v_structure"), F.col("v_trigger"), F.col("v_tokens"), F.col("v_risk")))
    again = F.when(F.col("v_gate") == "block", "F").otherwise(grade_of(F.col("again_score"), F.col("v_critical"), F.col("v_loadable")))
    whole = F.col("v_structure").isNotNull() & F.col("v_trigger").isNotNull() & F.col("v_tokens").isNotNull() & F.col("v_risk").isNotNull()
    rows = rows.withColumn("again_score", F.when(whole, F.col("again_score"))).withColumn("again_grade", F.when(whole, again))
    return rows.withColumn("reproducible", F.when(whole, F.coalesce((F.col("again_score") == F.col("v_score")) & (F.col("again_grade") == F.col("v_grade")), F.lit(False))))


def analysis(skills: DataFrame) -> DataFrame:
    """One row per skill with all of the above. The skill's columns stay; its text columns are dropped but for ``description``.

    Null documents grade as empty ones. ``bundle_files`` null means that no bundle was seen, an empty array that it has no files.
    """
    return grades(risk(axes(parse(skills)))).drop("md", "text", "body", "fm", "tools_raw", "cue", "silent", "filler")
