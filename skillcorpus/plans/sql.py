"""DuckDB twins of the library's shared steps, as common table expressions."""

from __future__ import annotations

from skillcorpus.functions import rules as R
from skillcorpus.functions import text as T
from skillcorpus.sources.adapters import CATALOG_SQL, GOALS_SQL, MANIFESTS_SQL, OBSERVATIONS_SQL, SKILLS_SQL, sql_list, sql_text


def trimmed(x: str) -> str:
    return f"regexp_replace({x}, '^{T.WS}+|{T.WS}+$', '', 'g')"


def matches(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {sql_text(pattern)})"


def estimate(t: str) -> str:
    """Token estimate of an expression that is trimmed already."""
    cjk = f"len(regexp_extract_all({t}, '{T.CJK}'))"
    return f"floor({cjk} * 1.05::DOUBLE + (length({t}) - {cjk}) / 4.0::DOUBLE + 0.5)::BIGINT"


def listing(t: str) -> str:
    cjk = f"len(regexp_extract_all({t}, '{T.CJK_LISTING}'))"
    return f"ceil({cjk} / 1.5::DOUBLE + (length({t}) - {cjk}) / 4.0::DOUBLE)::BIGINT"


def clamp(x: str) -> str:
    return f"greatest(0, least(100, floor(({x})::DOUBLE + 0.5)))::INT"


STEM = "CASE WHEN w LIKE '%ing' AND length(w) > 5 THEN left(w, -3) WHEN w LIKE '%ed' AND length(w) > 4 THEN left(w, -2) WHEN w LIKE '%es' AND length(w) > 4 THEN left(w, -2) WHEN w LIKE '%s' AND length(w) > 3 THEN left(w, -1) ELSE w END"


def trigger_tokens(x: str) -> str:
    return f"list_distinct(list_filter(list_transform(list_filter(regexp_extract_all(lower({x}), '[a-z][a-z-]{{2,}}'), lambda w: w NOT IN ({in_list(T.TRIGGER_STOP)})), lambda w: {STEM}), lambda s: s NOT IN ({in_list(T.TRIGGER_STEM_STOP)})))"


def goal_tokens(x: str) -> str:
    return f"list_distinct(list_filter(list_transform(list_filter(regexp_extract_all(lower({x}), '[a-z]{{3,}}'), lambda w: w NOT IN ({in_list(T.GOAL_STOP)})), lambda w: {STEM}), lambda s: s NOT IN ({in_list(T.GOAL_STOP)})))"


def match_tokens(x: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({x}), '[a-z]{{3,}}'), lambda w: w NOT IN ({in_list(T.MATCH_STOP)})))"


def in_list(values: list[str]) -> str:
    return ", ".join(sql_text(v) for v in values)


HEAD = r"'^\x{feff}?\s*---\s*\n([\s\S]*?)\n---'"


def _fm(key: str) -> str:
    return rf"""regexp_replace({trimmed(f"regexp_extract(block, '(?m)^{key}[ \t]*:[ \t]*(.*)$', 1)")}, '^["'']|["'']$', '', 'g')"""


PARSED = rf"""pf0 AS (SELECT *, regexp_replace(md, '\r\n?', chr(10), 'g') AS text FROM sk),
pf1 AS (SELECT *, regexp_extract(text, {HEAD}, 0) AS head, regexp_extract(text, {HEAD}, 1) AS block FROM pf0),
pf AS (SELECT *, head <> '' AS has_frontmatter, {_fm("name")} AS fm_name, {_fm("description")} AS description, {_fm("allowed-tools")} AS tools_raw, substr(text, length(head) + 1) AS body FROM pf1)"""

_TOOL = r"""trim(regexp_replace(regexp_replace(trim(regexp_replace(trim(t), '^-\s*', '')), '^["'']|["'']$', '', 'g'), '\([\s\S]*$', ''))"""
_REFS = r"""'(?im)(?:^|[\s(`''"\[])\.?/?((?:references?|scripts?|assets?|templates?|examples?|resources?|data|bin)/[\w./-]{1,120}?\.[a-z0-9]{1,8})\b'"""
_BROAD = "any all every always whenever anytime everytime anything everything".split()
_CUES = f"({matches('d', R.TRIGGER_CUES)})"

AXES = rf"""rep0 AS (SELECT skill_ord, l, i, sum((l LIKE '```%' OR l LIKE '~~~%')::INT) OVER (PARTITION BY skill_ord ORDER BY i) AS fences, (l LIKE '```%' OR l LIKE '~~~%') AS mark
 FROM (SELECT skill_ord, unnest(list_transform(string_split(body, chr(10)), lambda x: {trimmed("x")})) AS l, unnest(range(len(string_split(body, chr(10))))) AS i FROM pf)),
rep AS (SELECT skill_ord, (count(*) - count(DISTINCT l))::INT AS n_repeated FROM rep0 WHERE NOT mark AND fences % 2 = 0 AND length(l) > 24 GROUP BY skill_ord),
ax0 AS (SELECT pf.*, {trimmed("text")} AS tt, {trimmed("description")} AS td, {trimmed("body")} AS tb, coalesce(n_repeated, 0) AS n_repeated, description AS d, len(string_split(body, chr(10))) AS n_lines, len(regexp_extract_all(body, '(?m)^#{{2,6}}\s')) AS n_headings,
  regexp_matches(text, '(?i)(^|\n)references?\s*:|references?/') OR regexp_matches(body, '(?i)\bsee\s+[`''"(]?[\w./-]+\.(?:md|txt)\b|\]\(\s*\.?\/?[\w./-]*(?:references?|docs?)\/|\b(?:progressive disclosure|load(?:ed)? on demand|on-demand|reference files?)\b') AS defers,
  list_filter(list_transform(regexp_split_to_array(regexp_replace(tools_raw, '^\[|\]$', '', 'g'), '[,\n]|\s-\s'), lambda t: lower({_TOOL})), lambda t: t <> '') AS tools,
  CASE WHEN bundle_files IS NOT NULL THEN list_filter(list_distinct(regexp_extract_all(body, {_REFS}, 1)), lambda r: NOT list_contains(bundle_files, lower(r)) AND NOT list_contains(list_transform(bundle_files, lambda f: string_split(f, '/')[-1]), string_split(lower(r), '/')[-1])) END AS missing_refs,
  list_filter({sql_list(_BROAD)}, lambda w: regexp_matches(regexp_replace(description, '(?i)whenever the user', '', 'g'), '(?i)\b' || w || '\b')) AS broad_words FROM pf LEFT JOIN rep USING (skill_ord)),
ax1 AS (SELECT *, {estimate("tt")} AS tokens_total, {estimate("td")} AS tokens_desc, {estimate("tb")} AS tokens_body,
  list_filter([{", ".join(f"CASE WHEN list_contains(tools, {sql_text(t)}) AND NOT {matches('body', p)} THEN {sql_text(t)} END" for t, p in R.TOOL_FOOTPRINTS.items())}], lambda x: x IS NOT NULL) AS over_tools,
  length(d) + 3 * len(regexp_extract_all(d, '{T.CJK}')) AS eff, {_CUES} AS cue, {matches("d", R.TRIGGER_CUES_EXTRA)} OR {matches("d", R.CONCRETE_OPENER)} AS cue2, {matches("d", R.FILLER_WORDS)} AS filler, {matches("d", R.VAGUE_OPENER)} AS vague,
  length(tb) < 40 AS short, length(body) > 600 AND NOT regexp_matches(body, '(^|\n)#{{1,6}}\s') AS plain, regexp_matches(fm_name, '^[a-z0-9][a-z0-9-]{{0,63}}$') AS shaped, {matches("fm_name", R.GENERIC_NAME)} AS generic,
  regexp_matches(fm_name, '[\x{{0400}}-\x{{04ff}}\x{{0370}}-\x{{03ff}}]') AS homoglyph FROM ax0),
ax2 AS (SELECT *, len(tools) > 0 AND regexp_matches(body, '(?i)```(?:bash|sh|shell|zsh)\b') AND NOT list_contains(tools, 'bash') AS no_bash, coalesce(len(missing_refs), 0) > 0 AS dangling FROM ax1),
ax AS (SELECT *, {clamp("" + clamp(clamp("100 - CASE WHEN has_frontmatter THEN 0 ELSE 45 END - CASE WHEN fm_name = '' THEN 20 WHEN homoglyph THEN 12 WHEN NOT shaped THEN 8 WHEN generic THEN 8 ELSE 0 END - CASE WHEN d = '' THEN 30 WHEN length(d) > 1024 THEN 10 ELSE 0 END - CASE WHEN short THEN 15 WHEN plain THEN 8 ELSE 0 END") + " - CASE WHEN no_bash THEN 6 ELSE 0 END") + " - CASE WHEN dangling THEN 12 ELSE 0 END")} AS structure,
  CASE WHEN d = '' THEN 0 ELSE {clamp("100 - CASE WHEN eff < 40 THEN 35 WHEN length(d) > 500 THEN 20 WHEN length(d) > 350 THEN 8 ELSE 0 END - CASE WHEN cue OR cue2 THEN 0 ELSE 25 END - least(30, 12 * len(broad_words)) - CASE WHEN filler THEN 12 ELSE 0 END - CASE WHEN length(d) < 40 AND NOT cue AND vague THEN 10 ELSE 0 END")} END AS trigger,
  CASE WHEN n_repeated >= 2 THEN {clamp(clamp("200 - 18 * ln(greatest(1, tokens_total))") + " - 10")} ELSE {clamp("200 - 18 * ln(greatest(1, tokens_total))")} END AS tokens FROM ax2)"""

_HITS = []
for _r in R.RISK_RULES:
    _first = next((x for x in R.RISK_RULES if x.title == _r.title), _r)
    _also = f" AND NOT {matches('text', _first.sql)}" if _first.id != _r.id else ""
    _HITS.append(f"CASE WHEN {matches('text', _r.sql)}{_also} THEN '{_r.id}' END")
RULES_TABLE = "rl(id, severity, category, title) AS (VALUES " + ", ".join(f"({sql_text(r.id)}, {sql_text(r.severity)}, {sql_text(r.category)}, {sql_text(r.title)})" for r in R.RISK_RULES) + ")"
HITS = f"""{RULES_TABLE}, ht AS (SELECT h.*, rl.severity, rl.category, rl.title FROM (SELECT skill_ord, unnest(list_filter([{", ".join(_HITS)}], lambda x: x IS NOT NULL)) AS id FROM pf) h JOIN rl USING (id))"""

_CODES = r"list_transform(list_filter(list_zip(regexp_extract_all(text, '```([a-zA-Z0-9_+-]*)[^\n]{0,240}\n([\s\S]*?)```', 1), regexp_extract_all(text, '```([a-zA-Z0-9_+-]*)[^\n]{0,240}\n([\s\S]*?)```', 2)), lambda z: lower(z[1]) IN (" + in_list(R.SCRIPT_LANGS) + ") OR (z[1] = '' AND regexp_matches(z[2], " + sql_text(R.SHELLISH) + "))), lambda z: z[2])"


def _behaves(cap: str) -> str:
    rows = sorted((b for b in R.BEHAVIORS if b[0] == cap), key=lambda b: R.SEVERITIES.index(b[1]))
    return "CASE " + " ".join(f"WHEN len(list_filter(codes, lambda c: {matches('c', b[3])})) > 0 THEN '{b[1]}'" for b in rows) + " END"


_CAPS = list(dict.fromkeys(b[0] for b in R.BEHAVIORS))
CAPS = f"""cd AS (SELECT skill_ord, text, description, {_CODES} AS codes FROM pf), cp AS (SELECT *, {", ".join(f"{_behaves(c)} AS c_{c}" for c in _CAPS)}, len(list_filter(codes, lambda c: {matches("c", R.SENSITIVE_SECRET)})) > 0 AS sensitive,
  len(list_filter(flatten(list_transform(codes, lambda c: regexp_extract_all(c, {sql_text(R.URL_IP)}, 1))), lambda ip: NOT {matches("ip", R.LOCAL_IP)})) > 0 AS raw_ip FROM cd)"""


def kind(sev: str, cat: str) -> str:
    return f"CASE WHEN {sev} = 'critical' OR {cat} IN ({in_list(R.THREATS)}) OR ({cat} = 'exfil' AND {sev} = 'high') THEN 'threat' WHEN {cat} = 'exfil' OR {cat} IN ({in_list(R.CAPABILITIES)}) THEN 'capability' ELSE 'quality' END"


_COST = f"CASE WHEN {kind('severity', 'category')} = 'capability' AND severity IN ('medium', 'low') THEN 0 WHEN severity = 'critical' THEN 52 WHEN severity = 'high' THEN 30 WHEN severity = 'medium' THEN 14 ELSE 6 END"
_LABELS = {b[0]: b[2] for b in R.BEHAVIORS}

RISK = f"""rk0 AS (SELECT skill_ord, bool_or(category = 'secret' AND severity <> 'low') AS b_secret, bool_or(category = 'egress' AND severity <> 'low') AS b_egress, bool_or(category = 'exfil' AND severity <> 'low') AS b_exfil,
  bool_or(category = 'secret' AND severity = 'high') AS key_material, bool_or(category = 'destructive' AND severity <> 'low') AS b_destructive, bool_or(category = 'shell' AND severity <> 'low') AS b_shell FROM ht GROUP BY skill_ord),
rk1 AS (SELECT cp.*, coalesce(b_secret, false) AS b_secret, coalesce(b_egress, false) AS b_egress, coalesce(b_exfil, false) AS b_exfil, coalesce(key_material, false) AS key_material, coalesce(b_destructive, false) AS b_destructive, coalesce(b_shell, false) AS b_shell,
  {matches("description", R.DEFENSIVE_PURPOSE)} AS defensive, len(regexp_extract_all(text, '[\\x{{E0000}}-\\x{{E007F}}]')) AS n_tag_chars, array_to_string(regexp_extract_all(text, '```[\\s\\S]*?```'), chr(10)) AS fenced FROM cp LEFT JOIN rk0 USING (skill_ord)),
rk2 AS (SELECT *, b_secret AND b_egress AND NOT b_exfil AS chain, (key_material AND NOT defensive) OR {matches("text", R.SECRET_TO_SINK)} OR {matches("text", R.RISK_RULES[7].pattern)} AS malice,
  c_secret IS NOT NULL AND c_network IS NOT NULL AND (sensitive OR coalesce(c_encoded = 'critical', false) OR raw_ip) AS path, defensive AND NOT (coalesce(c_encoded = 'critical', false) OR (raw_ip AND sensitive)) AS mild FROM rk1),
rk3 AS (SELECT *, b_destructive OR {matches("fenced", R.DEEDS["deletes"])} AS deletes, b_egress OR b_exfil OR chain OR path OR {matches("fenced", R.DEEDS["network"])} AS networks,
  b_shell OR {" OR ".join(f"coalesce(c_{c} = 'critical', false)" for c in _CAPS)} OR {matches("fenced", R.DEEDS["shell"])} AS shells FROM rk2),
rk4 AS (SELECT *, CASE WHEN {matches("description", R.CLAIMS["read_only"])} AND deletes THEN 'read_only' WHEN {matches("description", R.CLAIMS["no_delete"])} AND deletes THEN 'no_delete' WHEN {matches("description", R.CLAIMS["no_network"])} AND networks THEN 'no_network' WHEN {matches("description", R.CLAIMS["no_shell"])} AND shells THEN 'no_shell' END AS contradiction FROM rk3),
fr AS (SELECT skill_ord, severity, category, title, true AS charged FROM ht
 UNION ALL SELECT skill_ord, 'high', 'obfuscation', 'Hidden instructions smuggled in invisible Unicode', true FROM rk4 WHERE n_tag_chars >= 4
 UNION ALL SELECT skill_ord, 'critical', 'exfil', 'Credential read + network egress + risk signal = likely exfiltration chain', true FROM rk4 WHERE chain AND malice
 UNION ALL SELECT skill_ord, 'medium', 'exfil', 'Reads credentials and makes network calls — verify the destination', false FROM rk4 WHERE chain AND NOT malice
 UNION ALL SELECT skill_ord, 'medium', 'exfil', 'Credential + network in a security-analysis skill — verify it is an example', true FROM rk4 WHERE path AND mild
 UNION ALL SELECT skill_ord, 'critical', 'exfil', 'Exfiltration path in an embedded script', true FROM rk4 WHERE path AND NOT mild
 {" ".join(f"UNION ALL SELECT skill_ord, 'critical', 'shell', 'Script capability: {_LABELS[c].lower()}', true FROM rk4 WHERE c_{c} = 'critical'" for c in _CAPS)}
 UNION ALL SELECT skill_ord, 'medium', 'injection', 'Description contradicts the skill’s behavior', true FROM rk4 WHERE contradiction IS NOT NULL),
rs AS (SELECT skill_ord, {clamp(f"100 - coalesce(sum(CASE WHEN charged THEN {_COST} ELSE 0 END), 0)")} AS risk, bool_or(severity = 'critical') AS crit, bool_or(severity = 'high' AND category IN ({in_list(R.BLOCKING)})) AS blocking, bool_or(severity = 'high' OR (severity = 'medium' AND category IN ({in_list(R.SECURITY)}))) AS noted FROM fr GROUP BY skill_ord)"""

GRADED = f"""gr0 AS (SELECT ax.*, coalesce(rs.risk, 100) AS risk, CASE WHEN crit THEN 'critical' WHEN blocking THEN 'high' WHEN noted OR rs.risk < 72 THEN 'medium' ELSE 'low' END AS level FROM ax LEFT JOIN rs USING (skill_ord)),
gr1 AS (SELECT *, CASE WHEN level IN ('critical', 'high') THEN 'block' WHEN level = 'medium' THEN 'review' ELSE 'pass' END AS gate, {clamp("structure * 0.25::DOUBLE + trigger * 0.45::DOUBLE + tokens * 0.3::DOUBLE - (100 - risk)")} AS score, has_frontmatter AND fm_name <> '' AS loadable FROM gr0),
an AS (SELECT *, CASE WHEN gate = 'block' THEN 'F' WHEN score >= 85 THEN 'A' WHEN score >= 72 THEN 'B' WHEN score >= 58 THEN 'C' WHEN score >= 42 OR loadable THEN 'D' ELSE 'F' END AS grade,
  CASE WHEN length(tt) < 8 THEN 'empty' WHEN bundle_files IS NOT NULL THEN 'full' ELSE 'partial' END AS evidence FROM gr1)"""

_NAMED = "fm_name <> ''"
_DESCRIBED = "d <> ''"
_MONOLITH = "tokens_total > 2500 AND n_headings >= 4 AND NOT defers"
_OVER = "(tokens_body > 5000 OR n_lines > 500)"
_QUALITY = [
    ("NOT has_frontmatter", "medium", "spec"), (f"NOT ({_NAMED})", "low", "spec"), (f"{_NAMED} AND homoglyph", "medium", "injection"), (f"{_NAMED} AND NOT homoglyph AND NOT shaped", "low", "spec"), ("shaped AND generic", "low", "trigger"),
    (f"NOT ({_DESCRIBED})", "medium", "spec"), ("length(d) > 1024", "medium", "spec"), ("NOT short AND plain", "low", "spec"), (f"{_DESCRIBED} AND eff < 40", "medium", "trigger"), (f"{_DESCRIBED} AND eff >= 40 AND length(d) > 500", "low", "trigger"),
    (f"{_DESCRIBED} AND NOT (cue OR cue2)", "medium", "trigger"), (f"{_DESCRIBED} AND len(broad_words) > 0", "medium", "trigger"), (f"{_DESCRIBED} AND filler", "low", "trigger"), ("len(over_tools) > 0", "low", "privilege"), ("no_bash", "low", "spec"),
    ("dangling", "medium", "spec"), ("tokens_body > 5000", "medium", "bloat"), ("n_lines > 500", "medium", "bloat"), ("n_repeated >= 2", "low", "bloat"), (f"{_MONOLITH} AND {_OVER}", "medium", "bloat"), (f"{_MONOLITH} AND NOT {_OVER}", "low", "bloat"),
]
#: All findings, of quality and of risk.
ALL_FINDINGS = f"""af AS (SELECT skill_ord, severity, category FROM fr
 UNION ALL SELECT skill_ord, split_part(f, ':', 1), split_part(f, ':', 2) FROM (SELECT skill_ord, unnest(list_filter([{", ".join(f"CASE WHEN {c} THEN '{s}:{k}' END" for c, s, k in _QUALITY)}], lambda x: x IS NOT NULL)) AS f FROM ax))"""

PARTS = {"af": ALL_FINDINGS, "sk": SKILLS_SQL, "pf": PARSED, "ax": AXES, "ht": HITS, "cp": CAPS, "rk": RISK, "an": GRADED, "cat": CATALOG_SQL, "gl": GOALS_SQL, "obs": OBSERVATIONS_SQL, "mf": MANIFESTS_SQL}
NEEDS = {"pf": ["sk"], "ax": ["pf"], "ht": ["pf"], "cp": ["pf"], "rk": ["ht", "cp"], "an": ["ax", "rk"], "af": ["an"]}


def given(parts: str, body: str, recursive: bool = False) -> str:
    """SQL with the named parts (and what these need) as common table expressions before ``body``.

    ``body`` is a SELECT, or more expressions and a SELECT after a line of ``---``.
    """
    done: list[str] = []

    def add(p: str) -> None:
        for q in NEEDS.get(p, []):
            add(q)
        if p not in done:
            done.append(p)

    for p in parts.split():
        add(p)
    more, _, select = body.rpartition("---")
    ctes = [PARTS[p] for p in done] + ([more.strip().rstrip(",")] if more.strip() else [])
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(ctes) + "\n" + select.strip()


def versions(parts: str, new: str, body: str) -> str:
    """Like ``given``, with two rows for each skill: as it is (an even ``skill_ord``, twice its own), and with ``new`` as its text (the odd one after)."""
    twice = ", sk AS (SELECT * REPLACE (skill_ord * 2 AS skill_ord) FROM sk0 UNION ALL SELECT * REPLACE (skill_ord * 2 + 1 AS skill_ord, " + new + " AS md) FROM sk0)"
    return given(parts, body).replace(SKILLS_SQL, SKILLS_SQL.replace("sk AS (", "sk0 AS (", 1) + twice, 1)
