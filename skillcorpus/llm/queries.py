"""The registered queries of this subpackage: each applies one operator to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skillcorpus.llm import chat_format, decontamination, divergence, html_extract, jaccard_join, language_id, lexical_search, line_dedup, mixing, quality_rules, sharding, toxicity, url_filter
from skillcorpus.sources.tables import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the boilerplate lines of their source."""
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents that 5-word shingles link at a Jaccard similarity of 3/4."""
    return jaccard_join.jaccard_classes(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op3_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes."""
    return sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"), 40)


#: The rules of op4: host, path, verdict.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op4_digest_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on the URLs of all pages."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


def op5_output_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    out = language_id.held_out(F.col("doc_id"))
    model = language_id.train(docs.filter(~out))
    found = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score", "ambiguous")


def op6_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents mixed so that all sources have equal weight, with as many bytes as before."""
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "copy", F.octet_length("text").cast("long").alias("n_bytes"), F.md5("text").alias("text_md5"))


def op7_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule counts and verdicts of all documents."""
    return quality_rules.quality(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns in reply order, without quotes."""
    out = chat_format.format_chats(table(spark, sf_dir, "conversations"))
    return out.withColumns({"n_chars": F.length("text").cast("long"), "text_md5": F.md5("text")}).drop("text")


def op9_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents hold benchmark items, and how much of them."""
    return decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_union_free_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    out = html_extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op11_consed_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of each language are apart, and by which terms."""
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op12_norm_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents for each benchmark item."""
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 50)


def op13_toxic_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from labels that are not held out."""
    docs, labels = (table(spark, sf_dir, x) for x in ("documents", "labels"))
    out = toxicity.held_out(F.col("doc_id"))
    found = toxicity.score(docs.select("doc_id", "text"), toxicity.learn(docs, labels.filter(~out)))
    return found.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "hits")


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_ngram_jaccard, op3_sampled_splitters, op4_digest_array, op5_output_codes, op6_poisson_mix, op7_host_rules, op8_quotation_links, op9_string_tiling, op10_union_free_wrappers, op11_consed_trees, op12_norm_buckets, op13_toxic_lexicon)}

ORACLES = {
    "op1_line_dedup": """
WITH l AS (SELECT doc_id, coalesce(source, '') AS host, text, string_split(text, chr(10)) AS ls FROM documents),
 n AS (SELECT host, count(*) AS pages FROM l GROUP BY host),
 c AS (SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(list_filter(list_transform(ls, lambda x: trim(x, ' ')), lambda x: x <> ''))) AS line FROM l) GROUP BY host, line),
 b AS (SELECT host, list(line) AS bad FROM c JOIN n USING (host) WHERE c.n >= 5 AND c.n > 0.1 * pages GROUP BY host),
 k AS (SELECT doc_id, ls, CASE WHEN bad IS NULL THEN ls ELSE list_filter(ls, lambda x: trim(x, ' ') = '' OR NOT list_contains(bad, trim(x, ' '))) END AS kept FROM l LEFT JOIN b USING (host))
SELECT doc_id, coalesce(len(ls), 0)::BIGINT AS n_lines, coalesce(len(ls) - len(kept), 0)::BIGINT AS n_dropped,
 length(array_to_string(kept, chr(10)))::BIGINT AS n_chars, md5(array_to_string(kept, chr(10))) AS text_md5 FROM k""",
    "op4_digest_array": r"""
WITH rules(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
 u AS (SELECT page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
 j AS (SELECT u.*, h || p AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h) + length(p) DESC NULLS LAST) AS n
  FROM u LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM j WHERE n = 1""",
    "op6_poisson_mix": """
WITH d AS (SELECT doc_id, source, text, coalesce(source, '') AS s, coalesce(octet_length(encode(text)), 0) AS nb FROM documents),
 r0 AS (SELECT s, sum(sum(nb + 1)) OVER () / (count(*) OVER () * sum(nb + 1))::DOUBLE AS whole FROM d GROUP BY s),
 r AS (SELECT s, greatest(1, ceil(whole / 16.0::DOUBLE))::BIGINT AS draws, whole / greatest(1, ceil(whole / 16.0::DOUBLE)) AS rate FROM r0),
 p AS (SELECT s, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY s ORDER BY k) AS cdf FROM r, range(0, 76) t(k)),
 u AS (SELECT d.*, i, ('0x' || substr(md5(CASE WHEN i = 0 THEN '7:' ELSE '7/' || i || ':' END || coalesce(doc_id::VARCHAR, 'text ' || md5(text), '')), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS u
   FROM d JOIN (SELECT s, unnest(range(0, draws)) AS i FROM r) USING (s)),
 n AS (SELECT u.doc_id, u.source, u.text, u.nb, count(*) FILTER (WHERE cdf <= u) AS n FROM u JOIN p USING (s) GROUP BY ALL)
SELECT doc_id, source, unnest(range(0, n))::INT AS copy, nb::BIGINT AS n_bytes, md5(text) AS text_md5 FROM n WHERE n > 0""",
    "op8_quotation_links": r"""
WITH RECURSIVE m AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS ls FROM conversations),
 l0 AS (SELECT conv_id, turn, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM m),
 l1 AS (SELECT conv_id, turn, pos, length(regexp_replace(regexp_extract(line, '^([> \t]*)', 1), '[^>]', '', 'g')) AS lv,
   trim(regexp_replace(lower(regexp_replace(line, '^([> \t]*)', '')), '\s+', ' ', 'g'), ' ') AS norm FROM l0),
 l2 AS (SELECT *, CASE WHEN lv = lag(lv) OVER (PARTITION BY conv_id, turn ORDER BY pos) THEN 0 ELSE 1 END AS new FROM l1 WHERE norm <> ''),
 l3 AS (SELECT *, sum(new) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS passage FROM l2),
 q AS (SELECT a.conv_id, a.turn, a.passage, a.lv, a.pos, max(b.turn) AS origin FROM l3 a LEFT JOIN l3 b ON a.conv_id = b.conv_id AND a.norm = b.norm AND b.turn < a.turn AND b.lv = 0 WHERE a.lv > 0 GROUP BY ALL),
 v AS (SELECT conv_id, turn, passage, lv, origin, count(*) AS n FROM q GROUP BY ALL),
 qp AS (SELECT conv_id, turn, passage, count(*) AS k, list(norm ORDER BY pos) AS ns FROM l3 WHERE lv > 0 GROUP BY ALL),
 ow AS (SELECT conv_id, turn, list(norm ORDER BY pos) AS ns FROM l3 WHERE lv = 0 GROUP BY ALL),
 fu AS (SELECT q.conv_id, q.turn, q.passage, max(o.turn) AS whole FROM qp q JOIN ow o ON o.conv_id = q.conv_id AND o.turn < q.turn AND list_contains(list_transform(range(1, len(o.ns) - k + 2), lambda i: o.ns[i:i + k - 1]), q.ns) GROUP BY ALL),
 p0 AS (SELECT conv_id, turn, passage, lv, sum(n) AS total, max(struct_pack(n := n, o := origin)) FILTER (WHERE origin IS NOT NULL) AS best FROM v GROUP BY conv_id, turn, passage, lv),
 p AS (SELECT conv_id, turn, lv, CASE WHEN whole IS NOT NULL THEN total WHEN 2 * best.n >= total THEN best.n END AS n, coalesce(whole, best.o) AS o FROM p0 LEFT JOIN fu USING (conv_id, turn, passage)),
 r AS (SELECT conv_id, turn, max(struct_pack(l := -lv, n := n, o := o)).o AS reply_to FROM p WHERE n IS NOT NULL GROUP BY conv_id, turn),
 s AS (SELECT m.*, reply_to, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM m LEFT JOIN r USING (conv_id, turn)),
 b AS (SELECT *, max(CASE WHEN prev IS NULL OR coalesce(reply_to <> prev, false) THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS branch FROM s),
 t AS (SELECT conv_id, branch, [struct_pack(a := -9000000000, b := branch)] AS path FROM b WHERE turn = branch AND prev IS NULL
  UNION ALL SELECT c.conv_id, c.branch, list_append(t.path, struct_pack(a := -c.reply_to, b := c.branch)) FROM t JOIN b u ON u.conv_id = t.conv_id AND u.branch = t.branch
   JOIN b c ON c.conv_id = u.conv_id AND c.turn = c.branch AND c.prev IS NOT NULL AND c.reply_to = u.turn)
SELECT conv_id, turn, role, reply_to, branch, (len(path) - 1)::BIGINT AS depth, row_number() OVER (PARTITION BY conv_id ORDER BY path, turn) - 1 AS position,
 n_quoted, max_level, length(body)::BIGINT AS n_chars, md5(body) AS text_md5
FROM (SELECT b.*, path, len(list_filter(lvs, lambda x: x > 0))::BIGINT AS n_quoted, list_max(lvs)::BIGINT AS max_level,
  regexp_replace(array_to_string(list_filter(ls, lambda x: NOT regexp_matches(x, '^[ \t]*>')), chr(10)), '^\s+|\s+$', '', 'g') AS body
 FROM (SELECT *, list_transform(ls, lambda x: length(regexp_replace(regexp_extract(x, '^([> \t]*)', 1), '[^>]', '', 'g'))) AS lvs FROM b) b JOIN t USING (conv_id, branch))""",
    "op7_host_rules": r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
 p AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d)),
 q AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM p) WHERE n > 1),
 rw AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM q) GROUP BY doc_id),
 b AS (SELECT d.doc_id, host, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[ \x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
   (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
   list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, '[ \x09-\x0D]+', '', 'g') <> '') AS ls, coalesce(rw.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN rw USING (doc_id)),
 f AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM b),
 h AS (SELECT host, count(*) AS n, sum(base_failed::INT) AS x FROM f GROUP BY host),
 m AS (SELECT avg(x / n) AS m, coalesce(var_samp(x / n), 0) AS v, avg(1 / n) AS k FROM h),
 w AS (SELECT m, CASE WHEN m * (1 - m) > 0 THEN greatest(m * (1 - m) / greatest(v - m * (1 - m) * k, m * (1 - m) / 1001) - 1, 0.01) ELSE 1000 END AS w FROM m),
 o AS (SELECT host, (x + m * w) / (n + w) <= 0.5 AS ok FROM h, w)
SELECT doc_id, n_words, word_chars, n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND ok) AS kept FROM f JOIN o USING (host)""",
    "op11_consed_trees": r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{80}-\x{10FFFF}]+') AS ws FROM documents),
 t AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM (SELECT r, lang, source, unnest(ws) AS term FROM d) GROUP BY ALL),
 k AS (SELECT lang, term, sum(n) AS total FROM t GROUP BY ALL HAVING sum(docs) >= 3),
 g AS (SELECT DISTINCT lang, source FROM d),
 v AS (SELECT lang, count(*) AS v, sum(total) AS lang_n FROM k GROUP BY lang),
 c AS (SELECT lang, source, term, total, coalesce(t.n, 0) AS n, sum(coalesce(t.n, 0)) OVER (PARTITION BY lang, source) AS gn FROM g JOIN k USING (lang) LEFT JOIN t USING (lang, source, term)),
 p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 1)) // (gn + v) AS p, 1 + (1000000000::HUGEINT * (total + 1)) // (lang_n + v) AS q FROM c JOIN v USING (lang)),
 x AS (SELECT lang, a.source, 'pair' AS part, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL
  UNION ALL SELECT a.lang, a.source, 'pair', b.source, 0 FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source WHERE a.lang NOT IN (SELECT lang FROM v)
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank FROM (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM x) WHERE part = 'pair' OR rank <= 200""",
    "op12_norm_buckets": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ws FROM documents),
 q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term FROM benchmark),
 c AS (SELECT count(*) AS n_docs, sum(len(ws))::BIGINT AS n_terms FROM d WHERE len(ws) > 0),
 t AS (SELECT r, doc_id, len(ws) AS n, term, count(*) AS tf FROM (SELECT r, doc_id, ws, unnest(ws) AS term FROM d) GROUP BY ALL),
 w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM t, c GROUP BY term, n_docs),
 s AS (SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score FROM t JOIN w USING (term) JOIN q USING (term), c GROUP BY item_id, r, doc_id)
SELECT item_id, rank, doc_id, score FROM (SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM s WHERE score > 0) WHERE rank <= 50""",
}
