"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skillcorpus.llm import chat_format, decontamination, html_extract, jaccard_join, language_id, line_dedup, mixing, quality_rules, sharding, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard int, rate double, host string, g long, n_lines string"


def rows():
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    texts = [None, "", " \n\t ", "Hello", "Hello", "the quick brown fox jumps over", long, long, "a\n" * 3000, "😀 ünïcödé\x0b", "1234 !!", "x" * 200_000]
    out = [(i, t, ["en", None, "de"][i % 3], [None, "s1", "s2"][i % 3], 3, 1, 0.5, "h", 7, "clash") for i, t in enumerate(texts)]
    return [*out, out[3], out[3], (None, "no id", "en", "s1", 1, 1, 0.5, "h", 7, "c"), (None, None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_line_dedup(docs, none):
    out = line_dedup.dedup_lines(docs, min_pages=2, max_ratio=0.3)
    assert out.count() == docs.count() and set(out.columns) == {*docs.columns, "n_dropped"}
    got = {r.doc_id: r for r in out.collect() if r.doc_id is not None}
    assert got[0].text is None and got[0].n_lines == 0 and got[0].n_dropped == 0
    assert got[1].text == "" and got[1].n_lines == 1 and got[2].n_dropped == 0
    assert line_dedup.dedup_lines(none).count() == 0


def test_jaccard_join(docs, none):
    got = jaccard_join.jaccard_classes(docs).collect()
    assert len(got) == docs.count()
    by = {r.doc_id: r for r in got}
    assert by[0].n_shingles == 0 and by[0].component_id == 0 and by[1].component_id == 1 and by[2].component_id == 2
    assert by[4].component_id == 3 and by[7].component_id == 6 and by[5].component_id == 5
    assert sorted(r.n_shingles for r in got if r.doc_id is None) == [0, 1]
    assert jaccard_join.jaccard_classes(none).count() == 0


def test_jaccard_join_where_ids_repeat_or_lack(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(5, text), (5, "quite another text of more words"), (None, text), (None, text + " more"), (9, text)]
    got = jaccard_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.n_shingles, r.component_id) for r in got) == [(2, 5), (36, 5), (36, 5), (36, 5), (37, 5)]


def test_sharding(docs, none):
    out = sharding.shard(docs, 4).collect()
    assert len(out) == docs.count() and {r["size"] for r in out if r.text_crc32 is None} == {16}
    assert sharding.shard(none, 4).count() == 0


def test_language_id(docs, none):
    model = language_id.train(docs)
    out = language_id.identify(docs.withColumn("score", F.lit("x")), model)
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == docs.count()
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (0, 1, 2, 10)) and got[3].lang_pred in ("en", "de")
    empty = language_id.train(none)
    assert {r.lang_pred for r in language_id.identify(docs, empty).collect()} == {"und"}
    assert language_id.identify(none, model).count() == 0
    one = language_id.train(docs.filter("lang = 'en'"))
    assert {r.lang_pred for r in language_id.identify(docs, one).collect()} == {"en", "und"}


def test_mixing(docs, none):
    out = mixing.mix(docs.withColumn("copy", F.lit("clash")), epochs=2.0)
    assert {"copy", "mix_key", "shard", "rate"} <= set(out.columns)
    counts = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert counts.get(3, 0) % 3 == 0  # repeated rows have equal counts
    assert mixing.mix(none).count() == 0


def test_mixing_reaches_its_weights(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, "small").otherwise("large").alias("source"), F.lit("text of one size").alias("text"))
    out = {r["source"]: r["count"] for r in mixing.mix(docs, {"small": 3.0, "large": 1.0}).groupBy("source").count().collect()}
    assert abs(out["small"] / sum(out.values()) - 0.75) < 0.02 and abs(sum(out.values()) - 20_000) < 600
    again = mixing.mix(docs.repartition(7), {"small": 3.0, "large": 1.0})
    assert again.count() == sum(out.values())


def test_quality_rules(docs, none):
    out = quality_rules.quality(docs)
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == docs.count()
    assert got[0].n_words == 0 and got[0].base_failed and not got[0].kept and got[6].n_words == 60_000 and got[6].n_repeat_words == 60_000
    assert got[8].n_dup_lines == 2999 and got[8].n_repeat_words == 3000
    assert quality_rules.quality(none).count() == 0


def test_quality_of_bad_hosts(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, "bad", "short") for i in range(90)] + [(100 + i, "bad", good) for i in range(10)] + [(200 + i, f"h{i % 5}", good) for i in range(200)]
    got = {r.doc_id: r for r in quality_rules.quality(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    assert not any(got[100 + i].kept for i in range(10)) and all(got[200 + i].kept for i in range(200))


def test_decontamination(spark, docs, none):
    bench = spark.createDataFrame([(1, "the quick brown fox jumps over"), (2, None), (3, ""), (None, "Hello"), (4, "no id"), (1, "word5 word6 word7 word8 word9 word10")], "item_id long, text string")
    got = {r.doc_id: r for r in decontamination.decontaminate(docs, bench).collect()}
    assert len(got) == 13 and got[5].item_ids == [1] and got[5].coverage == 1.0 and got[6].contaminated and not got[0].contaminated
    assert sorted(r.item_ids for r in decontamination.decontaminate(docs, bench).collect() if r.doc_id is None) == [[], [4]]
    assert decontamination.decontaminate(none, bench).count() == 0
    assert not any(r.contaminated for r in decontamination.decontaminate(docs, bench.limit(0)).collect())


def test_url_filter(spark):
    rules = spark.createDataFrame([("com", "/", "allow"), ("a.com", "", "block"), ("a.com", "", "allow"), (None, "/", "block")], "host string, path string, verdict string")
    urls = [None, "", "x", "http://a.com", "HTTP://B.A.COM/x", "http://b.com/", "http://?q", "http://a.com:80/", "://", "http://" + "a." * 5000 + "com/"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate([*urls, urls[3]])], "page_id long, url string, rule string")
    one, many = url_filter.filter_urls(pages, rules), url_filter.filter_urls(pages, rules, piece_bytes=8)
    key = lambda df: sorted((r.page_id, r.host, r.path, r.rule or "", r.verdict) for r in df.collect())
    assert key(one) == key(many)
    got = {r.page_id: r for r in url_filter.filter_urls(pages, rules).collect()}
    assert got[3].verdict == "block" and got[4].verdict == "block" and got[5].rule == "com/" and got[0].verdict == "allow" and got[9].rule == "a.com"
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(pages, rules.limit(0)).collect()} == {"allow"}


def test_digest_collisions_decide_nothing(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda x, seed: len(x))
    (tmp_path / "i").write_bytes(url_filter.packed([("a.com", "/", "block"), ("b.com", "/", "allow")]))
    assert url_filter.DigestArray([str(tmp_path / "i")]).probe(["a.com", "b.com", "c.com"], ["/", "/", "/"]) == [("a.com/", True), ("b.com/", False), None]


def test_many_pieces_of_an_array(spark):
    rules = spark.range(3000).selectExpr("concat('h', id, '.org') host", "concat('/p', id % 7, '/') path", "if(id % 3 = 0, 'block', 'allow') verdict")
    pages = spark.range(3000).selectExpr("id page_id", "concat('http://x.h', id, '.org/p', id % 5, '/a') url")
    got = url_filter.filter_urls(pages, rules, default="none", piece_bytes=4096).collect()
    assert {r.page_id: r.verdict for r in got} == {i: "none" if i % 7 != i % 5 else "block" if i % 3 == 0 else "allow" for i in range(3000)}


def test_html_extract(spark):
    rows = [(1, None, None), (2, "http://a.com/", ""), (3, "http://a.com/", "plain < text & more"), (4, "x", "<p"), (5, "http://a.com/", "<article><p>" + "word " * 50_000), (5, "http://a.com/", "<div>" * 3000 + "deep")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    out = html_extract.extract(pages)
    assert out.count() == 6 and out.columns == ["page_id", "url", "text"]
    got = [r.text for r in out.orderBy("page_id").collect()]
    assert got[0] == "" and got[1] == "" and all(t is not None for t in got) and any(len(t) == 249_999 for t in got)
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_chats(spark):
    schema = "conv_id long, turn long, role string, text string, depth int"
    rows = [(1, 0, "u", "a line\nb line", 1), (1, 1, None, None, 1), (1, 2, "u", "> a line\n> b line\nnew", 1), (1, 2, "u", "> a line\n> b line\nnew", 1), (None, None, "u", ">> x", 1), (2, 5, "u", "> never said", 1), (3, 0, "u", ">" * 50_000, 1)]
    got = chat_format.format_chats(spark.createDataFrame(rows, schema))
    assert got.count() == 7
    by = {(r.conv_id, r.turn): r for r in got.collect()}
    assert by[1, 2].reply_to == 0 and by[1, 2].text == "new" and by[2, 5].reply_to is None and by[2, 5].text == "" and by[1, 1].text == ""
    assert by[3, 0].max_level == 50_000 and by[None, None].max_level == 2
    assert chat_format.format_chats(spark.createDataFrame([], schema)).count() == 0


def test_stages(spark, docs, none, sf_dir):
    for name, stage in corpus_pipeline.STAGES:
        full, empty = stage(spark, docs, sf_dir), stage(spark, none, sf_dir)
        assert empty.count() == 0 and {*corpus_pipeline.DOCUMENTS} <= {*full.columns}
        if name != "sharding":
            assert full.columns == corpus_pipeline.DOCUMENTS
    key = lambda df: sorted((r.doc_id is None, r.doc_id or 0, r.text is None, r.text or "") for r in df.collect())
    all_rows = key(docs)
    lettered = [k for k in all_rows if any(c.isalpha() for c in k[3])]
    assert key(corpus_pipeline.known_language(spark, docs, sf_dir)) == lettered
    copies = {4, 7}  # of the rows 3 and 6; row 3 itself is there three times
    first = [k for i, k in enumerate(all_rows) if k[1] not in copies and (i == 0 or k != all_rows[i - 1])]
    assert key(corpus_pipeline.one_of_each_class(spark, docs, sf_dir)) == first
    assert key(corpus_pipeline.without_benchmark(spark, docs, sf_dir)) == all_rows
    assert key(corpus_pipeline.sharded(spark, docs, sf_dir)) == all_rows


def test_stages_where_ids_repeat_or_lack(spark, sf_dir):
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").first()["text"]
    text, other, clean = "t " * 9 + "same text", "another text of more than five words", "a clean text"
    rows = [(1, text), (1, text), (None, text), (2, text), (2, other), (3, item), (3, clean), (None, item), (None, clean), (4, None), (4, None)]
    docs = spark.createDataFrame([(i, t, "en", f"s{k}", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars int")
    key = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)
    assert key(corpus_pipeline.one_of_each_class(spark, docs, sf_dir)) == sorted([(1, text), (2, other), (3, item), (3, clean), (4, None), (4, None)], key=repr)
    assert key(corpus_pipeline.without_benchmark(spark, docs, sf_dir)) == sorted([r for r in rows if r[1] != item], key=repr)
    assert key(corpus_pipeline.sharded(spark, docs, sf_dir)) == sorted(rows, key=repr)


def test_mixing_of_rows_without_ids(spark):
    docs = spark.range(2000).selectExpr("cast(null as long) doc_id", "concat('text ', id) text", "'s' source")
    out = mixing.mix(docs)
    assert 1800 < out.count() < 2200 and out.select("text").distinct().count() < 1500
    assert out.select(F.spark_partition_id()).distinct().count() > 4
