"""The registered queries against their SQL twins, and the pipeline stage by stage."""

from __future__ import annotations

import pandas as pd
import pytest


import __spark_entry__
import corpus_pipeline
from skillcorpus.llm import chat_format, queries
from skillcorpus.sources.tables import table
from tests.conftest import differences
from tests.llm.test_against_brute_force import classes


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_twin(spark, sf_dir, name):
    assert differences(queries.QUERIES[name](spark, sf_dir), queries.ORACLES[name], sf_dir) == []


def test_chat_twin_on_quotes(spark):
    """The table has no quotes; this conversation has nested, repeated and unknown ones."""
    rows = [
        (1, 0, "user", "Hello there\nfirst line\nsecond line"), (1, 1, "assistant", "I answer this\nwith words"), (1, 2, "user", "> first  LINE\n> second line\nnew thought"), (1, 3, "user", "on topic two"),
        (1, 4, "assistant", "> I answer this\n>> nested thing\nok back"), (1, 5, "user", "> new thought\nreply deep"), (1, 6, "user", "> zzz\nunlinked"), (1, 7, "user", "> i answer this\nback up"), (1, 8, "user", "> back up\nyes"),
        (3, 0, "user", "yes\nno\nmaybe"), (3, 1, "assistant", "no"), (3, 2, "user", "yes"), (3, 3, "assistant", "> yes\n> no\nso it is"), (3, 4, "user", "> yes\nfine"), (3, 5, "user", "> no\n> maybe\n>> yes\nhm"), (3, 6, "user", "> no\n> yes\nmixed"),
        (1, 9, "user", "> reply deep\nmore"), (1, 10, "user", "> > new thought\nand again\n> first line\nend"), (2, 0, "user", "first line"), (2, 1, "user", "> first line"),
    ]
    df = chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    from pyspark.sql import functions as F

    out = df.withColumns({"n_chars": F.length("text").cast("long"), "text_md5": F.md5("text")}).drop("text")
    view = {"conversations": pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"])}
    assert differences(out, queries.ORACLES["op8_quotation_links"], "", view) == []
    # of common lines the passage as a whole tells where it is from; lines in no message in that order are led back one by one
    assert {r.turn: r.reply_to for r in df.filter("conv_id = 3 and turn > 2").collect()} == {3: 0, 4: 2, 5: 0, 6: 3 - 1}
    order = [r.turn for r in df.filter("conv_id = 1").orderBy("position").collect()]
    assert order != sorted(order) and order[0] == 0


def test_pipeline(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    everything = {r.doc_id: r.text for r in docs.collect()}
    known = {r.doc_id for r in corpus_pipeline.known_language(spark, docs, sf_dir).collect()}
    assert known == {k for k, t in everything.items() if any(c.isalpha() for c in t)}
    kept = {r.doc_id for r in corpus_pipeline.one_of_each_class(spark, docs, sf_dir).collect()}
    assert kept == {k for k, (_, c) in classes(list(everything.items())).items() if k == c}
    clean = {r.doc_id for r in corpus_pipeline.without_benchmark(spark, docs, sf_dir).collect()}
    items = [" ".join(r.text.lower().split()) for r in table(spark, sf_dir, "benchmark").collect()]
    held = {k for k, t in everything.items() if any(f" {i} " in f" {' '.join(t.lower().split())} " for i in items)}
    assert not held & clean and len(everything) - len(clean) <= len(held) + 2
    rows = __spark_entry__.queries()["pipeline"](spark, sf_dir).collect()
    assert {r.doc_id for r in rows} <= known & kept & clean and {r.shard for r in rows} <= set(range(40)) and len(rows) > 0.5 * len(known & kept & clean)
