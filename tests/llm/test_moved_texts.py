"""What the Jaccard join moves between tasks."""

from __future__ import annotations

import random

from skillcorpus.llm import jaccard_join
from skillcorpus.plans.storage import cut


def shuffled(spark) -> dict[int, int]:
    """Bytes that stages have written for shuffles, by stage."""
    context = spark.sparkContext
    store, java = context._jsc.sc().statusStore(), context._jvm.java.util.ArrayList
    return {s.stageId(): s.shuffleWriteBytes() for s in context._jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(java(), False, False, context._gateway.new_array(context._jvm.double, 0), java()))}


def test_texts_that_nothing_links_with_are_not_moved(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.randbytes(600).hex() for _ in range(40)) for _ in range(200)]
    words = texts[0].split()
    rows = [*enumerate(texts), (200, " ".join(words[:-1])), (201, texts[1]), (202, None), (None, texts[0])]
    docs = cut(spark.createDataFrame(rows, "doc_id long, text string"), "docs")
    before = shuffled(spark)
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_classes(docs).collect() if r.doc_id is not None}
    moved = sum(v for k, v in shuffled(spark).items() if k not in before)
    size = sum(len(t) for t in texts)
    assert got == {i: i for i in range(203)} | {200: 0, 201: 1}
    assert moved < size / 4
