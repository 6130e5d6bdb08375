"""Copies of one text and hot shingles stay out of groups."""

from __future__ import annotations

import numpy as np

from skillcorpus.llm import jaccard_join
from tests.llm.test_against_brute_force import classes, near_copies


def test_no_group_holds_all_copies_or_a_hot_list(spark, monkeypatch):
    rows = near_copies(5)
    rows += [(10_000 + i, rows[0][1]) for i in range(300)]
    plain = jaccard_join._shared

    def watched(buckets):
        of = plain(buckets)

        def checked(table):
            if "kind" in table.column_names and 1 in table.column("kind").to_pylist():
                raise AssertionError("rows of documents are grouped")
            h = np.frombuffer(b"".join(table.column("h").to_pylist()), np.uint64)
            ids = np.frombuffer(b"".join(table.column("ids").to_pylist()), np.int64)
            pairs = np.unique(np.stack([h.view(np.int64), ids]), axis=1)
            if len(h) and np.unique(pairs[0], return_counts=True)[1].max() >= 12:
                raise AssertionError("a hot list is grouped")
            return of(table)

        return checked

    monkeypatch.setattr(jaccard_join, "_shared", watched)
    monkeypatch.setattr(jaccard_join, "HEAVY", 1, raising=False)
    monkeypatch.setattr(jaccard_join, "HOT", 12, raising=False)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == classes(rows)
