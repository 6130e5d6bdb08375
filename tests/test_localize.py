"""Translations by shape: slots are put back, warnings and capabilities keep their parts, unknown texts stay."""

from __future__ import annotations

from skillcorpus.operators.localize import dictionary, localized


def test_shapes(spark):
    want = {
        "Repeated content": "内容重复", "Repeated content — in a warning": "内容重复 —— 出现在警告里", "Unknown — in a warning": "Unknown —— 出现在警告里", "Removed 1,204 duplicate lines": "删除了 1,204 行重复内容", "Removed 1 duplicate line": "删除了 1 行重复内容", "Grade F → B — sharper description/trigger": "触发描述更精准了 —— 评分从 F 提到 B",
        "−31% tokens (18,325 → 12,600)": "正文压缩 31% —— 18,325 → 12,600 token", "Tighter wording (grade A, 900 tokens)": "措辞更紧凑了（评分 A，900 token）", "Script capability: runs encoded content": "脚本能力：运行编码内容", "Script capability: sings": "脚本能力：sings", "Over the spec’s line budget": "超出官方 500 行预算", "Blocked": "已拦截", "Removed 3 odd words": "Removed 3 odd words", "": "", None: None,
    }
    rows = spark.createDataFrame([(k, 1) for k in want] + [("Blocked", 2)], "t string, en int")
    got = localized(rows, "t", dictionary(spark)).collect()
    assert {r.t: r.zh for r in got} == want and len(got) == len(want) + 1
    assert localized(rows.filter("false"), "t", dictionary(spark)).collect() == []
