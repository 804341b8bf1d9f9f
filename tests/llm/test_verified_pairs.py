"""Pairs to verify: dealt once for each call, large pivots in several groups, each pair once in the result."""

from __future__ import annotations

from evidentia.llm import near_dedup


def test_pairs_are_dealt_once(spark, monkeypatch):
    texts = [f"a b c d e f g h {'i' if k % 2 else 'j k l m n o p'}" for k in range(12)]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc long, text string").selectExpr("doc", "text", "xxhash64(text) body")
    classes = rows.selectExpr("doc node", "doc chief", "body")
    pairs = spark.createDataFrame([(0, k) for k in range(1, 12)] + [(1, 3), (1, 4)], "a long, b long")
    labels = []
    real = near_dedup.written
    monkeypatch.setattr(near_dedup, "written", lambda df, label: labels.append(label) or real(df, label))
    got = {(r.a, r.b): r.is_link for r in near_dedup.verified(pairs, classes, rows, 5, 75, members=4).collect()}
    assert "wanted" in labels
    assert got == {(a, b): texts[a] == texts[b] for a, b in [(0, k) for k in range(1, 12)] + [(1, 3), (1, 4)]}
