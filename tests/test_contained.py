"""Texts that hold a needle, against brute force: short and empty needles, frequent pieces, nulls, accents, plans."""

from __future__ import annotations

import random

from evidentia.operators import evidence, search


def frame(spark, name, values):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def test_against_brute_force(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abß.") for _ in range(rng.randrange(0, 9))) for _ in range(250)] + ["spring." + str(i) for i in range(50)] + [None, "", "É𝄞x"]
    needles = [t[1:-1] for t in texts[:120] if t] + ["", "a", "ab", "spr", "spring.7", "absent", "É", "𝄞x", "%", "a_b", None]
    got = sorted(map(tuple, search.contained(frame(spark, "needle", needles), frame(spark, "text", texts)).collect()))
    assert got == sorted((n, t) for n in set(needles) for t in set(texts) if n is not None and t is not None and n in t)


def test_candidates_without_nested_loop(spark):
    edges = spark.createDataFrame([("Orders", "cust", 2), ("ORDERS_OLD", None, 1), ("o", "", 4)], "src_table string, dst_table string, evidence_count int")
    found = evidence.table_candidates(frame(spark, "term", ["order", "orders_old_x", "CUST", "zz", None, "CUST"]), edges)
    assert "NestedLoop" not in found._jdf.queryExecution().toString()
    assert sorted((r.term, r.table) for r in found.collect()) == [("CUST", "cust"), ("order", "ORDERS_OLD"), ("order", "Orders"), ("order", "o"), ("orders_old_x", "ORDERS_OLD"), ("orders_old_x", "Orders"), ("orders_old_x", "o")]
