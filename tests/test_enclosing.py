"""Innermost scopes against brute force: scopes that overlap in any way, lines at all borders, nulls."""

from __future__ import annotations

import random

from evidentia.operators import search


def test_scopes_against_brute_force(spark):
    rng = random.Random(5)
    scopes = []
    for i in range(300):
        lo = rng.randrange(0, 400)
        scopes.append((f"f{i % 3}", f"s{i}", rng.choice(["method", "class"]), lo, lo + rng.choice([0, 1, 2, 7, 31, 100, 5000])))
    odd = [("f0", None, "method", 0, 9000), ("f0", "turned", "method", 50, 40), ("f0", "open", "class", None, 9), (None, "nowhere", "class", 1, 9)]
    hits = [(f"f{f}", n) for f in range(4) for n in range(0, 520)] + [("f0", 5), ("f1", None), (None, 3)]
    got = search.enclosing(spark.createDataFrame(hits, "file string, lineno int"), spark.createDataFrame(scopes + odd, "file string, name string, kind string, start_line int, end_line int")).collect()

    def best(file, line):
        inside = [(k == "method", lo, n) for f, n, k, lo, hi in scopes if f == file and line is not None and lo <= line <= hi]
        return max(inside)[2] if inside else None

    assert len(got) == len(set(hits))
    assert {(r.file, r.lineno): r.scope for r in got} == {(f, n): best(f, n) for f, n in hits}


def test_meets_by_equality_only(spark):
    hits = spark.createDataFrame([("f", 3)], "file string, lineno int")
    scopes = spark.createDataFrame([("f", "s", "class", 1, 9)], "file string, name string, kind string, start_line int, end_line int")
    plan = search.enclosing(hits, scopes)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
