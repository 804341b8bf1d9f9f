"""Nearest rows of vectors whose squares overflow or vanish, against exact arithmetic."""

from __future__ import annotations

import random
from fractions import Fraction

import pytest

from evidentia.llm import neighbours


@pytest.mark.parametrize("big", [1.0, 1e155, 1e200, 1e307, 1e-200, 1e-300])
def test_no_finite_vector_is_lost(spark, big):
    draw = random.Random(3)
    rows = [(i, [draw.uniform(-1, 1) * (big if draw.random() < 0.6 else 1.0) for _ in range(4)]) for i in range(60)]
    rows += [(100, [big, 1.0, 0.0, 0.0]), (200, [1.0, 2.0, 0.0, 0.0]), (201, [big, 1.0, 0.0, 0.0])]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=16).collect()
    by_query = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        by_query.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert sorted(by_query) == [0, 100, 200]
    for query, found in by_query.items():
        own = dict(rows)[query]
        square = lambda v, own=own: sum((Fraction(a) - Fraction(b)) ** 2 for a, b in zip(v, own, strict=True))
        want = sorted((square(v), i) for i, v in rows if i != query)[:10]
        assert len(found) == 10
        for (vec, score), (best, _) in zip(found, want, strict=True):
            real = square(dict(rows)[vec])
            assert real <= best * (1 + Fraction(1, 10**9))  # rounding may swap ties
            assert abs(Fraction(score) ** 2 - real) <= real * Fraction(1, 10**9)
