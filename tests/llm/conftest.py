from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def docs_of(spark):
    """Documents from (doc_id, text[, source]) tuples, with columns whose names operators use inside."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None, 1, 2) for r in rows]
        return spark.createDataFrame(full, SCHEMA + ", size int, score int")

    return make
