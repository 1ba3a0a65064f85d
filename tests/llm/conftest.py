from __future__ import annotations

import pytest


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang), with an extra column."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, f"extra{i}") for i, r in enumerate(rows)]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, note string")

    return make
