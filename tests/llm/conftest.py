"""Small tables that hold every awkward case."""

from __future__ import annotations

import pytest
from llm_cases import awkward_texts


@pytest.fixture(scope="session")
def awkward(spark):
    """The awkward rows with extra columns whose names clash with those of the operators."""
    rows = [(i, t, "en" if n % 3 else None, "src0", n, n, "x", 0.5, n)
            for n, (i, t) in enumerate(awkward_texts())]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, "
              "n_tokens int, kept string, score double, key long")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, i % 2, int(i in (1, 2, 4))) for i in range(1, 19)] + [(None, 1, 1), (5, None, None), (6, 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
