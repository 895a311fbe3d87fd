import pytest
from pyspark.sql import Row


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and long texts, repeated rows, copies, near copies and a clashing extra column."""
    base = " ".join(f"word{i % 97}x{i * i % 1009}" for i in range(300))
    near = base.replace("word7x", "other", 1)
    rows = [
        (1, base, "en"), (2, base, "en"), (3, near, "en"), (4, None, None), (5, "", "en"), (6, "  \n▁<s> é日🙂\t a", "fr"), (7, "ab" * 3000, "en"), (7, "ab" * 3000, "en"),
        (None, "short text under the MIT License", "en"), (9, "Licensed under the Apache License, Version 2.0 CC BY-NC", "en"), (10, "x " + base + " y", "de"), (11, "!!! ???", "en"),
    ]
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), 5) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long, n_words int")


@pytest.fixture(scope="session")
def empty(awkward):
    return awkward.limit(0)
