import random

import pytest
from tests_llm_helpers import prose

#: Columns whose names operators use inside; they must pass through or be ignored.
CLASHING = {c: "int" for c in ("key", "h", "size", "row", "group", "node", "n", "score", "spans", "_x", "cell", "block", "part", "total", "rank", "label2", "take")}


@pytest.fixture(scope="session")
def odd_rows():
    """doc_id, text, lang, source, n_chars: nulls, empty, long and repeated texts, other scripts."""
    rng = random.Random(5)
    long = prose(rng, 40_000) + " " + "x" * 300_000
    rows = [
        (1, "Plain words here", "en", "a"), (2, None, "en", "a"), (3, "", None, None), (4, " \t\n\x0b ", "de", "b"), (5, "one", "en", "b"),
        (6, long, "en", "c"), (7, "12345 !!! ???", "xx", "c"), (8, "Ωμέγα \U0001f600 漢字 данные", "el", None), (None, "no id at all", "en", "a"),
        (9, "same words again and again", "en", "a"), (9, "same words again and again", "en", "a"), (10, "nul\x00byte and   spaces ", None, "d"),
    ]
    return [(i, t, la, s, len(t) if t is not None else None) for i, t, la, s in rows]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(7) for c in CLASHING})


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
