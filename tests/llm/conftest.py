import pytest

CLASHES = ("severity", "toxic", "quality", "key", "sig", "band", "_id", "_k", "comp", "token_ids", "_words", "_spans", "_items", "hash", "score", "Label")


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with nulls, empty and long texts, repeated rows, ties, and extra columns whose names clash."""
    import random

    random.seed(5)
    long_ = " ".join(random.choice("abcdefghij") * random.randint(1, 4) for _ in range(30000))
    rows = [(1, None), (2, ""), (3, "   \n "), (4, "one two three four five six"), (4, "one two three four five six"), (5, "one two three four five six"), (None, "one two three"), (None, None), (6, long_), (7, long_ + " x"), (8, "naïve 日本語 \U0001f600 ▁ text </s>\x00"), (9, "x" * 50000), (10, "idiot scum CC BY!! | # all rights reserved")]
    rows = [(i, t, "en", f"s{k}", None, *range(len(CLASHES))) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` long" for c in CLASHES)).repartition(3)
