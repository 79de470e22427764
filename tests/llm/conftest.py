import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside, as columns that they must leave alone.
CLASHING = ("node", "sig", "ids", "size", "cell", "shard", "uid", "mark", "bucket", "rank", "length", "score", "key", "comp")


@pytest.fixture(scope="session")
def clash():
    """Adds columns under names that operators use inside."""
    from pyspark.sql import functions as F

    return lambda df: df.withColumns({c: F.lit("clash") for c in CLASHING if c not in df.columns})


@pytest.fixture(scope="session")
def corpus(spark, clash):
    """Small documents of every odd kind: (DataFrame with clashing extra columns, list of (doc_id, text, source))."""
    rnd = random.Random(5)
    words = ["alpha", "Beta", "gamma", "delta's", "épsilon", "ζήτα", "eta,", "theta.", "42", "x", "漢字", "under", "the", "mit", "license"]
    rows = []
    for k in range(90):
        text = " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 60)))
        rows.append((k, text, rnd.choice(["a", "b", "c", None])))
    base = " ".join(rnd.choice(words) for _ in range(120))
    rows += [(100 + k, base, "a") for k in range(6)]  # exact copies
    for k in range(12):  # near copies
        w = base.split()
        w[rnd.randrange(len(w))] = f"edit{k}"
        rows.append((120 + k, " ".join(w), "b"))
    rows += [(200, None, "a"), (201, "", "b"), (202, " \n\t ", None), (203, "a  b \n\n c   ", "c"), (204, "word " * 3000, "c"), (205, "\x00\x1f É́ x y", "c"), (206, "<|endoftext|> a", "c")]
    rows += [(300, "twice the same row", "a")] * 2 + [(None, "no id at all", "a"), (None, None, None)]
    df = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA)
    return clash(df), rows


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
