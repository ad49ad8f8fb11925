import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def messy():
    """Documents with nulls everywhere, empty and long texts, ties, repeated ids and rows."""
    rng = random.Random(11)
    vocabulary = ["a", "bb", "The", "ccc", "é", "x" * 70, "don't", "42", "|", "!!"]
    passage = [" ".join(rng.choice(vocabulary) for _ in range(40)) for _ in range(3)]
    rows = [
        (0, ""), (None, passage[0]), (None, "q " + passage[0]), (1, None), (2, " \n"), (7, passage[1]),
        (7, "zz " + passage[1] + " y"), (7, passage[1]), (3, "a " * 300), (9, "a " * 40), (10, "b" * 500),
        (11, "b" * 80), (5, "x"), (12, "one two\tthree"), (13, "one  two three"), (14, "One two three"),
    ]
    for i in range(60):
        text = " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60)))
        if rng.random() < 0.5:
            text += "\t" + rng.choice(passage) + " \n " + " ".join(rng.choice(vocabulary) for _ in range(20))
        rows.append((100 + i, text))
    rows += [(200 + i, passage[2]) for i in range(30)]  # a hot text
    rng.shuffle(rows)
    return [(d, t, None if i % 7 == 0 else "en", [None, "s0", "s1", "s2", ""][i % 5 if i % 3 else 1], len(t or "")) for i, (d, t) in enumerate(rows)]


@pytest.fixture(scope="session")
def docs(spark, messy):
    """The messy documents, with more columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(messy, DOCS)
    for clash in ("oid", "rk", "key", "norm", "fp", "h", "size", "part", "payload", "row", "blob", "bucket", "copies"):
        df = df.withColumn(clash, F.lit("clash"))
    return df.cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.select(*columns).collect()), key=str)
