import random

import pytest

#: Names that operators use inside, as extra columns of a table.
CLASHING = ["block", "payload", "uid", "n", "h", "row", "score", "others", "idx", "kind", "found_id", "component_id"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng, n):
    return " ".join("".join(rng.choice(["ka", "lo", "mi", "ne", "ru", "ta", "vé", "zo"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Texts with copies, near copies, shared passages and lines, empty, null, short and long ones."""
    rng = random.Random(4)
    line, passage = sentence(rng, 14), sentence(rng, 60)
    out = [None, "", " \n\t ", "one two", "One  TWO", "a b c d e", "x" * 49, "y" * 50, "y" * 51, "z" * 400, "ab" * 300]
    out += [sentence(rng, rng.randint(5, 80)) for _ in range(25)]
    out += [f"{sentence(rng, 20)}\n{line}\n{sentence(rng, 30)}" for _ in range(12)]
    out += [f"{sentence(rng, 10)} {passage} {sentence(rng, 10)}" for _ in range(6)]
    base = sentence(rng, 90).split()
    for i in range(25):  # one family of near copies, of which some are too far from others
        w = list(base)
        for _ in range(i % 9):
            w[rng.randrange(len(w))] = sentence(rng, 1)
        out.append(" ".join(w))
    out += [out[20]] * 7 + [out[21].upper()] * 3
    out.append("\n".join([sentence(rng, 2500), passage, sentence(rng, 2500)]))
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd(spark, texts):
    """Rows with null ids, repeated rows and ids, nulls elsewhere, and extra columns with clashing names."""
    from pyspark.sql import functions as F

    long = texts[-1]
    rows = [(None, texts[30], None, None, None), (None, None, "en", None, 0), (3, texts[30], "en", "a", 1), (3, texts[30], "en", "a", 1), (3, long, "fr", None, 2), (5, long, None, "b", None), (6, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    for i, c in enumerate(CLASHING):
        df = df.withColumn(c, F.lit(i))
    return df
