import random

import pytest

DDL = "doc_id long, text string, lang string, source string, n_chars long"


def rows(seed: int = 3, n: int = 60) -> list[tuple]:
    """Small documents with copies, near copies, shared passages, and every odd case."""
    rng = random.Random(seed)
    words = ["alpha", "beta", "Gamma", "dé", "漢字", "x9", "the", "of", "idiot", "(q)", "é!", "end."]
    text = lambda k: " ".join(rng.choice(words) + str(rng.randint(0, 400)) for _ in range(k))
    passage, long = text(45), text(700)
    out = []
    for i in range(n):
        body = text(rng.randint(0, 60))
        if i % 4 == 0:
            body = f"{body}\n{passage} {text(5)}"
        if i % 9 == 0:
            body = long if i % 2 else long.replace(long.split()[300], "other")
        out.append((i * 3, body, "en", f"s{i % 3}" if i % 5 else "s0", len(body)))
    out += [
        (1, None, None, None, None),
        (2, "", "en", "s1", 0),
        (4, " \t\n\x0b\x0c\r ", "en", "s1", 7),
        (5, "a", "en", "", 1),
        (7, "\x00\x1c\x85\xa0　 nul", "en", "s2", 10),
        (None, "no id " + passage, "en", "s1", 10),
        (8, "twice the same row here", "en", "s1", 23),
        (8, "twice the same row here", "en", "s1", 23),
        (10, ("word " * 40).strip(), "de", "s2", 199),
    ]
    return out


@pytest.fixture(scope="session")
def odd_rows():
    return rows()


@pytest.fixture(scope="session")
def docs(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DDL).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DDL)


@pytest.fixture(scope="session")
def clashing(docs):
    """The documents with extra columns named like outputs and helpers."""
    from pyspark.sql import functions as F

    names = "n_words n_hit items score fp key bucket start idx size target taken block component_id n_tokens label blob kind n".split()
    return docs.withColumns({c: F.lit("extra") for c in names})
