import random
from pathlib import Path

import pytest

CLASHING = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, score double, key string, rng int, id long, fp long, comp long, part int"


def words(seed, n):
    rng = random.Random(seed)
    return [rng.choice(("the", "of", "and", "")) + "".join(rng.choice(("th", "er", "on", "an", "re", "ti", "en", "ou", "é", "ß")) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def prose(seed, n):
    return " ".join(w for w in words(seed, n))


def row(doc_id, text, source="src0"):
    return (doc_id, text, "en", source, None if text is None else len(text), -1, -1, -1.0, "k", -1, -2, -3, -4, -5)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls everywhere, empty and blank and very long texts, repeated rows, clashing columns."""
    long = prose(7, 60_000)
    same = prose(8, 40)
    rows = [
        row(1, None), row(2, ""), row(3, " \n\t "), row(4, long), row(5, same), row(5, same), row(6, same), row(None, same, None), row(None, None, None), row(7, "one", None), row(8, "naïve ßtraße 東京 😀 " + same), row(9, same + " tail"), (10, *[None] * 13),
    ]
    return spark.createDataFrame(rows, CLASHING).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], CLASHING)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, 1, int(i % 2)) for i in range(3, 9)] + [(None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def larger(small):
    """The next but one of the folders beside the small tables: enough labels to hold some out."""
    return str(Path(small).parent / "sf0.1")
