import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns named like those that the operators make on their way.
CLASHES = "h long, key string, tokens string, node string, tag int, bucket int, component string, domain string, row string, score double, toxic string, mix_epoch string, keep string"


def prose(rng, n):
    syllables = "th er on an re ing ed en at ou st nd he in or ti ea es ha is".split()
    words = ["".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(n)]
    return " ".join(w.capitalize() + "." if rng.random() < 0.05 else w for w in words)


@pytest.fixture
def rng():
    return random.Random(5)


@pytest.fixture
def table(spark):
    def make(rows, clashes=False):
        rows = [(i, t, *rest) for i, t, *rest in rows]
        full = [(r[0], r[1], *(r[2:4] if len(r) > 2 else ("en", "src1")), None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        if clashes:
            for c in CLASHES.split(", "):
                name, kind = c.split()
                from pyspark.sql import functions as F

                df = df.withColumn(name, F.lit("7").cast(kind))
        return df

    return make


@pytest.fixture
def odd(table, rng):
    """Nulls, empty and long texts, repeated rows, equal ids, clashing columns."""
    long = prose(rng, 30_000)
    rows = [(None, None), (None, "x y z"), (1, ""), (2, None), (3, "   \n\t "), (4, long), (5, long), (5, long), (5, "another text of the same id"), (6, "漢字 カナ ไทย é ñ 🎉" * 3), (7, prose(rng, 80), None, None), (8, "!!! ### ???")]
    return table(rows, clashes=True)
