import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and to in a is that it on for was with as be by this are or from at an have not one all were we when your can said there use each which she do how their if will up other about out many then them these so some her would make like him into time has look two more write go see number no way could people".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    out = []
    for i in range(n):
        out.append(rng.choice(WORDS) if rng.random() < 0.4 else "".join(rng.choice(["ta", "ri", "mon", "el", "su", "ker"]) for _ in range(rng.randint(1, 4))))
        if rng.random() < 0.1:
            out[-1] += rng.choice([".", ",", ".\n"])
    return " ".join(out)


@pytest.fixture()
def documents(spark):
    """documents(texts) as a table; a pair gives the id, too."""

    def make(texts):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        return spark.createDataFrame([(i, t, "en", "src", None if t is None else len(t)) for i, t in rows], SCHEMA).repartition(3)

    return make
