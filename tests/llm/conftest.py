import random

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long, line string, item long, key string"


def frame(spark, texts, first=0):
    """Documents with ids from ``first`` and columns whose names clash with the operators' own."""
    rows = [(first + k, t, "xx", f"s{k % 3}", None if t is None else len(t), "clash", 7, "clash") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="session")
def prose():
    """A function that makes n words of seeded prose."""
    draw = random.Random(11)
    syllables = "an the re tion ou en ti ha st ing nd ea".split()

    def words(n):
        return " ".join("".join(draw.choice(syllables) for _ in range(draw.randint(1, 3))) for _ in range(n))

    return words
