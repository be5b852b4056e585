import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _gone string, key string, row long"


@pytest.fixture
def make_docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, source), with extra columns whose names clash with inner ones."""

    def make(rows, partitions=3):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1]) if r[1] is not None else None, "x", "y", 7) for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(partitions, "doc_id")

    return make


def words(n, seed=0):
    import random

    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(n))
