import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Makes a table of documents from (doc_id, text) or (doc_id, text, lang)."""

    def make(rows, extra=""):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOC)
        if extra:
            for name in extra.split():
                df = df.selectExpr("*", f"'x' AS `{name}`")
        return df

    return make


@pytest.fixture
def vectors(spark):
    def make(rows, kind="float"):
        return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")

    return make


@pytest.fixture(scope="session")
def words():
    import random

    rng = random.Random(4)
    return ["".join(rng.choice(["an", "er", "th", "ou", "ti", "on", "re", "st"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]
