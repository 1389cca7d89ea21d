import pytest
import public_tokenizers

#: Words that make up the texts of small tests.
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


@pytest.fixture(scope="session")
def path():
    return public_tokenizers.path


def text(seed: int, n: int = 60) -> str:
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 50)) for _ in range(n))


@pytest.fixture(scope="session")
def make_text():
    return text


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, columns whose names clash."""
    rows = [
        (1, text(1), "en", "a", "x", 1.0, 1), (2, None, "en", "a", "x", 1.0, 1), (3, "", None, "a", "x", 1.0, 1), (4, "   \n\t ", "en", None, "x", 1.0, 1), (5, text(5, 30_000), "en", "a", "x", 1.0, 1),
        (1, text(1), "en", "a", "x", 1.0, 1), (None, text(6), "en", "a", "x", 1.0, 1), (7, "one", "en", "a", "x", 1.0, 1), (8, "Ä中文 é🏽 a  b   c", "de", "a", "x", 1.0, 1), (9, "x" * 50_000, "en", "a", "x", 1.0, 1),
    ]
    # score, n and region are names that operators use inside
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score string, n double, region int").repartition(3)
