import pytest

WORDS = "amber basil cedar delta ember fjord grove heron ivory jetty knoll larch maple nylon ochre pearl quill raven sedge thorn umber vapor waltz xenon yacht zebra".split()


def sentence(seed: int, n: int) -> str:
    import random

    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice("abcdefgh") for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text): plain, repeated, near copies, null, empty, short, long and odd texts."""
    base = sentence(1, 120)
    rows = [(1, base), (2, base), (3, base.replace(base.split()[60], "other", 1)), (4, sentence(2, 80)), (5, None), (6, ""), (7, "one two"), (8, "ONE two"), (9, " \n\t "), (10, sentence(3, 6000)), (11, "日本語 テキスト 😀 é ß"), (12, "x" * 5000)]
    rows += [(20 + i, " ".join(base.split()[: 100 + i])) for i in range(0, 20, 4)]
    return [*rows, (1, base), (None, base)]


@pytest.fixture
def docs(spark, texts):
    """The texts among columns whose names the operators use inside."""
    rows = [(i, t, "en", "s", 7, 1.5) for i, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, tokens int, n double")


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, tokens int, n double")
