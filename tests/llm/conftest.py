import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row int, n_copies int, score string"


def corpus(seed: int = 3, n: int = 60) -> list[tuple]:
    """Ordinary texts, exact copies, near copies, nulls, empties, repeated rows, junk and a long text."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    sentence = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    passage = sentence(60)
    texts = []
    for i in range(n):
        t = sentence(rng.randint(1, 150))
        if i % 5 == 1:
            t = t + "\n" + passage
        if i % 6 == 2:
            t = texts[rng.randrange(len(texts))] or t
        if i % 6 == 3:
            words = (texts[0] or "").split()
            words[rng.randrange(len(words))] = "changed"
            t = " ".join(words)
        if i % 10 == 4:
            t = t.upper()
        texts.append(t)
    texts[0] = sentence(120)
    texts += [None, "", " \t\n", None, "", "one", "one two three", "One TWO three", "ü é x", "a\rb\x0bc\x0cd", sentence(9000), "\n".join([sentence(5)] * 30), "a b " * 200]
    rows = [(i * 3 % 211, t, "en", f"s{i % 3}" if i % 7 else None, len(t or ""), i, i, "x") for i, t in enumerate(texts)]
    return [*rows, rows[5], rows[5], rows[-1]]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
