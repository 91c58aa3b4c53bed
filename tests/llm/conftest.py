import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, slot int, label string, kept boolean, uid string, t string, n_words long, `__x` int"


def odd_rows(seed=5):
    """Texts with nulls, blanks, ties, repeats, long ones and line structure; ids with a null and a repeat."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(1, 7))) for _ in range(400)]

    def text(n):
        return "".join(r.choice(vocabulary) + r.choice([" ", " ", " ", "  ", "\n", ", ", ". "]) for _ in range(n))

    base = [text(r.randint(1, 120)) for _ in range(60)]
    near = []
    for b in base[:25]:
        words = b.split(" ")
        for _ in range(3):
            copy = list(words)
            for _ in range(r.randint(0, 3)):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            near.append(" ".join(copy))
    texts = [None, "", " ", "\n\n", "word", "two words", "Two  WORDS", "a b c", "A B c", "é è\tü", *base, *near, base[0], base[0], base[1], text(8000), "x " * 3000]
    rows = [(k, t, r.choice(["en", "de", None]), r.choice(["s1", "s2", "s3", None]), len(t or ""), 1, 2, "l", True, "u", "t", 3, 4) for k, t in enumerate(texts)]
    rows.append((7, texts[7], "en", "s1", 5, 1, 2, "l", True, "u", "t", 3, 4))
    rows.append((None, base[2], "en", "s1", 5, 1, 2, "l", True, "u", "t", 3, 4))
    r.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
