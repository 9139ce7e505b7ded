import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng: random.Random, words: int, parts: str) -> str:
    own = random.Random(parts)
    vocabulary = ["".join(own.choice(parts.split()) for _ in range(own.randint(1, 3))) for _ in range(400)]
    return " ".join(rng.choice(vocabulary) for _ in range(words))


def rows() -> list[tuple]:
    """Texts of two languages with exact and near copies, shared passages, odd texts, ties and repeated rows."""
    rng = random.Random(5)
    en, de = "th er on re in at st ea nd ou", "sch ei ch ung ge ver ü ä tz pf"
    out = []
    passage = prose(rng, 60, en)
    for i in range(60):
        words = rng.randint(1, 120)
        text = prose(rng, words, en if i % 3 else de)
        if i % 5 == 0:
            text += "\n" + passage
        out.append((i * 7 % 61, text, "en" if i % 3 else "de", f"s{i % 4}" if i % 9 else None, len(text)))
    base = prose(rng, 150, en).split(" ")
    for i in range(8):  # near copies
        words = list(base)
        words[rng.randrange(len(words))] = f"edit{i}"
        out.append((100 + i, " ".join(words), "en", "s0", 1))
    out += [(120, out[0][1], "de", "s1", 1), (121, out[0][1].upper(), "de", "s1", 1)]  # copies
    out += [(130, None, "en", "s2", None), (131, "", "en", "s2", 0), (132, " \n\t", None, "s2", 3), (133, "12 34 !!", "en", None, 8), (134, "x", None, "s3", 1)]
    out += [(140, "ab " * 4000 + passage, "en", "s3", 1), (141, "z" * 3000, None, "s3", 1), (142, "日本語の文章 <|endoftext|> naïve", None, "s0", 1)]
    out += [(150, "the same row twice, the very same", "en", "s1", 33)] * 2
    return out


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, and columns whose names clash with those the operators use."""
    data = [(None, None, None, None, None, 1, "a", 0.5), (1, "some words of text here and there", None, None, None, 2, None, None), (None, "other text", "en", "s", 3, 3, "b", 1.0)]
    return spark.createDataFrame(data, SCHEMA + ", size int, kind string, score double")
