import hashlib
import random

import pytest

PLAIN = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(PLAIN) + r.choice(["", "", "s", "ed", ","]) for _ in range(n))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, uid string, print string, key string, label int"


def row(i, text, source="s0"):
    """Columns beyond doc_id and text clash with names that operators use inside."""
    return (i, text, "en", source, None if text is None else len(text), 7, "uid", "print", "key", 1)


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty texts, white space of many kinds, a very long text, ties, repeated rows, near copies."""
    base = prose(1, 120)
    texts = [
        base, base, base + " extra tail words", prose(2, 60), "", None, " \t\n", "one", "one two", "one two three", "ONE two Three", "été ça là naïve　x", "a\x1cb c\x85d",
        prose(3, 30) + "\n" + prose(4, 30) + "\n\n" + prose(3, 30), "x" * 3000, prose(5, 6000), "the same the same the same the same the same the same the same",
        prose(2, 60) + " " + prose(6, 20), "don't  stop 'll 123 456abc!!! \n\n\t end ", "<|endoftext|> in a text <|endoftext|>", "\U0001f468‍\U0001f469‍\U0001f467 emoji",
    ]
    rows = [row(i, t, None if i % 7 == 3 else f"s{i % 3}") for i, t in enumerate(texts)]
    rows += [rows[0], rows[4], row(None, base), row(None, None), row(None, prose(9, 40)), row(3, "another text of one id"), row(-5, prose(2, 60))]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(x: str | bytes) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()
