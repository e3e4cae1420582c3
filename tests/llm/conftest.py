import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = {c: c for c in ("k", "th", "t", "size", "shard", "slot", "norm", "part", "words", "lines", "rate", "tokens", "posteriors", "kept", "d", "head", "host", "label", "tail_probability", "virtual_slot", "n_words")}


def prose(rng: random.Random, n: int) -> str:
    syllables = ["ka", "to", "mi", "ren", "sol", "ba", "due", "lan", "por", "ith", "é", "wen", "gar"]
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))


def odd_documents():
    """Nulls, empty and blank texts, repeated rows, ties, a very long text, copies, near copies, shared passages."""
    rng = random.Random(5)
    passage = prose(rng, 70)
    base = prose(rng, 300)
    words = base.split()
    near = " ".join(words[:150] + ["changed"] + words[151:])
    rows = [
        (None, "a text without id " + prose(rng, 30), None, None, None), (0, None, "en", "s", 0), (1, "", "en", "s", 0), (2, " \t\n", "en", "s", 3),
        (3, base, "en", "s", 1), (4, base, "en", "s", 1), (4, base, "en", "s", 1), (5, near, "fr", None, 1), (6, base.replace(" ", "  "), "fr", "s", 1),
        (7, prose(rng, 40) + " " + passage + " " + prose(rng, 40), "de", "s", 1), (8, prose(rng, 25) + "\n" + passage + "\n" + prose(rng, 10), "de", "s", 1),
        (9, passage + " " + prose(rng, 20) + " " + passage, "de", "s", 1), (10, "one two", "es", "s", 7), (11, "one  two", "es", "s", 8), (12, "word " * 400, "es", "s", 1),
        (13, prose(rng, 30_000), "en", "s", 1), (14, "<|endoftext|> 日本語 é\x0b\x0c\x1c\x00 $$$ don't " * 40, "en", "s", 1),
    ]
    rows += [(20 + i, prose(rng, rng.randint(5, 200)), rng.choice(["en", "fr", "de", "es"]), "s", 1) for i in range(60)]
    rows += [(100 + i, rows[20 + i][1] if i % 2 else " ".join(rows[20 + i][1].split()[: -1 - i % 3]), "en", "s", 1) for i in range(30)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return odd_documents()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def clashing(spark, docs):
    """The same rows with further columns, named as operators may name theirs."""
    from pyspark.sql import functions as F

    return docs.withColumns({c: F.lit(1) for c in CLASHING})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
