import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def corpus(spark):
    """Awkward rows: nulls, empty, copies, near copies, ties, a very long text, odd characters."""
    rng = random.Random(5)
    vocabulary = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    texts: list = [None, "", " \n\t ", "one", "Same Text", "same text", "SAME TEXT", "é É", "É é", "a\x00b <|endoftext|> c"]
    base = [prose(rng.randrange(30, 200)) for _ in range(30)]
    texts += base
    for b in base[:12]:
        words = b.split()
        for _ in range(rng.randrange(1, 4)):
            own = list(words)
            for _ in range(rng.randrange(0, 3)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            texts.append(" ".join(own))
    family = prose(150).split()
    for i in range(40):
        own = list(family)
        own[(i * 7) % 150] = f"edit{i}"
        own[(i * 13 + 5) % 150] = f"other{i}"
        texts.append(" ".join(own))
    passage = "\n".join(prose(20) for _ in range(4))
    for i in range(6):
        texts.append(f"{prose(12)}\n{passage}\n{prose(9)}")
    texts += [prose(60) + "\nReleased under the MIT License.\n" + prose(5), "GNU   General-Public_License x", "Licensed under the Apache License, Version 2.0.", prose(12_000), "x ### $$ ** " * 40, ("junk junk junk " * 60).strip()]
    rows = [(i, t, ["en", "fr", None][i % 3], [None, "a", "b", "c"][i % 4] if i % 5 else "a", 0) for i, t in enumerate(texts)]
    rows += [(4, "Same Text", "en", "a", 0), (None, "without an id", "en", "a", 0), (None, base[0], "en", "z", 0)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5, "doc_id", "text").cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 7 == 0)) for i in range(0, 60)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def clashing(corpus):
    """The corpus with further columns that operators name theirs."""
    from pyspark.sql import functions as F

    names = ["kept", "shard", "size", "taken", "draws", "n_lines", "n_words", "stratum", "digest", "th", "h", "key", "node", "_h", "_own", "Target"]
    return corpus.select("*", *[F.lit(1).alias(n) for n in names])
