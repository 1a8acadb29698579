import random

import pytest

#: Names that operators use inside, as extra columns of their inputs.
CLASHES = ["n", "part", "kind", "owner", "owners", "token", "score", "words", "rank", "key", "h", "t", "src", "size", "bucket", "found", "block", "cluster", "label", "member", "verdict", "shape", "q", "judged", "copies", "rep", "uid", "length", "piece"]


def sentence(rng, n):
    vocabulary = [a + b for a in "bcdfgkl" for b in ("a", "e", "i", "ona", "uri")] + ["the", "of", "and"]
    return " ".join(rng.choice(vocabulary) for _ in range(n))


def rows():
    rng = random.Random(5)
    long = sentence(rng, 12000)
    near = long.split()
    for k in range(0, 12000, 500):
        near[k] = "changed"
    mid = sentence(rng, 200)
    other = mid.split()
    other[100] = "Other"
    lines = "\n".join(sentence(rng, 12) + "." for _ in range(6))
    out = [
        (0, None, "en", "a", None),
        (1, "", "en", None, 0),
        (2, " \n\t \x0b", None, "a", 5),
        (3, "one two Three", "en", "b", 13),
        (4, "ONE two\tthree", "en", "b", 13),
        (5, long, "en", "c", len(long)),
        (6, " ".join(near), "en", "c", 1),
        (7, mid, "en", "a", 1),
        (7, mid, "en", "a", 1),
        (8, mid.upper(), "en", "a", 1),
        (9, " ".join(other), "en", "b", 1),
        (10, lines, "fr", "b", 1),
        (11, lines + "\n" + lines, "fr", "b", 1),
        (None, sentence(rng, 30), "de", "c", 1),
        (12, "Licensed under the Apache License, Version 2.0. The MIT License; mit license. GNU General Public License v3 été", "en", "c", 1),
        (13, "a | b | c | d | e\nclick here now\nREAD ALL OF THIS NOW\n" + sentence(rng, 30) + ".", "en", "a", 1),
        (14, "é ü 中文 \U0001f600 ß", "es", "d", 1),
        (15, "### $$$ %%% junk " * 20, "en", "d", 1),
    ]
    out += [(20 + i, sentence(rng, 40) + ".", "en", rng.choice("abc"), 1) for i in range(40)]
    return out


@pytest.fixture(scope="session")
def docs(spark):
    frame = spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string, n_chars long")
    from pyspark.sql import functions as F

    return frame.withColumns({c: F.lit(7) for c in CLASHES}).repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.filter("false")


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
