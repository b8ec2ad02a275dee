import random

import pytest

WORDS = "the of and to river stone light paper window garden winter summer letter number market bridge".split()


def sentence(rnd, n):
    return " ".join(rnd.choice(WORDS) + str(rnd.randint(0, 40)) for _ in range(n))


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls, empty, blank, very long, repeated and tied rows, and columns whose names operators use inside."""
    rnd = random.Random(11)
    long = sentence(rnd, 30_000)
    near = sentence(rnd, 60)
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, "Hello"), (5, "hello"), (6, "HELLO É"), (7, "hello é"),
        (8, long), (9, long), (10, near), (11, near + " end"), (11, near + " end"), (None, "no id here at all"), (None, None),
        (12, "a b c"), (13, "x " * 5000), (14, "it's 5€ 中文 😀 <|endoftext|> 's"),
    ]
    extra = [(i, t, "en" if k % 2 else None, "src", 0, "x", "y", k, k) for k, (i, t) in enumerate(rows)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, name string, rid int, _words int"
    return spark.createDataFrame(extra, schema).repartition(3).persist()
