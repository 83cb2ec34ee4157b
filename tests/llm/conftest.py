import random

import pytest

WORDS = "the of and reed harbour tide lantern granite willow copper meadow signal orchard window river stone paper garden".split()


def prose(seed: int, n: int) -> str:
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) + str(draw.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark, tmp_path_factory):
    """Documents with nulls, empty, blank and very long texts, copies, repeated rows and clashing column names."""
    a, b = prose(1, 300), prose(2, 260)
    rows = [
        (1, a, None), (2, a, "x"), (3, a.replace(" ", "  ") + " ", "x"), (4, b, "x"), (5, b + " tail", "x"), (6, "", None), (7, None, None), (8, " \n\t", "x"),
        (9, prose(3, 60) + "\n" + prose(4, 90), "x"), (10, prose(5, 20) + "\n" + prose(4, 90) + "\n" + prose(6, 5), "x"), (11, "é 中文 😀 ﬁ", "x"), (12, "word " * 30000, "x"),
        (12, "word " * 30000, "x"), (None, prose(7, 40), "x"), (14, "one line of forty characters, more or less\nshort", "x"), (15, "one line of forty characters, more or Less\nshort", "x"),
    ]
    schema = "doc_id long, text string, source string, sum string, key int, first string, digest string, n int, kept_doc int, stays string, first_id int, bad_id int, wanted_id int, n_dropped string, verdict string"
    return spark.createDataFrame([(i, t, s, "s", 1, "f", "d", 2, 3, "t", 4, 5, 6, "u", "v") for i, t, s in rows], schema)


@pytest.fixture()
def no_docs(odd_docs):
    return odd_docs.filter("false")
