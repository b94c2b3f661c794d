import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def edge_rows():
    """Documents with nulls, empty and very long texts, ties, repeats and near copies."""
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice(["ba", "de", "thé", "ing", "o", "ur", "nn"]) for _ in range(rnd.randint(1, 3)))
    prose = lambda n: " ".join(word() for _ in range(n))
    base, long, passage = prose(120), prose(6000), prose(150)
    near = base.split(" ")
    near[60] = "changed"
    texts = [
        None, "", " \n\t", "one", "one two three", base, base, " ".join(near), base.upper(), long, long + " tail", prose(200),
        prose(80) + " " + passage + " " + prose(70), prose(50) + " " + passage, passage + "\n" + passage, "a b c " * 300, "x" * 3000,
        "日本語 テスト " * 100, "emoji 😀 " * 90, "the of and " * 30, "same line\nsame line\nother\n\n" * 9, prose(9), prose(10),
    ]
    rows = [(i, t, "en", "s", None) for i, t in enumerate(texts)]
    return [*rows, rows[5], rows[3], (None, base, None, None, None), (None, None, None, None, None), (7, "another text of a repeated id", None, None, 3)]


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
