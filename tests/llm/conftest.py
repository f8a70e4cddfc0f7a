import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_hit long, score double, key string"


def corpus() -> list[tuple]:
    """Documents with copies, near copies, repeated passages, nulls, empty and long texts, repeated rows."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)] + ["Élan", "naïve", "über", "日本語"]
    sentence = lambda n: " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."
    text = lambda lines, n=14: "\n".join(sentence(n) for _ in range(lines))
    passage = text(4, 16)
    rows: list[tuple] = []
    for i in range(60):
        rows.append((i, text(rng.randint(1, 9))))
    for i in range(60, 70):
        rows.append((i, rows[i - 60][1]))
    for i in range(70, 80):
        near = rows[i - 70][1].split(" ")
        near[len(near) // 2] = "changed"
        rows.append((i, " ".join(near)))
    for i in range(80, 90):
        rows.append((i, text(3) + "\n" + passage + "\n" + text(2)))
    rows += [(90, None), (91, ""), (92, "one"), (93, "two words"), (94, " \n\t \n"), (95, "a b c d e f g h i j k l m n"), (96, text(400)), (None, text(3)), (None, None)]
    rows += [(97, "x" * 500), (98, "la " * 300), (99, "Same line\n" * 12), (96, rows[-7][1]), (5, rows[5][1]), (5, rows[5][1])]
    return [(i, t, "en", ["b", "a", None, "ü", "", "c"][n % 6], len(t or ""), 7, 0.5, "own") for n, (i, t) in enumerate(rows)]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
