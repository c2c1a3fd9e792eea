import random

import pytest

SCHEMA = "doc_id long, text string, component_id string, n_chars long"


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text) with copies, near copies, shared passages, odd and empty texts, out of order."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(300)]

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n))

    rows, base, passage = [], prose(80), prose(45)
    for i in range(60):
        rows.append(prose(rng.randint(1, 120)))
        if i % 3 == 0:
            edited = base.split()
            for _ in range(rng.randint(0, 9)):
                edited[rng.randrange(80)] = rng.choice(words)
            rows.append(" ".join(edited))
        if i % 7 == 0:
            rows.append(f"{prose(10)}\n{passage}\t{prose(9)}\n{passage}")
    rows += [None, "", " \n\t ", "one", "one", "a b c d", "A b C d", base, base.upper(), prose(3000) + "\n" + prose(3000), "中文 字 " * 30, "x y \U0001f642"]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame([(i, t, "clash", None) for i, t in corpus], SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
