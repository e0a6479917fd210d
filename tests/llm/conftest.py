import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from (doc_id, text) pairs, with columns whose names clash with those that operators make."""

    def make(rows):
        schema = "doc_id long, text string, lang string, source string, n_chars long, score double, fp string, _text string, part int, label string"
        return spark.createDataFrame([(i, t, None, "s", None if t is None else len(t), None, "x", None, 1, None) for i, t in rows], schema)

    return make


@pytest.fixture(scope="session")
def sample():
    """Texts with copies, near copies, shared passages, hot passages and odd characters."""
    import random

    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(400)] + ["É", "naïve", "日本", "x\u0085y"]
    line = " ".join(rng.choice(words) for _ in range(30))
    rows = []
    for i in range(60):
        body = [rng.choice(words) for _ in range(rng.choice([0, 1, 2, 5, 40, 90, 200]))]
        if i % 3 == 0:
            body[len(body) // 2 : len(body) // 2] = [line]
        rows.append((i * 7, rng.choice([" ", "\n", "\t "]).join(body)))
    for i in range(12):
        rows.append((1000 + i, rows[i * 2][1]))
        rows.append((2000 + i, rows[i * 3][1].replace("a", "b", 1)))
    rows += [(5000, None), (5001, ""), (5002, "  \n "), (None, line), (None, None), (5003, "aa " * 900), (5003, "aa " * 900), (5003, "other"), (5004, "ab" * 3000)]
    return rows
