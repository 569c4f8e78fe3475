import random

import pytest

EDGE = "doc_id long, text string, TEXT_2 string, rank int, label string, part int, bucket int, score double, length long, n int"


@pytest.fixture(scope="session")
def texts():
    """A small corpus with the cases that break operators: nulls, empty and long texts, copies, near copies, repeats."""
    r = random.Random(7)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6))) for _ in range(400)]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    base, passage = say(120), say(60)
    changed = base.split()
    changed[60] = "Other"
    rows = [
        (0, base), (1, base), (2, " ".join(changed)), (3, None), (4, ""), (5, " \t\n"), (6, "one two three"), (7, "One TWO\tthree"), (8, "x" * 1500), (9, say(40) + " " + passage + " " + say(40)),
        (10, passage + " " + say(80)), (11, say(3000)), (12, "é ü \U0001f600 " + say(30)), (13, "ab" * 300), (14, say(90)), (-7, passage), (2**40, base.upper()),
    ]
    return [*rows, *((100 + i, say(r.randint(1, 60))) for i in range(25))]


@pytest.fixture(scope="session")
def documents(spark, texts):
    """The corpus with further columns whose names clash with what operators use within."""
    return spark.createDataFrame([(i, t, "?", 1, "?", 2, 3, 0.5, 4, 5) for i, t in texts], EDGE).repartition(3)
