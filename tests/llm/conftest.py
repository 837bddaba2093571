import random

import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def table(spark):
    """(id, text) rows as documents, with columns whose names the operators use themselves."""

    def make(rows):
        df = spark.createDataFrame(list(rows), "doc_id long, text string")
        for name in ("chunk", "bucket", "n_words", "n_lines", "text_hash", "component_id", "_id", "h1", "u", "held_items", "score"):
            df = df.withColumn(name, F.lit("x"))
        return df

    return make


@pytest.fixture(scope="session")
def texts():
    """Texts with shared passages, copies, near copies, frequent lines, odd white space, nulls and empties, one of them long."""
    rnd = random.Random(7)
    vocabulary = ["".join(rnd.choice("abcdefgéü中") for _ in range(rnd.randint(1, 9))) for _ in range(400)]
    words = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    join = lambda w: "".join(x + rnd.choice([" ", " ", " ", "\n", "\t", "  ", "\r\n"]) for x in w)
    passages = [words(rnd.choice([12, 13, 14, 30, 80])) for _ in range(8)]
    lines = ["  The same Boilerplate line of more than forty characters " + str(k) for k in range(3)] + ["short line"]
    rows = []
    for i in range(70):
        parts = words(rnd.randint(0, 60))
        for _ in range(rnd.randint(0, 2)):
            parts += rnd.choice(passages) + words(rnd.randint(0, 20))
        text = join(parts)
        for _ in range(rnd.randint(0, 2)):
            text += "\n" + rnd.choice([str.upper, str.strip, str])(rnd.choice(lines)) + "\n"
        rows.append((i * 3, text))
    base = words(150)
    for i in range(12):
        near = list(base)
        for _ in range(i % 4):
            near[rnd.randrange(len(near))] = "edit" + str(i)
        rows.append((1000 - i, " ".join(near)))
    rows += [(2000 + i, rows[3][1]) for i in range(4)]
    rows += [(3000, None), (3001, ""), (3002, " \n\t "), (3003, "one two"), (3004, "One  two"), (3005, "a " * 3000), (3006, "\n\n"), (3007, "x" * 5000)]
    rows += [(3010, rows[5][1]), (3010, rows[5][1]), (3011, join(words(40))), (3011, join(words(40))), (None, rows[5][1]), (None, None)]
    rnd.shuffle(rows)
    return rows
