import random

import pytest

# lang, source and n_chars complete the columns of documents; the rest clash with names
# that operators use inside
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, size long, "
          "h long, spans string, rep long, bucket long, taken double, _key long, shard string")


def row(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, None if text is None else len(text),
            1, 2, "x", 3, 4, 0.5, 5, "y")


@pytest.fixture(scope="session")
def frame(spark):
    def make(rows, parts=3):
        return spark.createDataFrame([row(*r) for r in rows], SCHEMA).repartition(parts)
    return make


@pytest.fixture(scope="session")
def nasty():
    """Nulls, empty and blank texts, ties, repeated rows, copies, a very long text, and
    words and passages that most documents share."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choice(words) for _ in range(90))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "One two"), (6, "one two"),
            (7, "ONE\x0btwo\rthree"), (8, "a " * 300), (9, "a " * 300), (10, "é   \U0001f600" * 60),
            (None, "no id"), (None, None)]
    for i in range(11, 60):
        own = [rng.choice(words) for _ in range(rng.randrange(5, 160))]
        at = rng.randrange(len(own))
        rows.append((i, " ".join(own[:at] + ([passage] if i % 2 else []) + own[at:])))
    base = rows[-1][1].split()
    for i in range(60, 75):  # near copies of different depth
        copy = list(base)
        for _ in range((i - 60) // 3):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        rows.append((i, " ".join(copy)))
    rows += [(75, rows[20][1]), (76, rows[20][1] + " "), (77, rows[20][1].replace(" ", "\n"))]
    rows.append((78, " ".join(rng.choice(words) for _ in range(30_000)) + " " + passage))
    rows.append((79, "x" * 5000))
    rows += [rows[30], rows[30], (1, None)]
    return [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", "ü", None])) for i, t in rows]
