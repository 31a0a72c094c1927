"""Small tables with everything that may go wrong."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, class string, value string"
WORDS = [a + b for a in "ba ce di fo gu ha ke li mo nu pa re si to vu".split() for b in "n r s t lm nd st".split()]


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def row(doc_id, body, source="a"):
    """A row with extra columns whose names clash with those of results."""
    return (doc_id, body, "en", source, None if body is None else len(body), 0.5, 7, "x", "y")


def awkward(spark, rng=None):
    """Nulls in any column, empty and blank texts, one word, a very long text, ties, repeated rows."""
    rng = rng or random.Random(1)
    same = text(rng, 80)
    rows = [
        row(1, same),
        row(2, same),
        row(2, same),
        row(3, None),
        row(4, ""),
        row(5, " \t\n"),
        row(6, "word"),
        row(7, "WORD"),
        row(8, text(rng, 20_000)),
        row(None, same),
        row(None, None),
        row(9, text(rng, 90), None),
        (10, text(rng, 70), None, None, None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)
