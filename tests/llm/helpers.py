"""Small inputs that every operator must take, and a total order of rows."""

from __future__ import annotations

DOCS = "doc_id long, text string"

ODD_DOCUMENTS = [
    (None, None), (None, "a b c"), (None, "a b c"), (1, ""), (2, " \n\t"), (3, "a b c a b c " * 30), (4, "x" * 70_000 + " tail"),
    (5, "é ü 中文 😀 \x1c z"), (6, "# * $ line\n# * $ line\n\nother | line"), (7, "one two three four five six seven " * 10),
    (7, "one two three four five six seven " * 10), (7, "the same id with another text"), (10, "a b c"),
]


def ordered(rows) -> list[tuple]:
    """Rows in an order that allows nulls."""
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is not None, x if x is not None else 0) for x in r))


def with_clashes(df):
    """Extra columns named like inner and result columns of the operators."""
    from pyspark.sql import functions as F

    names = ["key", "row_key", "class", "score", "kept", "n_words", "chunk", "bucket", "positions", "length", "task", "a.b"]
    return df.select("*", *[F.lit(k).alias(n) for k, n in enumerate(names)])
