"""One small table with nulls, empty and long texts, ties, repeated rows and clashing columns."""

from __future__ import annotations

PROSE = " ".join(f"word{i % 37}x{i * i % 101} and" for i in range(160))
NEAR = PROSE.replace("word5x", "other5x", 1)

ROWS = [
    (1, PROSE), (2, PROSE), (2, PROSE), (3, NEAR), (4, None), (5, ""), (6, " \n\t"), (7, "###"), (8, "$$$"),
    (None, "a text without an id"), (None, None), (9, "wörter äöü 漢字 😀 mail me: a.b@c.de or 10.0.0.1"),
    (10, "tail " * 30_000), (11, PROSE + " " + PROSE), (12, "x" * 70_000), (12, "same id, other text"),
]
SCHEMA = "doc_id long, text string, row string, id long, part int, score double, label int, size int, `odd name.x` string"


def table(spark, rows=ROWS):
    full = [(i, t, "r", 1, 2, 0.5, 1, 3, "o") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
