"""Documents with everything that may go wrong: nulls, empty and very long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

LONG = " ".join(f"w{i % 997}x{i % 31}" for i in range(60_000))
PASSAGE = "this passage of over twenty words is repeated in several documents so that each later copy of it must be taken out again"
TEXTS = [
    "a plain text of few words",
    "",
    None,
    " \t\n ",
    f"before it {PASSAGE} after it",
    f"{PASSAGE} {PASSAGE}",
    f"Other start\n{PASSAGE}",
    "tie " * 50,
    LONG,
    "naïve café 日本語 \U0001f642▁ x y",
    "a plain text of few words",
    "one",
    "\x00 nul and   odd separators \x0b here",
]


def documents(spark, extra: str = ""):
    """The texts under ids 0, 1, ..., the last two rows repeated, one row without an id; ``extra`` adds columns as DDL."""
    rows = [(i, text) for i, text in enumerate(TEXTS)]
    rows += rows[-2:] + [(None, f"nameless {PASSAGE}")]
    names = [part.split()[0] for part in extra.split(", ")] if extra else []
    schema = "doc_id long, text string" + (f", {extra}" if extra else "")
    return spark.createDataFrame([(*row, *["7"] * len(names)) for row in rows], schema).repartition(3)


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")
