"""Rows that the operators' tests share."""

from __future__ import annotations

import random
import re

#: Columns beside doc_id and text have names that operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block int, h long, n long, size string, component_id string, shared string, train boolean, word string, x string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows):
    """rows: (doc_id, text[, lang[, source]])."""
    return spark.createDataFrame([tuple([*r, *[None] * (14 - len(r))]) for r in rows], SCHEMA)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


#: Null and empty texts, blanks, repeated rows, a null id, letters beyond ASCII, and a very long text.
EDGES = [
    (1, None, "en", "web"), (2, "", "en", "web"), (3, " \t\n\r ", None, None), (4, "one", "en", ""), (5, "Zwölf Boxkämpfer   jagen — 日本語 😀", "de", "web"),
    (6, prose(6, 40), "en", "books"), (6, prose(6, 40), "en", "books"), (None, prose(7, 30), None, "web"), (None, None, None, None), (8, prose(8, 30_000, 5000), "en", "web"), (9, "A\x00b \x0b c", "en", None),
]
