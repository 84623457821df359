"""Small documents for the operators of the package and plain re-computations of what they must return."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def documents(spark, rows, schema: str = DOCUMENTS):
    return spark.createDataFrame(rows, schema)


def corpus(seed: int = 5, count: int = 60) -> list[tuple]:
    """Texts with shared passages, copies, near copies, odd white space, nulls, empties and one long text."""
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["é", "ß,", "日本", "The", "the"]
    passages = [" ".join(draw.choices(vocabulary, k=draw.randrange(13, 70))) for _ in range(6)]
    rows: list[tuple] = []
    for number in range(count):
        parts = [" ".join(draw.choices(vocabulary, k=draw.randrange(1, 60)))]
        for _ in range(draw.randrange(3)):
            parts.append(draw.choice(passages))
            parts.append(" ".join(draw.choices(vocabulary, k=draw.randrange(0, 20))))
        text = draw.choice([" ", "\n", "\t ", "\r\n"]).join(parts)
        if number % 7 == 3:
            text = rows[-1][1]
        elif number % 7 == 5:
            near = words(rows[-2][1])
            near[draw.randrange(len(near))] = "changed"
            text = " ".join(near)
        rows.append((number * 37 % 1009, text, draw.choice(["en", "de", None]), draw.choice(["a", "b", "Z", None]), len(text)))
    rows.append((5000, None, None, None, None))
    rows.append((5001, "", "en", "a", 0))
    rows.append((5002, " \t\n ", "en", "b", 4))
    rows.append((5003, "one two", "en", "a", 7))
    rows.append((5004, " ".join(draw.choices(vocabulary, k=6000)) + " " + passages[0], "en", "a", 0))
    rows.append((5005, "\x1c x  y ", "en", "c", 7))
    return rows
