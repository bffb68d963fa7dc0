"""Awkward rows and small corpora."""

import random
import re

AWKWARD = [
    (1, None),
    (2, ""),
    (3, "   \n\t \n"),
    (4, "one two three"),
    (5, "One TWO three"),
    (5, "One TWO three"),
    (None, "no id here at all\nno id here at all"),
    (None, None),
    (7, "é è 漢字 　 x\x0by\r\nz" * 3),
    (8, "word " * 30_000),
    (9, "x" * 200_000),
    (10, "tab\tand\x0cfeed\n\n\nlines\n"),
]


def frame(spark, rows, extra=False):
    """documents of (doc_id, text); with extra, columns whose names operators use themselves."""
    if not extra:
        return spark.createDataFrame(rows, "doc_id long, text string")
    names = ["n_words", "failed", "kept", "key", "hash", "set_key", "shingles", "ids", "length", "stretch", "tokens", "n_lines"]
    schema = "doc_id long, text string, " + ", ".join(f"{n} string" for n in names)
    return spark.createDataFrame([(a, b, *["?"] * len(names)) for a, b in rows], schema)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def corpus(seed=0, n=120, near=8, hot=25):
    """Documents with exact copies, near copies, shared lines, short ones and unrelated ones."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    text = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    rows, notice = [], "This LINE is   in many documents"
    for i in range(n):
        kind = rng.random()
        if kind < 0.3 and rows:
            own = rng.choice(rows)[1].split(" ")
            for _ in range(rng.randint(0, near)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            rows.append((i, " ".join(own)))
        elif kind < 0.4 and rows:
            rows.append((i, rng.choice(rows)[1]))
        else:
            rows.append((i, text(rng.choice([1, 3, 4, 5, 6, 40, 120, 250]))))
        if i < hot:
            rows[-1] = (i, rows[-1][1] + "\n " + notice + "\t\n" + text(20))
    return rows
