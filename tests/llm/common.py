"""Small documents with all the awkward cases, shared by the tests."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def texts(seed: int = 1) -> list[str | None]:
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefghijklmnopqrstuvwxyzéß") for _ in range(r.randint(1, 7))) for _ in range(300)]
    prose = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    base = prose(120)
    words = base.split(" ")
    near = []
    for edits in (1, 2, 3, 5, 9):
        w = list(words)
        for _ in range(edits):
            w[r.randrange(len(w))] = r.choice(vocab)
        near.append(" ".join(w))
    passage = prose(45)
    return [
        None, "", "   \n\t", "one", "two words", "One TWO three four", "one two three four", "one two three four five",
        base, base, base.upper(), *near, base + " tail",
        f"{prose(30)} {passage} {prose(10)}", f"{passage} {prose(30)}", f"{prose(5)}\n{passage}\t{passage}",
        " ".join(["same"] * 100), "x" * 5000, prose(3000), "a b c\u00a0d  e\u2003f", "nul\0byte \U0001f600 end",
        *[prose(r.randint(1, 200)) for _ in range(25)],
    ]


def rows(seed: int = 1) -> list[tuple]:
    """Documents with null columns; the last two rows repeat one document."""
    out = [(i, t, None if i % 9 == 0 else "en", None if i % 7 == 0 else f"src{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts(seed))]
    return [*out, (1000, "again and again", "en", "src0", 15), (1000, "again and again", "en", "src0", 15)]


def documents(spark, seed: int = 1):
    return spark.createDataFrame(rows(seed), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
