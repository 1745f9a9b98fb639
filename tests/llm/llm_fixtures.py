"""Small tables that hold every odd case at once."""

from __future__ import annotations

import random

ODD = (None, "", " \t\n", "a", "?!", "é", "word", "Straße 東京", "one two three four five", "<|endoftext|> x", "x" * 5000)
#: Names that the operators use inside.
CLASHING = "bits key row word block words seed spans score leaf held_out run owner label at kept_id leak_id examples"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, extra: bool = True):
    """Documents from (doc_id, text, lang, source), with further columns of clashing names."""
    full = [(d, t, lang, s, None if t is None else len(t)) for d, t, lang, s in rows]
    names = CLASHING.split() if extra else []
    schema = ", ".join([SCHEMA, *(f"{n} string" for n in names)])
    return spark.createDataFrame([(*r, *("?",) * len(names)) for r in full], schema)


def prose(seed: int, n: int, words: int = 60) -> list[str]:
    rng = random.Random(seed)
    syllables = "ba con del fi gor hu im ka lo mer nu op pri qua re sol tu vex wi zo".split()
    vocabulary = ["".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(300)]
    return [" ".join(rng.choices(vocabulary, k=rng.randint(words // 2, words))) for _ in range(n)]


def odd_rows() -> list[tuple]:
    """Odd texts, a repeated row, null columns."""
    rows = [(i, t, ("en", None)[i % 2], ("s1", None)[i % 3 == 0]) for i, t in enumerate(ODD)]
    return [*rows, rows[4], (None, "null id with words in it", None, None), (-5, "negative id", "en", "s1")]


def as_set(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
