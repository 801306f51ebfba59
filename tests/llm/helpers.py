"""Plain reimplementations to test against."""

import re

WORD = re.compile(rb"[0-9a-zA-Z\x80-\xff]+")


def words(text):
    return WORD.findall((text or "").lower().encode())


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{int(i)}" for i in rng.integers(0, vocabulary, n))


def rows(df):
    return sorted(tuple(r) for r in df.collect())
