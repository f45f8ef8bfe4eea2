"""Texts to test with."""

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + (rng.choice(["", "", "s", "ing", "ed"])) for _ in range(n))


#: Texts that every operator has to take: none, empty, blank, one word, ties, repeats, very long ones, odd characters.
ODD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "word"), (5, "word"), (6, "a b c d"), (7, "x" * 300_000), (8, "long words " * 30_000),
    (9, "ünïcödé текст 漢字 🙂 á"), (10, "\x00\x01 nul"), (None, "no id at all here and more words"), (11, "again the same text of some words"),
    (11, "again the same text of some words"), (12, "!!! ??? ..."), (13, "the of and the of"),
]
EXTRA = "doc_id long, text string, lang string, source string, n_chars long, row string, spans string, kept string, cell string, mix string, component string, key string"


def odd_rows():
    return [(i, t, None, None if k % 3 else "s", None, "r", None, "k", "c", "m", None, "y") for k, (i, t) in enumerate(ODD)]
