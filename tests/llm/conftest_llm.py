"""What the tests of this folder share."""

import random

WORDS = "the of and to in that is was for on with as by at from this have not are but".split()
ODD = [
    None,
    "",
    " \t\n\x0b\x0c\r ",
    "one",
    "a b",
    "Ünïcode ñandú çava   x y \U0001f600 \x1c z",
    "12 34 5,6",
    "same line\nsame line\nsame line\nother",
    "#*$%&|<> ## A-Z abc",
    "x" * 5000,
]


def prose(rng: random.Random, n: int, words=WORDS) -> str:
    return " ".join(rng.choice(words) for _ in range(n))


def vocabulary(seed: int, n: int = 400) -> list[str]:
    rng = random.Random(seed)
    parts = ["an", "er", "th", "on", "ea", "ti", "sh", "ou", "re", "in"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(2, 4))) for _ in range(n)]
