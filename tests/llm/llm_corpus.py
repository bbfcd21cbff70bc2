"""Invented texts for the tests."""

import random

WORDS = "the of and river stone lamp winter open glass market seven quiet paper horse under bright north cloud table".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


#: Columns beside the documents' own whose names the operators use inside.
EXTRA = ["a", "b", "row", "fp", "line", "node", "component", "score", "position", "at", "n", "m", "gone", "again", "part"]
