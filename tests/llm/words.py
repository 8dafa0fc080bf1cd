from __future__ import annotations

import random

WORDS = "river stone light under winter garden paper silver music window history often measure between quiet answer people travel morning letter".split()


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))
