"""Helpers that test modules import by name."""

import random
import re

LOWER = {i: i + 32 for i in range(65, 91)}
SYLLABLES = "th er on an in ed is at es or ti ar te en ing ou ea hi ve co".split()


def split_words(text, lower=True):
    """The words of the contracts: runs of other characters than space and 0x09-0x0D."""
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER) if lower else text or "")


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n))
