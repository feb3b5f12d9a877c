"""Words that make texts without chance repeats."""

import random


def prose(seed: int, n: int) -> list[str]:
    pick = random.Random(seed)
    syllables = "ba ke li mo nu ra se ti vo xa zu dre fli gro".split()
    return ["".join(pick.choices(syllables, k=pick.randint(2, 4))) for _ in range(n)]


def lines(words: list[str], per: int = 9) -> str:
    return "\n".join(" ".join(words[i : i + per]) for i in range(0, len(words), per))
