"""Small corpora with nulls, empty and long texts, ties and repeated passages."""

import random

SYLLABLES = ["ab", "é", "the", "of", "xyz", "q", "mn", " ", " ", "\n"]


def syllables(rng: random.Random, n: int) -> str:
    return "".join(rng.choice(SYLLABLES) for _ in range(n))


def passages(seed: int, count: int) -> list[tuple[int, str | None]]:
    rng = random.Random(seed)
    shared = [syllables(rng, 60) for _ in range(6)]
    docs: list[tuple[int, str | None]] = []
    for i in range(count):
        text: str | None = syllables(rng, rng.randint(0, 80))
        for _ in range(rng.choice([0, 0, 1, 2])):
            p, a = rng.choice(shared[:2] if i % 2 else shared), rng.randint(0, 30)
            text += p[a : a + rng.randint(10, 60)] + syllables(rng, rng.randint(0, 20))
        if i % 7 == 0 and docs:
            text = rng.choice(docs)[1]
        if i % 11 == 0:
            text = rng.choice([None, "", "abc", "a" * 200, "ab" * 100])
        docs.append((i * 2, text))
    docs.append((count * 2, syllables(rng, 30_000)))
    rng.shuffle(docs)
    return docs


def near_copies(seed: int, count: int) -> list[tuple[int, str | None]]:
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.randint(1, 60))] for _ in range(40)]
    hot = [rng.choice(vocabulary) for _ in range(30)]
    docs: list[tuple[int, str | None]] = []
    for i in range(count):
        words = list(rng.choice(bases[:12] if i % 3 else bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        text: str | None = " ".join(hot + words if i % 9 == 0 else words)
        if i % 5 == 0:
            text = text.upper()
        if i % 50 == 0:
            text = ["", None, "a b", " \n "][i // 50 % 4]
        docs.append((i * 3, text))
    return docs
