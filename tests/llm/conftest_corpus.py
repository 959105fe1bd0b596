"""A small random corpus with copies and near copies."""

import random


def corpus(n=60, seed=1, words=300):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 7))) for _ in range(words)]
    rows = []
    for i in range(n):
        kind = rng.random()
        if rows and kind < 0.2:
            text = rng.choice(rows)[1]
        elif rows and kind < 0.45:
            w = (rng.choice(rows)[1] or "x").split(" ")
            for _ in range(rng.randint(1, max(1, len(w) // 12))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            text = " ".join(w)
        else:
            text = "\n".join(" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 25))).capitalize() + "." for _ in range(rng.randint(1, 8)))
        rows.append((i * 3 % 1009, text, "en", f"src{min(4, int(rng.expovariate(1)))}", len(text)))
    return rows
