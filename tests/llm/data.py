"""Documents that hold the awkward cases, and what brute force says of them."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed: int = 1, n: int = 120) -> list[tuple]:
    rnd = random.Random(seed)
    words = ["".join(rnd.choice(["th", "er", "an", "in", "é", "ou", "st"]) for _ in range(rnd.randint(1, 4))) for _ in range(300)]
    say = lambda k: " ".join(rnd.choice(words) + rnd.choice(["", "", ",", "."]) for _ in range(k))
    passage = say(70)
    shared = "\n".join(say(9) for _ in range(4))
    rows = []
    for i in range(n):
        lines = [say(rnd.randint(3, 25)) for _ in range(rnd.randint(1, 9))]
        if i % 5 == 0:
            lines.insert(rnd.randint(0, len(lines)), passage)
        if i % 7 == 0:
            lines.insert(rnd.randint(0, len(lines)), shared)
        rows.append([i, "\n".join(lines), "en", f"src{i % 4}", 0])
    for i in range(n, n + 20):  # exact and near copies
        text = rows[i - n][1]
        if i % 2:
            parts = text.split(" ")
            parts[len(parts) // 2] = "changed"
            text = " ".join(parts)
        rows.append([i, text, "fr", "src0", 0])
    extra = ["", None, " \n\t", "one two", "one two", "a b c d e", "x" * 3000, "w " * 4000, "same line\n" * 30, "é è\x0bz\x1cq", "🙂 naïve ok"]
    rows += [[n + 20 + i, t, None if i % 2 else "de", None if i % 3 else "src1", None] for i, t in enumerate(extra)]
    return [tuple(r) for r in rows]


def frame(spark, rows=None, empty: bool = False):
    return spark.createDataFrame([] if empty else (rows or corpus()), DOCS)
