"""Documents that every corpus operator is tried on: nulls, empty and long texts, ties, repeated rows, extra columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, n_words string, score string, id string, label string, key string, n string, a string"


def odd_documents() -> list[tuple]:
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base, long = prose(120), prose(3000)
    texts = [base, base, base.replace("w1 ", "W1\t", 1), base + " tail", None, "", " \n\t ", "one", "one", "a b", long, long + " end", "x" * 20_000, "Ünïcode ß 語 text\x00with\x1codd\x85bytes here"]
    texts += [prose(60) + " " + base[:300] for _ in range(3)] + [" ".join(["die"] * 90), "line one\nline one\n\nline two\r\nline one"]
    words = base.split()
    for i in range(12):  # a star of near copies
        w = list(words)
        for j in rng.sample(range(120), 1 + i % 6):
            w[j] = f"v{i}{j}"
        texts.append(" ".join(w))
    rows = [(i, t, "en" if i % 2 else None, f"src{i % 3}" if i % 5 else None, None if t is None else len(t), "x", "x", "x", "x", "x", "x", "x", "x") for i, t in enumerate(texts)]
    return [*rows, rows[0], (None, base, None, None, None, *["x"] * 8)]
