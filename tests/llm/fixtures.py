"""Small frames with the awkward rows that every operator must take."""

from __future__ import annotations

import random

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(rng: random.Random, n: int, letters: str = "abcdefghijklmnop") -> list[str]:
    return ["".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n)]


def documents(spark, rows):
    """``rows``: (doc_id, text) pairs."""
    return spark.createDataFrame([(i, t, None, None, len(t) if t is not None else None) for i, t in rows], DOCS)


def awkward(seed: int = 1) -> list[tuple[int | None, str | None]]:
    """Nulls, empty texts, copies, near copies, repeated rows, a long text, shared passages, odd characters."""
    rng = random.Random(seed)
    base = [" ".join(words(rng, 120)) for _ in range(4)]
    near = base[0].split()
    near[60] = "changed"
    passage = "\n".join(" ".join(words(rng, 12)) for _ in range(6))
    rows: list[tuple[int | None, str | None]] = [(i, t) for i, t in enumerate(base)]
    rows += [
        (10, base[0]), (11, base[0]), (12, " ".join(near)), (13, None), (14, ""), (15, "   \n\t "), (16, "!!! 123 ..."),
        (17, "short"), (18, "a" * 700), (19, "ñandú ß 東京 " * 60), (20, base[1] + "\n" + passage),
        (21, passage + "\n" + base[2]), (22, "\n".join(words(rng, 30)) + "\n" + passage),
        (23, " ".join(words(rng, 20_000))), (None, base[3]), (None, None), (2, base[2]), (2, "other text of the same id"),
        (24, base[0].upper()), (25, "x\x00y \x1c z"),
    ]
    return rows
