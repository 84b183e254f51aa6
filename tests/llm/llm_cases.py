"""Texts that hold every awkward case."""

from __future__ import annotations

import random

WORDS = ["alpha", "beta", "gamma", "delta", "omega", "kappa", "sigma", "tau", "rho", "phi", "the", "of", "Ünï", "日本"]


def invent(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def awkward_texts() -> list[tuple[int | None, str | None]]:
    """Nulls, empty and blank texts, repeated rows, copies, near copies, one very long text."""
    base = invent(1, 80)
    words = base.split()
    near = " ".join(["changed", *words[1:]])
    long = invent(2, 6000)
    rows: list[tuple[int | None, str | None]] = [
        (1, base), (2, base), (3, base.replace(" ", "  \t")), (4, near), (5, base.upper()),
        (6, ""), (7, None), (8, "   \n "), (9, "one"), (10, "one"), (11, "one two"),
        (12, long), (13, long + " tail"), (14, "x" * 30_000), (15, invent(3, 60)), (15, invent(3, 60)),
        (None, invent(4, 30)), (None, None), (16, "▁▁ mark ＡＢ 😀 \x00 <s>"), (17, "a" * 250), (18, invent(5, 300)),
    ]
    return rows
