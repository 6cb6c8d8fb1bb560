"""Similarity of two sequential patterns: how well itemsets pair up, and how far the pairs keep their order.

``similarity`` keeps the historical rules by default, with their oddities: it
isn't symmetric, a conflict that is resolved to the left adds the place of the
rival to the chosen one, and what can't be resolved counts as 0.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

Pattern = Sequence[Sequence[int]]


def dice(a: Column, b: Column) -> Column:
    """Twice the common items by all items of two itemsets."""
    both = F.size(a) + F.size(b)
    return F.when(both == 0, 0.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / both)


def _best(values: list[float]) -> tuple[float, int | None]:
    if not values:
        return 0.0, None
    top = max(values)
    return top, values.index(top)


def _pairing(w: list[list[float]], strict: bool) -> dict[int, int]:
    n, m = len(w), len(w[0])
    if n == 1:
        top, j = _best(w[0])
        return {0: j} if top else {}
    if m == 1:
        top, i = _best([row[0] for row in w])
        return {i: 0} if top else {}
    chosen: dict[int, int] = {}
    for i, row in enumerate(w):
        top, j = _best(row)
        if not top:
            continue
        rivals = [r for r, v in chosen.items() if v == j]
        if not rivals:
            chosen[i] = j
            continue
        r = rivals[-1]
        offset = j + 1 if strict else 0
        sides = []  # (score, who keeps j, who moves, whither); of equal scores the first
        for keeper, mover, part in ((r, i, 1.0), (i, r, 0.5)):
            for at, values, shift in ((0, w[mover][:j], offset), (j + 1, w[mover][j + 1 :], 0)):
                side, k = _best(values)
                if k is not None:
                    sides.append((part * (w[keeper][j] + side) / 2, keeper, mover, at + k + shift))
        if not sides:
            continue
        best = max(s[0] for s in sides)
        _, keeper, mover, to = next(s for s in sides if s[0] == best)
        chosen[keeper] = j
        chosen[mover] = to
    return chosen


def _longest_run(values: list[int]) -> int:
    """Length of the longest run that doesn't fall; the value at which one falls opens none."""
    runs, now, last = [], 0, 0
    for v in values:
        if v >= last:
            now, last = now + 1, v
        else:
            runs.append(now)
            now, last = 0, 0
    runs.append(now)
    best = max(runs)
    if not best:
        raise ValueError("no run")
    return best


def similarity(p: Pattern, q: Pattern, strict: bool = True) -> float:
    """At most 1, and 1 for equal patterns without repeated itemsets; may be negative. strict: with the historical offset."""
    try:
        w = [[2 * len(set(a) & set(b)) / (len(a) + len(b)) for b in q] for a in p]
        pairs = _pairing(w, strict)
        mean = sum(w[i][pairs[i]] for i in range(len(pairs))) / len(pairs)
        values = list(pairs.values())
        order = _longest_run(values) / len(q)
        places = [values.index(v) for v in values]
        moved = sum((values[i] - values[i - 1]) - (places[i] - places[i - 1]) for i in range(1, len(values))) / len(q)
        return min(1.0, mean * order * (1 - moved))
    except (IndexError, KeyError, ZeroDivisionError, ValueError):
        return 0.0


@F.pandas_udf(DoubleType())
def similarity_udf(p: pd.Series, q: pd.Series) -> pd.Series:
    return pd.Series([similarity([list(x) for x in a], [list(x) for x in b]) for a, b in zip(p, q)], dtype=float)


def distance(sim: Column) -> Column:
    return F.when(sim <= 0, 0.111).otherwise(1 - sim)


def plain_label(label: Column) -> Column:
    """A motif's label without kinds, and with single spaces between itemsets."""
    return F.regexp_replace(F.regexp_replace(label, "dep_|lemma_|pos_|feats_|form_", ""), r"\}.\{", "} {")
