"""When inference adds and removes rows, how many passes a table gets, and when kinds and hyperparameters are redrawn."""

from __future__ import annotations

import math
from collections.abc import Iterator

#: Rows that are added before the first one is removed are those that two rows' passes pay for.
FIRST_ROWS = 2


def extra_passes(rows: int, full: float = 500.0, small: float = 4e3, big: float = 1e9) -> float:
    """Passes beyond the first: `full` up to `small` rows, falling as a power of the size, 0 from `big` rows on."""
    if rows <= small:
        return full
    if rows >= big:
        return 0.0
    passes = (1 + full) ** (math.log(big / rows) / math.log(big / small))
    return passes - 1 if passes > 2 else 0.0


def removals_before(added: int, extra: float) -> int:
    """Removals that come before the next row is added, when `added` rows were: removals to additions are as extra to 1 + extra."""
    return max(0, math.ceil(added * extra / (1 + extra) - FIRST_ROWS - 1e-9))


def actions(rows: int, extra: float, grain: float = 0.0) -> Iterator[tuple[str, int, int]]:
    """What a chain over `rows` rows does, until all of them are in: ("add" | "remove", first, last) and ("redraw", 0, 0).

    Rows are taken in an endless round, added at its head and removed at its tail, so that each is seen 1 + extra times
    on average. One step moves as many rows as `grain` times those that are in, at least one: with grain 0 they go one by one. Kinds and
    hyperparameters are redrawn once all rows are fresh, that is, once those that were in at the last redrawing were removed, at steps
    8, 16, 32, ... and at the end. Without extra passes, rows are only added, and nothing is redrawn.
    """
    head = tail = fresh_from = steps = 0
    while head - tail < rows:
        size = min(max(1, int(grain * (head - tail))), rows - (head - tail))
        leave = removals_before(head + size - 1, extra)
        due = False
        if leave > tail:
            yield "remove", tail, leave
            steps += leave - tail
            tail = leave
            if tail >= fresh_from and head > fresh_from:
                due, fresh_from = True, head
        yield "add", head, head + size
        if extra > 0 and (due or (steps + size).bit_length() > max(steps, 7).bit_length()):
            yield "redraw", 0, 0
        head, steps = head + size, steps + size
    if rows and extra > 0:
        yield "redraw", 0, 0
