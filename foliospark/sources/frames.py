"""Rows into frames of bounded size, for functions that map partitions."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd

#: Rows, and units of size (bytes or characters), after which a frame is handed on.
MOST_ROWS, MOST_SIZE = 512, 32 << 20


def in_frames(rows: Iterable[dict], columns: Sequence[str], size: Callable[[dict], int]) -> Iterator[pd.DataFrame]:
    """Frames of the rows in order; one large row is a frame of its own."""
    held: list[dict] = []
    total = 0
    for row in rows:
        held.append(row)
        total += size(row)
        if len(held) >= MOST_ROWS or total >= MOST_SIZE:
            yield pd.DataFrame(held, columns=list(columns))
            held, total = [], 0
    if held:
        yield pd.DataFrame(held, columns=list(columns))
