"""How many texts of a corpus use each character; the basis of the plausibility costs."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_rows

#: Most bits a single character can cost.
WORST = 14.0


def character_costs(df: DataFrame, column: str) -> dict[str, float]:
    """Bits of surprise of each character: minus the binary logarithm of the share of texts with it.

    All texts count. Only the table of characters reaches the driver: at most one row for each
    code point of Unicode, whatever the corpus. Key '' holds the cost of a character that no
    text has. An empty corpus gives an empty table.
    """

    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        seen: Counter = Counter()
        texts = 0
        for (text,) in rows:
            if text:
                texts += 1
                seen.update(set(text))
        yield -1, texts
        for char, n in seen.items():
            yield ord(char), n

    counted = map_rows(df.select(column), run, "point int, n bigint").groupBy("point").agg(F.sum("n").alias("n")).collect()
    table = {row["point"]: row["n"] for row in counted}
    total = table.pop(-1, 0)
    costs = {chr(p): min(WORST, max(0.1, math.log2((total + 1) / (n + 0.5)))) for p, n in table.items() if p >= 0}
    return costs | {"": min(WORST, math.log2((total + 1) / 0.5))} if costs else {}
