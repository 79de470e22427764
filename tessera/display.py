"""Results as text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from .types import show


def render(columns: Sequence[str], rows: Sequence[Sequence[object]]) -> str:
    """A boxed table; cells may have several lines."""
    cells = [[show(v).split("\n") for v in r] for r in rows]
    heads = [[c] for c in columns]
    width = [max(len(x) for r in [heads, *cells] for x in r[k]) for k in range(len(columns))]
    rule = "+" + "+".join("-" * (w + 2) for w in width) + "+"

    def lines(row: list[list[str]]) -> list[str]:
        high = max(map(len, row), default=1)
        return ["|" + "|".join(f" {(c[i] if i < len(c) else '').ljust(w)} " for c, w in zip(row, width, strict=True)) + "|" for i in range(high)]

    return "\n".join([rule, *lines(heads), rule, *(x for r in cells for x in lines(r)), *([rule] if rows else [])])


def render_frame(df: DataFrame, limit: int = 1000) -> str:
    """The first rows of a result, for a terminal."""
    rows = df.limit(limit).collect()
    return render(df.columns, [tuple(r) for r in rows])
