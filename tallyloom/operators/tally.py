"""Counts taken in the pass that makes a fact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation


class Tally:
    """What a fact leaves out and what it holds, observed while the fact is written: no second scan counts it.

    Rows are counted where `on` stands in the plan; put it where each row passes once, not on a table that a
    plan reads twice. `counts` is read after the action; a part of the plan that never ran has counts of zero.
    """

    def __init__(self) -> None:
        self._watched: list[tuple[Observation, list[str]]] = []

    def on(self, rows: DataFrame, **counts: Column) -> DataFrame:
        seen = Observation()
        self._watched.append((seen, list(counts)))
        return rows.observe(seen, *[c.alias(name) for name, c in counts.items()])

    def counts(self) -> dict[str, int]:
        found: dict[str, int] = {}
        for seen, names in self._watched:
            got = seen.get
            found |= {name: int(got.get(name) or 0) for name in names}
        return found


def watched(tally: Tally | None, rows: DataFrame, **counts: Column) -> DataFrame:
    return rows if tally is None else tally.on(rows, **counts)
