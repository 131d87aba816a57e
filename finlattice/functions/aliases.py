"""Labels against all aliases of metrics at once, by an automaton over each batch of distinct labels."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V

HITS = "array<struct<metric: string, alias_pos: int>>"


class Aliases:
    """which(label): place in the table of every alias that the label holds, or that holds the label. One per worker."""

    _made: Aliases | None = None

    def __init__(self, aliases: list[str]):
        import ahocorasick

        self.held_by: dict[str, list[int]] = {}
        for i, alias in enumerate(aliases):  # the mirror: labels inside an alias are its pieces
            for piece in {alias[a:b] for a in range(len(alias)) for b in range(a, len(alias) + 1)}:
                self.held_by.setdefault(piece, []).append(i)
        self.machine = ahocorasick.Automaton()
        places: dict[str, list[int]] = {}
        for i, alias in enumerate(aliases):
            places.setdefault(alias, []).append(i)
        for alias, at in places.items():
            self.machine.add_word(alias, at)
        self.machine.make_automaton()

    def which(self, label: str) -> list[int]:
        found = {i for _, at in self.machine.iter(label) for i in at}
        return sorted(found.union(self.held_by.get(label, ())))

    @classmethod
    def of_metrics(cls) -> Aliases:
        if cls._made is None:
            cls._made = cls([a for _, a, _ in TABLE])
        return cls._made


TABLE = [(m, a, i) for m, aliases in V.METRIC_ALIASES.items() for i, a in enumerate(aliases)]


def metrics_of(label: Column) -> Column:
    """metric and alias_pos of the first alias of each metric that a lower-case label holds or is held by; null: none."""
    return F.pandas_udf(_metrics, HITS)(label)


def _metrics(labels: pd.Series) -> pd.Series:
    known = Aliases.of_metrics()
    first = {x: {TABLE[i][0]: TABLE[i][2] for i in reversed(known.which(x))} for x in labels.dropna().unique()}
    hits = {x: [{"metric": m, "alias_pos": i} for m, i in at.items()] for x, at in first.items()}
    return labels.map(lambda x: hits.get(x, []) if x is not None else [])
