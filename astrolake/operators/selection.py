"""Typed selections chained by AND, and box predicates."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from astrolake.functions.typed import parse

#: The names of the criteria.
IS, AT_LEAST, AT_MOST, BETWEEN = "is", "greater or equal to", "less or equal to", "is between"


@dataclass(frozen=True)
class Selection:
    """An immutable list of (column, criterion, value, value) that all must hold."""

    parts: tuple[tuple[str, str, str, str | None], ...] = ()

    def add(self, column: str, criterion: str, first, second=None) -> Selection:
        """One more part, unless it repeats the last one."""
        part = (column, criterion, str(first), None if second is None else str(second))
        return self if self.parts[-1:] == (part,) else Selection((*self.parts, part))

    def reset(self) -> Selection:
        return Selection()

    def condition(self, df: DataFrame) -> Column:
        """Values are parsed as the column's type.  Unknown columns are ignored; if none is known, nothing is selected."""
        kinds = {f.name: f.dataType for f in df.schema.fields}
        tests = []
        for name, criterion, first, second in self.parts:
            if name in kinds:
                c, low = F.col(f"`{name}`"), parse(first, kinds[name])
                tests.append({IS: lambda: c == low, AT_LEAST: lambda: c >= low, AT_MOST: lambda: c <= low, BETWEEN: lambda: (c >= low) & (c <= parse(second, kinds[name]))}[criterion]())
        return reduce(and_, tests) if tests else F.lit(False)

    def apply(self, df: DataFrame) -> DataFrame:
        return df.where(self.condition(df))


def load(df: DataFrame, shown: list[str], positions: list[str], selection: Selection | None = None) -> DataFrame:
    """Shown columns of the selected rows; positions and tested columns are read, not returned unless shown."""
    rows = df if selection is None else selection.apply(df)
    return rows.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*positions, *shown])])


def in_box(axes: list[Column], low: list[float], high: list[float], closed: bool = False) -> Column:
    """low <= p < high on every axis; ``closed``: low <= p <= high."""
    return reduce(and_, [(p >= float(a)) & ((p <= float(b)) if closed else (p < float(b))) for p, a, b in zip(axes, low, high, strict=True)])
