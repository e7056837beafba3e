"""The order of rows as a property of a frame: keys on columns that stay until nobody needs the order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F


@dataclass(frozen=True)
class Key:
    column: str  # internal name
    descending: bool = False
    missing_first: bool = False

    @property
    def by(self) -> Column:
        c = F.col(self.column)
        if self.descending:
            return c.desc_nulls_first() if self.missing_first else c.desc_nulls_last()
        return c.asc_nulls_first() if self.missing_first else c.asc_nulls_last()

    def flipped(self) -> Key:
        return Key(self.column, not self.descending, not self.missing_first)

    def upto(self, cut: Column) -> tuple[Column, Column]:
        """Whether a row's value stands before the cut's, and whether it stands with it."""
        c = F.col(self.column)
        nearer = F.coalesce((c > cut) if self.descending else (c < cut), F.lit(False))
        missing = (c.isNull() & cut.isNotNull()) if self.missing_first else (c.isNotNull() & cut.isNull())
        return nearer | missing, c.eqNullSafe(cut)


def one_way(keys: list[Key]) -> bool:
    return len({k.descending for k in keys}) <= 1


def packed(keys: list[Key]) -> Column:
    """One comparable value for keys of one direction: its lowest row is the first, or the last if they descend."""
    parts = []
    for k in keys:
        low_if_missing = k.missing_first != k.descending
        parts += [F.col(k.column).isNotNull() if low_if_missing else F.col(k.column).isNull(), F.col(k.column)]
    return F.struct(*(p.alias(f"k{i}") for i, p in enumerate(parts)))
