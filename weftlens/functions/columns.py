"""Names of columns that operators add, and values bound once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def set_aside(df: DataFrame, added: list[str]) -> tuple[DataFrame, Callable[[str], str]]:
    """``df`` with columns that clash with ``added`` (letter case ignored) renamed by trailing ``_in``, and the new name of each old one."""
    taken = {a.lower() for a in added}
    have = {c.lower() for c in df.columns}
    renamed = {}
    for column in df.columns:
        if column.lower() in taken:
            new = column + "_in"
            while new.lower() in have | taken:
                new += "_in"
            have.add(new.lower())
            renamed[column] = new
    by_lower = {c.lower(): n for c, n in renamed.items()}
    return df.withColumnsRenamed(renamed), lambda c: by_lower.get(c.lower(), c)


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once: a mere expression is computed again at each place, in a lambda for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
