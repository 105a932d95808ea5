"""Between one row per series and one row per month."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def settle(df: DataFrame, names: list[str]) -> DataFrame:
    """Compute the named columns at this point of the plan, once.

    A filter on a derived column is normally pushed below the projection by repeating the whole
    expression. Passing the columns through a one-row generator stops that, at no shuffle.
    """
    others = [c for c in df.columns if c not in names]
    return df.select(*others, F.inline_outer(F.array(F.struct(*names))))


def unfold(df: DataFrame, keep: list, array: Column | str, marker: str = "month") -> DataFrame:
    """One row per element of an array of structs; empty arrays vanish.

    ``marker`` is an element field that is never NULL. The outer form avoids an inferred filter
    that would repeat the array's computation.
    """
    rows = F.expr(array) if isinstance(array, str) else array
    return df.select(*keep, F.inline_outer(rows)).where(F.col(marker).isNotNull())
