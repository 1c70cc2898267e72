"""Small type helpers shared by the expression modules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_money(c: Column | str) -> Column:
    """Money is held as decimal so that sums do not depend on the order of the rows."""
    return as_column(c).cast(MONEY)


def bool_to_int(c: Column | str) -> Column:
    return as_column(c).cast("int")
