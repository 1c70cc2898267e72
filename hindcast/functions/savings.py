"""Expected savings of ceding a risk to a sharing pool."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hindcast.functions.types import as_column

# Fixed value: savings above which a risk is ceded.
CEDE_ABOVE = 100


def expected_savings(
    theoretical_loss: Column | str,
    charged_premium: Column | str,
    cession_percent: Column | str,
    expense_allowance: Column | str,
    annual_pool_cost: Column | str,
) -> Column:
    """Ceded share of (expected loss - premium net of allowance - pool cost), to whole units.

    Halves go to the even neighbour.
    """
    loss, premium, percent, allowance, pool = (
        as_column(c)
        for c in (
            theoretical_loss, charged_premium, cession_percent, expense_allowance, annual_pool_cost,
        )
    )
    return F.bround(percent * (loss - (1 - allowance) * premium - pool), 0)


def cede_decision(savings: Column | str, above: float = CEDE_ABOVE) -> Column:
    savings = as_column(savings)
    return F.when(savings > above, "Y").when(savings <= above, "N")
