"""Fee, expiry and status rules as column expressions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from permitlake.functions.literals import choose, day
from permitlake.schemas import MONEY

# Permit fees by business size and category; None is the rate of any other
# category, and MINIMUM_FEE that of any other size.
FEES = {
    "Small": {"Retail": 5000, "Services": 7500, None: 10000},
    "Medium": {"Retail": 15000, "Services": 20000, None: 25000},
    "Large": {"Manufacturing": 100000, None: 50000},
}
MINIMUM_FEE = 5000

# The flat fees by size of the yearly backfill; None is any other size.
BACKFILL_FEES = {"Small": 5000, "Medium": 15000, None: 50000}

SOON_DAYS = 30


def _money(amount: int) -> Column:
    return F.lit(amount).cast(MONEY)


def _rate(value: Column, rates: dict) -> Column:
    amounts = {name: _money(rate) for name, rate in rates.items()}
    rest = amounts.pop(None)
    return choose(value, amounts, rest)


def permit_fee(size: Column, category: Column) -> Column:
    by_size = {name: _rate(category, rates) for name, rates in FEES.items()}
    return choose(size, by_size, _money(MINIMUM_FEE))


def backfill_fee(size: Column) -> Column:
    return _rate(size, BACKFILL_FEES)


def is_expired(expiry: Column, as_of: dt.date) -> Column:
    """True before `as_of`, and also where there is no expiry date."""
    return F.coalesce(expiry < day(as_of), F.lit(True))


def expires_soon(expiry: Column, as_of: dt.date) -> Column:
    """From `as_of` up to, not including, thirty days later."""
    return (expiry >= day(as_of)) & (expiry < day(as_of + dt.timedelta(SOON_DAYS)))


def status_description(expiry: Column, as_of: dt.date) -> Column:
    """Label of an expiry date; a missing one counts as valid, unlike `is_expired`."""
    return (
        F.when(expiry < day(as_of), "Expired")
        .when(expiry < day(as_of + dt.timedelta(SOON_DAYS)), "Expiring Soon")
        .otherwise("Valid")
    )
