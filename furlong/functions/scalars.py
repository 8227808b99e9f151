"""Column functions: rates, racing lookups, value and settlement."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How soft each going is (fixed values); any other going counts as 0.5.
SOFTNESS = {"Firm": 0.0, "Good to Firm": 0.2, "Standard": 0.3, "Good": 0.4, "Standard to Slow": 0.55, "Good to Soft": 0.6, "Slow": 0.7, "Soft": 0.85, "Heavy": 1.0}
WIN_PRIOR, PLACE_PRIOR, PRIOR_RUNS = 0.10, 0.30, 4


def hits(condition: Column) -> Column:
    """1 where the condition holds, 0 where it doesn't or is null."""
    return F.coalesce(condition.cast("long"), F.lit(0).cast("long"))


def rate(n: Column, of: Column) -> Column:
    """n / of, null where there is nothing to count."""
    return F.try_divide(n.cast("double"), of.cast("double"))


def smoothed_rate(n: Column, of: Column, prior: float, weight: float = PRIOR_RUNS) -> Column:
    return (n + F.lit(prior * weight)) / (of + F.lit(float(weight)))


def softness(going: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in SOFTNESS.items() for x in kv])
    return F.coalesce(F.try_element_at(known, going), F.lit(0.5))


def finishing_percentile(position: Column, field_size: Column) -> Column:
    """1 for the winner, 0 for the last; null for a field of one or without a position."""
    return F.when(field_size > 1, (field_size - position) / (field_size - 1))


def implied_probability(price: Column) -> Column:
    return F.when(price > 1, 1 / price)


def fair_odds(p: Column) -> Column:
    return F.when((p > 0) & (p <= 1), 1 / p)


def place_odds(price: Column, fraction: Column) -> Column:
    return 1 + (price - 1) * fraction


def is_placed(position: Column, places: Column) -> Column:
    return F.coalesce(position.between(1, places), F.lit(False))


def settle_win(won: Column, price: Column, stake: float = 1.0) -> Column:
    """Profit of a win bet."""
    return F.when(won, (price - 1) * stake).otherwise(-stake)


def settle_each_way(won: Column, placed: Column, price: Column, fraction: Column, stake: float = 1.0) -> Column:
    """Profit of a stake to win and one to be placed; a winner is placed, too."""
    place = F.when(won | placed, (place_odds(price, fraction) - 1) * stake).otherwise(-stake)
    return settle_win(won, price, stake) + place


def rounded(x: Column, digits: int = 9) -> Column:
    return F.round(x.cast("double"), digits)
