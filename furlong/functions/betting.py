"""Column functions: odds as text, checks, bands, labels and settlement of a runner."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from furlong.functions.scalars import is_placed, place_odds, settle_each_way, settle_win


def fractional(price: Column, most: int = 100) -> Column:
    """Decimal odds as the best fraction of a denominator up to ``most``, in lowest terms; null unless above 1."""
    f = price - 1

    def better(best: Column, d: Column) -> Column:
        n = F.bround(f * d)
        error = F.abs(f - n / d)
        return F.when((n > 0) & (error < best["error"] - 1e-9), F.struct(n.alias("n"), d.cast("double").alias("d"), error.alias("error"))).otherwise(best)

    first = F.struct(F.bround(f).alias("n"), F.lit(1.0).alias("d"), F.abs(f - F.bround(f)).alias("error"))
    best = F.aggregate(F.sequence(F.lit(1), F.lit(most)), first, better)
    # the first denominator that is strictly better is in lowest terms already
    return F.when(price > 1, F.concat_ws("/", best["n"].cast("long").cast("string"), best["d"].cast("long").cast("string")))


_FRACTION = r"^(\d+(?:\.\d+)?)\s*[/\-]\s*(\d+(?:\.\d+)?)$"


def decimal_from(text: Column) -> Column:
    """Decimal odds of ``5/2``, ``5-2``, ``evens``, ``evs`` or ``even``; null for anything else and for a denominator of zero."""
    t = F.lower(F.trim(text))
    top, bottom = (F.regexp_extract(t, _FRACTION, k).try_cast("double") for k in (1, 2))
    return F.when(t.isin("evens", "evs", "even"), 2.0).otherwise(F.try_divide(top, bottom) + 1)


def valid_price(price: Column) -> Column:
    return F.coalesce((price > 1) & (price < float("inf")), F.lit(False))


def valid_probability(p: Column) -> Column:
    return F.coalesce((p > 0) & (p <= 1), F.lit(False))


def valid_terms(places: Column, fraction: Column) -> Column:
    return F.coalesce((places >= 1) & (fraction > 0) & (fraction < 1), F.lit(False))


def place_basis(places: Column, runners: Column, extra: Column) -> Column:
    return F.concat(F.lit("Place probability based on top "), places.cast("string"), F.when(runners > 0, F.concat(F.lit(" of "), runners.cast("string"), F.lit(" runners"))).otherwise(""), F.when(extra, " (extra places)").otherwise(""))


def settle_runner(position: Column, price: Column, places: Column, fraction: Column) -> dict[str, Column]:
    """Place outcome (null without terms) and profits of a unit stake (null without a price, each way also without terms)."""
    won = F.coalesce(position == 1, F.lit(False))
    placed = F.when(places.isNotNull(), is_placed(position, places))
    both = price.isNotNull() & placed.isNotNull()
    return {"place_outcome": placed, "pl_win": F.when(price.isNotNull(), settle_win(won, price)), "pl_each_way": F.when(both, settle_each_way(won, placed, price, fraction))}


def bands(value: Column, cuts: list[tuple[float, str]], last: str, closed: bool = False) -> Column:
    """The label of the first cut that the value is below (or, if ``closed``, not above), else ``last``; null for null."""
    out = None
    for cut, label in cuts:
        test = value <= cut if closed else value < cut
        out = F.when(test, label) if out is None else out.when(test, label)
    return F.when(value.isNotNull(), out.otherwise(last))


# Labels and cuts of the dashboard's bands.
ODDS_BANDS = ([(2, "<2 (evens or shorter)"), (4, "2-4"), (8, "4-8"), (16, "8-16")], "16+")
CONFIDENCE_BANDS = ([(0.33, "low (<33%)"), (0.5, "mid-low (33-50%)"), (0.66, "mid-high (50-66%)")], "high (66%+)")
EVIDENCE_BANDS = ([(0.2, "very low"), (0.4, "low"), (0.65, "moderate"), (0.85, "high")], "very high")
DISTANCE_BANDS = ([(8, "sprint (<8f)"), (12, "mile (8-12f)"), (20, "middle (12-20f)")], "staying (20f+)")
AGE_BANDS = ([(3, "2-3yo"), (5, "4-5yo"), (7, "6-7yo")], "8yo+")
FIELD_BANDS = ([(7, "small (≤7)"), (13, "medium (8-13)")], "large (14+)")


def odds_band(price: Column) -> Column:
    return bands(price, *ODDS_BANDS)


def confidence_band(confidence: Column) -> Column:
    return bands(confidence, *CONFIDENCE_BANDS)


def evidence_band(density: Column) -> Column:
    return bands(density, *EVIDENCE_BANDS)


def distance_label(furlongs: Column) -> Column:
    return bands(furlongs, *DISTANCE_BANDS)


def age_band(age: Column) -> Column:
    return bands(age, *AGE_BANDS, closed=True)


def field_band(n: Column) -> Column:
    return bands(n, *FIELD_BANDS, closed=True)


NONE = "—"


def percent(x: Column, digits: int = 1) -> Column:
    return F.coalesce(F.concat(F.format_string(f"%.{digits}f", F.round(x * 100, digits)), F.lit("%")), F.lit(NONE))


def signed_percent(x: Column, digits: int = 1) -> Column:
    return F.concat(F.when(x > 0, "+").otherwise(""), percent(x, digits))


def number(x: Column, digits: int = 2) -> Column:
    return F.when(x.isNotNull(), F.format_string(f"%.{digits}f", F.round(x, digits))).otherwise(NONE)


def date_text(t: Column) -> Column:
    return F.date_format(t, "dd MMM yyyy")


def distance_text(furlongs: Column) -> Column:
    """Miles and furlongs, as ``1m 2.5f``."""
    miles, rest = F.floor(furlongs / 8), furlongs % 8
    short = F.concat(F.when(rest == F.floor(rest), F.floor(rest).cast("string")).otherwise(F.format_string("%.1f", rest)), F.lit("f"))
    return F.when(furlongs.isNull(), NONE).when(miles == 0, short).when(rest > 0, F.concat(miles.cast("string"), F.lit("m "), short)).otherwise(F.concat(miles.cast("string"), F.lit("m")))


def form_string(positions: Column) -> Column:
    """Places of the latest runs, a dash for each run without one; a dash alone without runs."""
    shown = F.transform(positions, lambda p: F.coalesce(p.cast("string"), F.lit("-")))
    return F.when(F.size(positions) > 0, F.array_join(shown, "-")).otherwise("-")


def code_of(text: Column) -> Column:
    t = F.lower(F.coalesce(F.nullif(F.trim(text), F.lit("")), F.lit("flat")))
    return F.when(t.contains("jump") | t.isin("nh", "national hunt"), "JUMPS").otherwise("FLAT")


#: Role labels (fixed values).
ROLES = {"LEADER": "Leader", "PRONOUNCED_PACE": "Prominent", "MIDDIVISION": "Mid-division", "HOLD_UP": "Hold-up", "UNKNOWN": "Unknown"}
#: Words for the sexes of horses (fixed values).
SEXES = {"c": "COLT", "colt": "COLT", "f": "FILLY", "filly": "FILLY", "m": "MARE", "mare": "MARE", "g": "GELDING", "gelding": "GELDING", "h": "HORSE", "horse": "HORSE", "r": "RIG", "rig": "RIG"}


def looked_up(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def role_label(role: Column) -> Column:
    return F.coalesce(looked_up(ROLES, role), F.lit("Unknown"))


def sex_of(text: Column) -> Column:
    return looked_up(SEXES, F.lower(F.trim(text)))


def column_name(text: Column) -> Column:
    """Lower case, runs of anything but letters and digits as one underscore, none at either end."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def whole_number(text: Column) -> Column:
    """``7``, ``7.0`` and `` 7 `` are 7; the fraction is cut off; null for a blank or anything else."""
    return blank_to_null(text).try_cast("double").try_cast("long")


def real_number(text: Column) -> Column:
    return blank_to_null(text).try_cast("double")


def truth(text: Column) -> Column:
    """Whether a cell says yes: 1, true, yes or y in any case; null for a blank."""
    t = F.lower(blank_to_null(text))
    return t.isin("1", "true", "yes", "y")


def iso_time(text: Column) -> Column:
    """A date or time in ISO 8601; null for any other form, which is never guessed at."""
    t = blank_to_null(text)
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?(Z|[+-]\d{2}:?\d{2})?$"), F.try_to_timestamp(t))
