"""Hedge, margin and feed formulas as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paddock.functions.numeric import flag

# Instrument names, weights and unit factors.
FUTURES = "Lean Hog Futures"
PROTECTED = ["Lean Hog Put Option", "LRP Policy"]
CWT_PER_HEAD = 2.10
LBS_PER_TON = 2000
LBS_PER_CORN_BUSHEL = 56
CORN_SHARE = 0.75
MEAL_SHARE = 0.20
FEED_LBS_PER_HEAD = 800
NON_FEED_COST_PER_HEAD = 72.00
FEED_COST_PER_HEAD_WITHOUT_DATA = 73.57
HEAD_PER_CONTRACT = 400

# Margin bands, highest first, as (lower bound, key, label).
MARGIN_BANDS = [
    (30, "strong", "✅ Strong"),
    (15, "on_track", "✅ On track"),
    (5, "watch", "🟡 Watch"),
    (0, "tight", "🟡 Tight"),
]
LOWEST_BAND = ("at_risk", "🔴 At risk")
UNKNOWN_BAND = ("unknown", "⚪ N/A")
THIN_COVERAGE_MARK = " ⚠️"


def effective_floor(instrument: Column, price: Column, premium: Column) -> Column:
    """Price level a position secures: strike less premium for protected instruments."""
    return F.when(instrument.isin(PROTECTED), price - premium).otherwise(price)


def protected_payoff(price: Column, premium: Column, market: Column) -> Column:
    """Payoff of a bought floor. The premium lowers the floor and is paid once more,
    the rule of the source data; see ``blended_margin`` for the single deduction."""
    return F.greatest(F.lit(0.0), price - premium - market) - premium


def pnl_per_cwt(
    instrument: Column,
    price: Column,
    premium: Column,
    market: Column,
    other: float | None = 0.0,
) -> Column:
    """Gain per cwt of a position marked to a market price; ``other`` is the value for
    instruments of no known kind. Null without a market price."""
    by_kind = (
        F.when(instrument == FUTURES, price - market)
        .when(instrument.isin(PROTECTED), protected_payoff(price, premium, market))
        .otherwise(F.lit(other).cast("double"))
    )
    return F.when(market.isNotNull(), by_kind)


def scenario_pnl_per_cwt(instrument: Column, price: Column, premium: Column, market: Column) -> Column:
    """What-if gain: all that is not futures counts as protected, and a protected
    position without a market price still costs its premium."""
    return (
        F.when(flag(instrument == FUTURES), price - market)
        .when(market.isNull(), 0 - premium)
        .otherwise(protected_payoff(price, premium, market))
    )


def blended_margin(
    instrument: Column,
    price: Column,
    premium: Column,
    coverage: Column,
    market: Column,
    cost_per_head: Column,
) -> Column:
    """Margin per head: covered share at the hedge, the rest at the market, less cost."""
    open_share = market * (1 - coverage)
    blend = (
        F.when(instrument == FUTURES, price * coverage + open_share)
        .when(instrument.isin(PROTECTED), (F.greatest(market, price) - premium) * coverage + open_share)
        .otherwise(market)
    )
    return F.when(market != 0, blend * CWT_PER_HEAD - cost_per_head)


def _banded(margin: Column, slot: int, suffix: Column | None = None) -> Column:
    def text(value: str) -> Column:
        return F.lit(value) if suffix is None else F.concat(F.lit(value), suffix)

    chain = F.when(margin.isNull(), F.lit(UNKNOWN_BAND[slot]))
    for band in MARGIN_BANDS:
        chain = chain.when(margin > band[0], text(band[slot + 1]))
    return chain.otherwise(text(LOWEST_BAND[slot]))


def margin_status(margin: Column) -> Column:
    """Band key of a margin, ``unknown`` for null."""
    return _banded(margin, 0)


def margin_label(margin: Column, coverage: Column, thin_below: float = 0.50) -> Column:
    """Band label of a margin, marked when the coverage is thin."""
    return _banded(margin, 1, F.when(flag(coverage < thin_below), THIN_COVERAGE_MARK).otherwise(""))


def corn_usd_ton(cents_per_bushel: Column) -> Column:
    return cents_per_bushel / 100 * (LBS_PER_TON / LBS_PER_CORN_BUSHEL)


def feed_usd_ton(corn_ton: Column, meal_ton: Column) -> Column:
    return F.lit(CORN_SHARE) * corn_ton + F.lit(MEAL_SHARE) * meal_ton


def feed_usd_head(usd_ton: Column) -> Column:
    return usd_ton * (FEED_LBS_PER_HEAD / LBS_PER_TON)


def per_head_to_cwt(per_head: Column) -> Column:
    return per_head / CWT_PER_HEAD
