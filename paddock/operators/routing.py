"""Routing of question texts to an intent with parameters, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paddock.functions.text import contains_any, to_number

# whole ids: a longer or another id is never cut to one that is known
GROUP_PATTERN = r"\bpg-\d+\b"

# Words that settle the intent of a question naming a group, first hit wins.
GROUP_INTENTS = [
    ("packer_for_group", ["packer", "ship", "route", "where"]),
    ("disease_context", ["disease", "prrs", "ped", "health risk"]),
]
HEDGE_WORD = "hedge"
ADD_WORDS = ["add", "more", "increase"]
GROUP_DEFAULT = "group_summary"

# Words of advice, what-if and price move questions.
ADVICE_WORDS = ["what should", "recommend", "advice", "suggest", "what do i do"]
SCENARIO_WORDS = ["what if", "scenario", "what happens"]
FEED_WORDS = ["corn", "feed"]
FALL_WORDS = ["drop", "fall", "decline", "down"]
RISE_WORDS = ["rise", "rally", "up", "increase"]

# Words of the remaining intents, first hit wins.
TOPIC_INTENTS = [
    ("best_packer", ["packer", "ship", "which packer"]),
    ("hedge_comparison", ["lrp", "put option", "compare hedge", "insurance"]),
    ("barn_alerts", ["barn", "water", "temperature", "alert"]),
    ("feed_cost", ["feed cost", "corn price", "soybean"]),
    ("market_context", ["market", "futures", "price", "seasonal", "basis"]),
    ("losing_groups", ["losing", "loss", "worst", "risk", "underwater"]),
    ("unhedged_exposure", ["unhedged", "exposure", "unprotected"]),
    ("disease_context", ["disease", "prrs", "ped"]),
    ("weekly_summary", ["summary", "overview", "how are", "update"]),
]
TOPIC_DEFAULT = "weekly_summary"

# Defaults of the parameters.
DEFAULT_COVERAGE_PCT = 20.0
DEFAULT_CORN_CENTS = 500.0
DEFAULT_PRICE_MOVE = 5.0


def _last_number(text: Column, drop: str, value) -> Column:
    """Last blank-separated token that is a number ``value`` accepts; ``value`` maps the
    number to the parameter, or to null to refuse it. ``drop`` is stripped of the text."""
    tokens = F.split(F.trim(F.regexp_replace(text, drop, "")), r"(?U)\s+")
    numbers = F.array_compact(F.transform(tokens, lambda t: value(to_number(t))))
    return F.try_element_at(numbers, F.lit(-1))


def _within(low: float, high: float, factor: float = 1.0):
    return lambda n: F.when(n.between(low, high), n * factor)


def _corn_cents(number: Column) -> Column:
    return F.when(number.between(3, 8), number * 100).when(number.between(300, 800), number)


def group_id(text: Column, pattern: str = GROUP_PATTERN) -> Column:
    """Lowest group id the text names, in capitals, or null."""
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), 1)
    return F.upper(F.array_min(found))


def route(df: DataFrame, text: str = "text", group_pattern: str = GROUP_PATTERN) -> DataFrame:
    """Adds the intent of each question and its parameters (null where it has none).

    ``group_pattern`` matches the ids of groups in lower case."""
    q = F.lower(F.trim(F.col(text)))
    group = group_id(q, group_pattern)
    has_group = group.isNotNull()
    what_if = contains_any(q, SCENARIO_WORDS)
    falls, rises = contains_any(q, FALL_WORDS), contains_any(q, RISE_WORDS)

    intent = F.when(has_group & contains_any(q, GROUP_INTENTS[0][1]), GROUP_INTENTS[0][0])
    for name, words in GROUP_INTENTS[1:]:
        intent = intent.when(has_group & contains_any(q, words), name)
    intent = (
        intent.when(has_group & q.contains(HEDGE_WORD) & contains_any(q, ADD_WORDS), "scenario_add_hedge")
        .when(has_group, GROUP_DEFAULT)
        .when(contains_any(q, ADVICE_WORDS), "action_recommendation")
        .when(what_if & contains_any(q, FEED_WORDS), "scenario_feed")
        .when(what_if & (falls | rises), "scenario_price")
    )
    for name, words in TOPIC_INTENTS:
        intent = intent.when(contains_any(q, words), name)

    fall_by = F.coalesce(_last_number(q, r"[$\-]", _within(1, 30, -1.0)), F.lit(-DEFAULT_PRICE_MOVE))
    rise_by = F.coalesce(_last_number(q, r"[$]", _within(1, 30)), F.lit(DEFAULT_PRICE_MOVE))
    corn = F.coalesce(_last_number(q, r"[$]", _corn_cents), F.lit(DEFAULT_CORN_CENTS))
    pct = F.coalesce(_last_number(q, "%", _within(1, 100)), F.lit(DEFAULT_COVERAGE_PCT))
    return (
        df.withColumn("intent", intent.otherwise(TOPIC_DEFAULT))
        .withColumn("group_id", group)
        .withColumn("delta", F.when(F.col("intent") == "scenario_price", F.when(falls, fall_by).otherwise(rise_by)))
        .withColumn("corn_cents", F.when(F.col("intent") == "scenario_feed", corn))
        .withColumn("pct", F.when(F.col("intent") == "scenario_add_hedge", pct))
    )
