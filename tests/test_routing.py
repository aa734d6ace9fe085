import pytest

from paddock.operators.routing import route

CASES = [
    ("How is PG-1004 doing?", "group_summary", "PG-1004", None, None, None),
    ("Where should PG-1004 ship", "packer_for_group", "PG-1004", None, None, None),
    ("prrs at pg-1019 or pg-1003", "disease_context", "PG-1003", None, None, None),
    ("add 30% hedge to PG-1001", "scenario_add_hedge", "PG-1001", None, None, 30.0),
    ("add hedge to PG-1001 now", "scenario_add_hedge", "PG-1001", None, None, 20.0),
    ("add hedge 150 or 40 to PG-1001", "scenario_add_hedge", "PG-1001", None, None, 40.0),
    ("pg-1020 summary", "group_summary", "PG-1020", None, None, None),
    ("What should I do", "action_recommendation", None, None, None, None),
    ("what if corn goes to $6", "scenario_feed", None, None, 600.0, None),
    ("what if corn goes to 650 cents", "scenario_feed", None, None, 650.0, None),
    ("what if feed gets dear", "scenario_feed", None, None, 500.0, None),
    ("what if hogs drop $10", "scenario_price", None, -10.0, None, None),
    ("what if hogs drop $10?", "scenario_price", None, -5.0, None, None),
    ("what if hogs drop 3 or 7", "scenario_price", None, -7.0, None, None),
    ("what if hogs drop -8", "scenario_price", None, -8.0, None, None),
    ("scenario: hogs rally 12.5", "scenario_price", None, 12.5, None, None),
    ("scenario: hogs rally 5d", "scenario_price", None, 5.0, None, None),
    ("what happens tomorrow", "weekly_summary", None, None, None, None),
    ("which packer pays best", "best_packer", None, None, None, None),
    ("LRP or puts", "hedge_comparison", None, None, None, None),
    ("water use in the barn", "barn_alerts", None, None, None, None),
    ("feed cost today", "feed_cost", None, None, None, None),
    ("futures basis", "market_context", None, None, None, None),
    ("worst groups", "losing_groups", None, None, None, None),
    ("unprotected head", "unhedged_exposure", None, None, None, None),
    ("ped in the area", "disease_context", None, None, None, None),
    ("  OVERVIEW  ", "weekly_summary", None, None, None, None),
    ("", "weekly_summary", None, None, None, None),
]


@pytest.fixture(scope="module")
def routed(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "id int, text string")
    return {r["id"]: r for r in route(df).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_route(routed, i):
    text, intent, group, delta, corn, pct = CASES[i]
    got = routed[i]
    assert (got["intent"], got["group_id"], got["delta"], got["corn_cents"], got["pct"]) == (intent, group, delta, corn, pct), text
