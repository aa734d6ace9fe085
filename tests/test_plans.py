from datetime import date

import pytest
from pyspark.sql import functions as F

from paddock.operators import aggregates, scenarios
from paddock.plans import build, cleanup, questions, views
from paddock.sources.readers import read_table


def d(text):
    return date.fromisoformat(text)


@pytest.fixture(scope="module")
def nursery(spark):
    return spark.createDataFrame(
        [
            ("PG-1017", d("2025-01-16"), "Nursery North", "N1", "External Wean Pig Supplier", 2285, 11.55, "Monitored", "note"),
            ("PG-1002", d("2025-01-24"), "Nursery South", "NS2", "External Wean Pig Supplier", 2274, 12.49, "Negative", "note"),
            ("PG-1000", d("2025-03-01"), "Nursery North", "N1", "Internal Sow Farm", 2248, 12.45, "Negative", "note"),
            ("PG-9999", d("2025-03-01"), "Nursery North", "N9", "Internal Sow Farm", 0, 12.0, "Positive", "note"),
        ],
        "pig_group_id string, placement_date date, nursery_site string, nursery_barn string, pig_source string, "
        "received_head int, avg_weight_in_lb double, health_status string, notes string",
    )


@pytest.fixture(scope="module")
def flow(spark):
    return spark.createDataFrame(
        [
            ("PG-1017", d("2025-01-16"), "Nursery North", "N1", "Placement", 2285, 11.55),
            ("PG-1017", d("2025-03-20"), "Finisher East", "F1", "Transfer", 2210, 50.0),
            ("PG-1017", d("2025-03-25"), "Finisher West", "FW2", "Transfer", 2208, 50.71),
            ("PG-1002", d("2025-03-23"), "Finisher West", "FW1", "Transfer", 2222, 54.21),
            ("PG-1000", d("2025-04-24"), "Finisher East", "F1", "Transfer", 2150, 52.01),
            ("PG-1000", d("2025-04-30"), None, None, "Transfer", 2149, 60.0),
        ],
        "pig_group_id string, movement_date date, to_site string, to_barn string, event string, head_moved int, avg_weight_lb double",
    )


@pytest.fixture(scope="module")
def hedging(spark):
    return spark.createDataFrame(
        [
            ("PG-1017", "Lean Hog Futures", d("2025-02-08"), 79.93, 0.0, "25-Jun", 0.86, 2000, "h"),
            ("PG-1002", "Lean Hog Put Option", d("2025-03-07"), 88.2, 4.09, "25-Jun", 0.53, 1200, "h"),
            ("PG-1000", "LRP Policy", d("2025-03-01"), 93.23, 3.14, "25-Sep", 0.4, 800, "h"),
        ],
        "pig_group_id string, instrument_type string, trade_date date, strike_or_futures_price_cwt double, "
        "option_or_lrp_premium_cwt double, contract_month string, coverage_percent double, head_covered int, notes string",
    )


@pytest.fixture(scope="module")
def endpoint(spark):
    return spark.createDataFrame(
        [
            ("HE", "HEM25", d("2025-02-07"), 104.275),
            ("HE", "HEM25", d("2025-02-10"), 104.0),
            ("HE", "HEM25", d("2025-06-02"), 100.0),
            ("HE", "HEV25", d("2025-03-06"), 80.0),
            ("ZC", "ZCH25", d("2025-06-02"), 448.0),
            ("ZC", "ZCK25", d("2025-06-02"), 460.0),
            ("ZC", "ZCH25", d("2025-06-20"), 400.0),
            ("ZM", "ZMH25", d("2025-06-05"), 300.0),
            ("LE", "HEM25", d("2025-07-01"), 1.0),
        ],
        "commodity string, symbol string, trading_day date, close double",
    )


@pytest.fixture(scope="module")
def life(nursery, flow, hedging):
    return build.lifecycle(nursery, flow, hedging)


def by_group(df):
    return {r["pig_group_id"]: r for r in df.collect()}


def test_lifecycle(life):
    got = by_group(life)
    a, b, c, none = (got[k] for k in ("PG-1017", "PG-1002", "PG-1000", "PG-9999"))
    assert (a["finisher_entry_date"], a["finisher_site"], a["finisher_barn"], a["head_to_finisher"]) == (d("2025-03-25"), "Finisher West", "FW2", 2208)
    assert (a["nursery_mortality"], a["nursery_mortality_pct"], a["days_in_nursery"], a["nursery_weight_gain_lb"]) == (77, 3.4, 68, 39.2)
    assert (a["est_market_date"], a["effective_floor_cwt"], a["unhedged_head"], a["unhedged_pct"]) == (d("2025-07-15"), 79.93, 208, 14.0)
    assert (b["nursery_mortality_pct"], b["days_in_nursery"], b["est_market_date"]) == (2.3, 58, d("2025-07-13"))
    assert b["effective_floor_cwt"] == pytest.approx(84.11)
    assert (c["finisher_entry_date"], c["head_to_finisher"]) == (d("2025-04-24"), 2150)
    assert none["finisher_site"] is None and none["nursery_mortality_pct"] is None and none["instrument_type"] is None


def test_open_heads_have_two_bases(nursery, hedging):
    got = by_group(build.nursery_hedging(nursery, hedging))
    assert got["PG-1017"]["unhedged_head"] == 285 and got["PG-1017"]["notes_hedge"] == "h"


def test_hand_over_day_counts_in_both_phases(spark, life):
    days = [("Nursery North", "N1", d("2025-01-15")), ("Nursery North", "N1", d("2025-01-16")), ("Nursery North", "N1", d("2025-03-25")),
            ("Finisher West", "FW2", d("2025-03-25")), ("Finisher West", "FW2", d("2025-07-15")), ("Finisher West", "FW2", d("2025-07-16"))]
    readings = spark.createDataFrame([(*x, 30.0 + 10 * i, 50.0, None) for i, x in enumerate(days)],
                                     "site string, barn string, date date, avg_temperature_f double, avg_humidity_pct double, water_usage_gallons double")
    got = by_group(build.lifecycle_with_env(life, readings))
    a, none = got["PG-1017"], got["PG-9999"]
    assert (a["nursery_env_days"], a["nursery_avg_temp_f"], a["nursery_temp_alerts"]) == (2, 45.0, 0)
    assert (a["finisher_env_days"], a["finisher_avg_temp_f"], a["finisher_avg_water"]) == (2, 65.0, None)
    assert (none["nursery_env_days"], none["finisher_env_days"], none["nursery_avg_temp_f"]) == (0, 0, None)
    assert len(got) == 4


def test_farrowing_supply(spark, nursery):
    weeks = [(d(w), f, 5881, 514, 5367, 13.0) for w in ("2025-02-14", "2025-02-15", "2025-02-24", "2025-03-01") for f in "ABC"]
    farrowing = spark.createDataFrame(weeks, "week_start date, sow_farm string, live_born int, pre_wean_mortality_head int, weaned_pigs int, avg_wean_weight_lb double")
    got = by_group(build.farrowing_supply(nursery, farrowing))
    assert set(got) == {"PG-1000", "PG-9999"}
    r = got["PG-1000"]
    assert (r["farrowing_weeks_matched"], r["total_weaned_in_window"], r["farms_in_window"]) == (3, 9 * 5367, "A, B, C")
    assert r["avg_prewean_mortality_pct"] == pytest.approx(514 / 5881 * 100)


def test_hedge_pnl_uses_the_last_close_of_the_contract(hedging, endpoint):
    got = by_group(build.hedge_pnl(hedging, endpoint))
    a, b, c = got["PG-1017"], got["PG-1002"], got["PG-1000"]
    assert (a["symbol"], a["current_market_cwt"], a["market_date"]) == ("HEM25", 100.0, d("2025-06-02"))
    assert a["pnl_per_cwt"] == pytest.approx(-20.07) and a["total_pnl"] == pytest.approx(-20.07 * 2.1 * 2000)
    assert b["pnl_per_cwt"] == pytest.approx(-4.09)
    assert (c["symbol"], c["pnl_per_cwt"]) == ("HEV25", pytest.approx(93.23 - 3.14 - 80 - 3.14))


def test_positions_without_a_contract_have_no_result(hedging, endpoint):
    got = by_group(build.hedge_pnl(hedging.withColumn("contract_month", F.lit("29-Dec")), endpoint))
    assert all(r["current_market_cwt"] is None and r["total_pnl"] is None for r in got.values())


def test_entry_price_is_the_nearest_close(hedging, endpoint):
    got = by_group(build.hedge_entry_price(hedging, endpoint))
    a = got["PG-1017"]
    assert (a["lookup_symbol"], a["market_close_at_trade"], a["actual_trade_day"], a["days_offset"]) == ("HEM25", 104.275, d("2025-02-07"), 1)
    assert (got["PG-1000"]["symbol_is_fallback"], got["PG-1000"]["days_offset"]) == (True, 5)
    assert got["PG-1002"]["market_close_at_trade"] is None


def test_hedge_against_packer_month(spark, hedging):
    packer = spark.createDataFrame([(d("2025-06-01"), 88.0, 87.0), (d("2025-06-30"), 90.0, 88.0), (d("2024-06-30"), 1.0, 1.0)],
                                   "kill_date date, eval_price_cwt double, base_price_cwt double")
    got = by_group(build.hedge_vs_packer(hedging, packer))
    a, c = got["PG-1017"], got["PG-1000"]
    assert (a["packer_avg_eval_cwt"], a["packer_avg_base_cwt"], a["has_packer_data"]) == (89.0, 87.5, True)
    assert a["proxy_hedge_pnl_cwt"] == pytest.approx(79.93 - 89)
    assert (c["packer_avg_eval_cwt"], c["proxy_hedge_pnl_cwt"], c["has_packer_data"]) == (None, None, False)


def test_packer_ranking_orders_ties_and_counts_non_null_ids(spark):
    rows = [("A", "LEAN", 1, 90.0, 10), ("A", "LEAN", None, 92.0, 10), ("B", "LEAN", 2, 91.0, 5), ("C", "CASH", 3, 80.0, 7), (None, "CASH", 4, 99.0, 7)]
    packer = spark.createDataFrame(rows, "packer string, contract_type string, settlement_id int, eval_price_cwt double, delivered_head int")
    packer = packer.withColumns({c: F.lit(1.0) for c in ("matrix_premium_cwt", "sort_loss_cwt", "vob_cwt")})
    got = [(r["rank"], r["packer"], r["loads"], r["total_head"], r["advantage_per_head"]) for r in build.packer_ranking(packer).orderBy("rank").collect()]
    assert got == [(1, "A", 1, 20, 23.1), (2, "B", 1, 5, 23.1), (3, "C", 1, 7, 0.0)]


def test_packer_basis(spark):
    packer = spark.createDataFrame([(1, d("2025-07-04"), 90.0, 1.0, -0.5, 2.0), (2, d("2025-12-25"), 90.0, 1.0, -0.5, 2.0)],
                                   "id int, kill_date date, base_price_cwt double, matrix_premium_cwt double, sort_loss_cwt double, vob_cwt double")
    cash = spark.createDataFrame([(d("2025-07-03"), 88.0), (d("2025-07-05"), 70.0)], "report_date date, wtd_avg double")
    index = build.cash_index(spark.createDataFrame([(d("2025-07-09"), "Prod. Sold Negotiated", 85.0), (d("2025-07-04"), "Packer Owned", 1.0)],
                                                   "report_date date, purchase_type string, amount double"))
    got = {r["id"]: r for r in build.packer_basis(packer, cash, index, cash).collect()}
    assert (got[1]["eval_check"], got[1]["national_cash_cwt"], got[1]["basis_vs_cme_index"], got[1]["basis_vs_western_cb"]) == (92.5, 88.0, 5.0, 2.0)
    assert got[2]["basis_vs_national"] is None and len(got) == 2


def test_feed_cost(endpoint):
    got = {r["date"]: r for r in build.feed_cost(endpoint).collect()}
    near, far = got[d("2025-06-02")], got[d("2025-06-20")]
    assert (near["corn_cents_bu"], near["sbm_usd_ton"]) == (448.0, 300.0)
    assert near["feed_cost_per_head"] == pytest.approx(72.0)
    assert far["sbm_usd_ton"] is None and far["feed_cost_per_head"] is None


def test_dashboard_and_season(spark, endpoint):
    cash = spark.createDataFrame([(d("2025-06-05"), 99.0)], "report_date date, wtd_avg double")
    index = spark.createDataFrame([(d("2025-06-30"), 95.0)], "report_date date, cme_index_value double")
    got = {r["date"]: r for r in build.hog_dashboard(endpoint, cash, index).collect()}
    assert (got[d("2025-06-02")]["national_cash"], got[d("2025-06-02")]["basis"], got[d("2025-06-02")]["cme_index"]) == (99.0, -1.0, None)
    season = {r["month"]: r for r in build.seasonal_avg(endpoint, with_std=True).collect()}
    assert set(season) == {2, 3, 6} and season[2]["max_price"] == 104.275 and season[6]["std_price"] is None


def test_option_premiums(spark, hedging):
    lookup = spark.createDataFrame([("CME LEAN HOGS", "202506", 88, 3.5), ("CME CATTLE", "202506", 88, 9.0)], "name string, grouping_date string, strike int, previous double")
    put = by_group(build.put_premiums(hedging, lookup))
    assert set(put) == {"PG-1002"} and put["PG-1002"]["premium_vs_market"] == pytest.approx(0.59)
    quotes = spark.createDataFrame(
        [(1, "CME LEAN HOGS", 202509, 92.0, 1.0), (2, "CME LEAN HOGS", 202509, 95.0, 2.0), (3, "CME LEAN HOGS", 202506, 93.23, 3.0)],
        "quote_id int, commodity string, grouping_date int, coverage_price double, per_head_premium double",
    ).withColumns({c: F.col("per_head_premium") for c in ("producer_premium_amount", "subsidy_percent", "cme_premium")})
    lrp = by_group(build.lrp_premiums(hedging, quotes))
    assert {k: r["lrp_market_premium_per_head"] for k, r in lrp.items()} == {"PG-1000": 1.0}


def test_cost_benchmarks_leave_null_keys_out(spark):
    rows = [("A", "Nursery", "Feed", d("2025-01-03"), 10.0), ("A", "Nursery", "Feed", d("2025-01-30"), 20.0), (None, "Nursery", "Feed", d("2025-01-30"), 5.0), ("A", "Nursery", "Labor", d("2025-02-01"), 90.0)]
    monthly, summary = build.cost_benchmarks(spark.createDataFrame(rows, "site string, production_phase string, cost_category string, date date, total_cost double"))
    assert sorted((r["month"], r["cost_category"], r["total_cost"]) for r in monthly.collect()) == [(d("2025-01-01"), "Feed", 30.0), (d("2025-02-01"), "Labor", 90.0)]
    assert [(r["cost_category"], r["total"], r["n_records"]) for r in summary.collect()] == [("Labor", 90.0, 1), ("Feed", 35.0, 3)]


def test_head_reconciliation(nursery, flow):
    got = by_group(cleanup.head_reconciliation(nursery, flow))
    assert {k: (r["difference"], round(r["difference_pct"], 1)) for k, r in got.items()} == {"PG-1017": (77, 3.4), "PG-1002": (52, 2.3), "PG-1000": (99, 4.4)}


@pytest.fixture(scope="module")
def tables(spark, life, hedging, endpoint):
    ranking = spark.createDataFrame([(1, "A", "LEAN", 92.0, 4.2), (2, "B", "CASH", 91.0, 2.1), (3, "C", "CASH", 90.5, 1.0), (4, "D", "CASH", 90.0, 0.0)],
                                    "rank int, packer string, contract_type string, avg_eval_cwt double, advantage_per_head double")
    disease = spark.createDataFrame([("PRRS", "2024-25", m, float(2 * m)) for m in range(1, 13)] + [("PED", "2024-25", 1, 9.0)],
                                    "disease string, season string, calendar_month int, cumulative_incidence_pct double")
    return {
        "lifecycle": life, "hedge_pnl": build.hedge_pnl(hedging, endpoint), "packer_ranking": ranking,
        "feed_cost": build.feed_cost(endpoint).where("feed_cost_per_head is not null"), "disease": disease,
        "hog_dashboard": spark.range(40).select(F.date_add(F.lit(d("2025-01-01")), F.col("id").cast("int")).alias("date")),
    }


def test_margins_and_attention(tables):
    got = by_group(build.margins(tables["lifecycle"], tables["hedge_pnl"], tables["feed_cost"]))
    a = got["PG-1017"]
    assert a["est_margin"] == pytest.approx((79.93 * 0.86 + 100 * 0.14) * 2.1 - 144, abs=0.006)
    assert (a["status_key"], got["PG-9999"]["status_key"]) == ("on_track" if a["est_margin"] <= 30 else "strong", "unknown")
    needs = {r["pig_group_id"] for r in views.needs_attention(build.margins(tables["lifecycle"], tables["hedge_pnl"], tables["feed_cost"])).collect()}
    assert {"PG-1017", "PG-1002", "PG-1000", "PG-9999"} >= needs >= {"PG-1002", "PG-1000", "PG-9999"}
    figures = views.operation_figures(build.margins(tables["lifecycle"], tables["hedge_pnl"], tables["feed_cost"])).first()
    assert (figures["groups"], figures["total_head"], figures["low_coverage"]) == (4, 2208 + 2222 + 2150, 2)


def test_questions(tables):
    ask = questions.answer
    assert [r["pig_group_id"] for r in ask(tables, "losing_groups").collect()] == ["PG-1017", "PG-1002"]
    assert ask(tables, "group_summary", group_id="PG-1002").count() == 1
    assert [r["rank"] for r in ask(tables, "best_packer").collect()] == [1, 2, 3, 4]
    choices = ask(tables, "packer_for_group", group_id="PG-1002").orderBy("rank").collect()
    assert [(r["packer"], round(r["savings"], 2)) for r in choices] == [("A", 9332.4), ("B", 4666.2), ("C", 2222.0)]
    assert ask(tables, "market_context").count() == 30
    assert [r["pig_group_id"] for r in ask(tables, "unhedged_exposure").collect()] == ["PG-1000", "PG-1002"]
    assert ask(tables, "disease_context").count() == 13
    risk = ask(tables, "disease_context", group_id="PG-1017").first()
    assert (risk["level_at_placement"], risk["delta"], risk["risk"]) == (2.0, 4.0, "HIGH")
    best = ask(tables, "action_recommendation").first()
    assert (best["pig_group_id"], best["packer"]) == ("PG-1000", "A")
    findings = {(r["finding"], r["subject"]) for r in ask(tables, "no such intent").collect()}
    assert findings >= {("strongest", "PG-1000"), ("weakest", "PG-1017"), ("low_coverage", "PG-1002"), ("low_coverage", "PG-1000"), ("best_packer", "A LEAN")}
    assert ask(tables, "scenario_feed", corn_cents=600).first()["scenario_corn_cents"] == 600.0
    assert ask(tables, "scenario_price", delta=-3).first()["delta_cwt"] == -3.0
    added = ask(tables, "scenario_add_hedge", group_id="PG-1002", pct=50).first()
    assert (added["new_coverage_pct"], added["new_head_covered"], added["current_market_cwt"]) == (100.0, 2222, 100.0)


def test_exposure(tables):
    got = aggregates.exposure(questions.unhedged_exposure(tables), "pig_group_id", "unhedged_head").first()
    assert (got["groups"], got["exposed"], got["most_exposed"]) == (2, 2372, "PG-1000")


def test_scenarios(spark, tables):
    moved = scenarios.price_change(tables["hedge_pnl"], [-30, 5])
    got = {(r["pig_group_id"], r["delta_cwt"]): r for r in moved.collect()}
    assert got["PG-1002", -30.0]["scenario_pnl_cwt"] == pytest.approx(88.2 - 4.09 - 70 - 4.09)
    assert got["PG-1017", 5.0]["scenario_pnl_cwt"] == pytest.approx(79.93 - 105)
    totals = {r["delta_cwt"]: r for r in aggregates.scenario_totals(moved, "total_pnl", "scenario_total_pnl", "scenario_pnl_head", ["delta_cwt"]).collect()}
    assert (totals[-30.0]["n_positive"], totals[5.0]["n_negative"], totals[5.0]["n"]) == (3, 2, 3)


def test_added_hedge_floors_contracts(spark):
    groups = spark.createDataFrame([("a", 0.5, 1000, 700), ("b", 0.95, 1000, 950)], "pig_group_id string, coverage_percent double, head_to_finisher int, head_covered int")
    got = {r["pig_group_id"]: r for r in scenarios.added_hedge(groups, [10]).collect()}
    assert (got["a"]["new_head_covered"], got["a"]["additional_head"], got["a"]["additional_contracts"]) == (600, -100, -1)
    assert (got["b"]["new_coverage_pct"], got["b"]["new_head_covered"], got["b"]["unhedged_after"]) == (100.0, 1000, 0)


def test_logs_and_charts(spark, tables, life):
    weeks = spark.createDataFrame([("PG-1017", 1, 10, 2285), ("PG-1017", 2, 11, 2285)], "pig_group_id string, week_number int, deaths int, start_head int")
    got = [(r["cumulative_deaths"], r["head_remaining"], r["weekly_mortality_pct"]) for r in views.weekly_deaths(weeks, "PG-1017").orderBy("week_number").collect()]
    assert got == [(10, 2275, 0.44), (21, 2264, 0.48)]
    assert views.total_deaths(weeks).first()["total_deaths"] == 21
    log = spark.createDataFrame([("Finisher West", d("2025-01-01"), i) for i in range(9)], "site string, delivery_date date, tons int")
    recent = views.recent_per_group(life, log, "finisher_site", "site", [F.desc("delivery_date"), F.desc("tons")], 5)
    assert sorted({(r["pig_group_id"], r["tons"]) for r in recent.collect()}) == [(g, t) for g in ("PG-1002", "PG-1017") for t in range(4, 9)]
    locked = views.locked_against_current(tables["lifecycle"], tables["hedge_pnl"]).collect()
    assert [r["pig_group_id"] for r in locked] == ["PG-1000", "PG-1002", "PG-1017"]
    full = views.overview(build.margins(tables["lifecycle"], tables["hedge_pnl"], tables["feed_cost"])).collect()
    assert len(full) == 4 and {r["coverage"] for r in full} == {"86%", "53%", "40%", None}


def test_quote_comparison(spark):
    quotes = spark.createDataFrame([("CME LEAN HOGS", 0.95, 90.0, 4.2, 3.0, 13), ("CME LEAN HOGS", 0.85, 90.0, 4.2, 3.0, 13), ("FDR CATTLE", 0.95, 90.0, 4.2, 3.0, 13)],
                                   "commodity string, coverage_level_percent double, coverage_price double, per_head_premium double, cme_premium double, endorsement_length int")
    assert [(r["lrp_cost_cwt"], r["savings"]) for r in views.quote_comparison(quotes).collect()] == [(2.0, 1.0)]


def test_build_all_names_and_writes_every_table(spark, tmp_path, nursery, flow, hedging, endpoint):
    env = spark.createDataFrame([], "site string, barn string, date date, avg_temperature_f double, avg_humidity_pct double, water_usage_gallons double")
    packer = spark.createDataFrame([("A", "LEAN", 1, d("2025-06-01"), 90.0, 1.0, 1.0, 1.0, 93.0, 5)],
                                   "packer string, contract_type string, settlement_id int, kill_date date, base_price_cwt double, matrix_premium_cwt double, sort_loss_cwt double, vob_cwt double, eval_price_cwt double, delivered_head int")
    cash = spark.createDataFrame([(d("2025-06-02"), 88.0)], "report_date date, wtd_avg double")
    indexes = spark.createDataFrame([(d("2025-06-02"), "Prod. Sold Negotiated", 85.0)], "report_date date, purchase_type string, amount double")
    producer = {"nursery": nursery, "flow": flow, "hedging": hedging, "barn_env": env, "packer": packer, "farrowing": nursery, "accounting": nursery}
    out = build.build_all(spark, producer, endpoint, cash, indexes, {"weather": cash, "disease": None})
    assert len(out) == 14 and "disease" not in out
    assert out["lifecycle"].count() == 4 and out["packer_basis"].first()["basis_vs_cme_index"] == 5.0
    entries = build.write_all({n: out[n] for n in ("hedge_pnl", "endpointlist")}, str(tmp_path))
    assert [(e["file"], e["rows"]) for e in entries] == [("hedge_pnl", 3), ("endpointlist", 9)]
    assert read_table(spark, "endpointlist", str(tmp_path)).where("commodity = 'ZC'").count() == 3


def test_quote_comparison_cuts_ties_alike_in_any_order(spark):
    rows = [("CME LEAN HOGS", 0.95, 60.0, 2.1 * cost, put, 13) for cost in (3.0, 1.0, 2.0) for put in (7.0, None, 5.0)] + [("CME LEAN HOGS", 0.95, None, 0.0, 0.0, 13)]
    names = "commodity string, coverage_level_percent double, coverage_price double, per_head_premium double, cme_premium double, endorsement_length bigint"
    for given in (rows, rows[::-1]):
        for parts in (1, 5):
            quotes = spark.createDataFrame(given, names).coalesce(1) if parts == 1 else spark.createDataFrame(given, names).repartition(parts)
            kept = [(r["lrp_cost_cwt"], r["cme_put_cost_cwt"]) for r in views.quote_comparison(quotes, 5).collect()]
            assert kept == [(1.0, 5.0), (1.0, 7.0), (1.0, None), (2.0, 5.0), (2.0, 7.0)]
