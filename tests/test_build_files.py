"""The whole build from files, with golden values worked out by hand."""

from datetime import date

import pytest

from paddock.plans import build
from paddock.sources.schemas import PRODUCER_SCHEMAS

FILES = {
    "nursery": ["PG-1,1/1/2025,N,B1,Internal Sow Farm,W,1000,1000,12,21,Negative,1,", "PG-2,1/5/2025,N,B2,Internal Sow Farm,W,900,880,12,21,Positive,1,late"],
    "flow": ["PG-1,3/1/2025,N,B1,Finisher E,F1,Transfer,960,50,", "PG-2,3/2/2025,N,B2,Finisher E,F2,Transfer,850,50,"],
    "hedging": [
        "PG-1,1000,0.5,500,1,Lean Hog Futures,SELL,1/2/2025,6/1/2025,90,0,25-Jun,B,",
        "PG-2,900,0.8,700,1,Lean Hog Put Option,BUY,1/2/2025,6/1/2025,88,2,25-Jun,B,",
    ],
    "packer": ["P1,X,S1,T,6/20/2025,6/19/2025,Me,N,t,L,LEAN,100,100,100,1,1,1,1,80,2,1,-1,82,1,1,c,1,1,1,1,1,1,6/25/2025"],
    "accounting": ["1/15/2025,Jan,N,Feed,Corn,d,10,2.5,25,V,Nursery,PG-1", "1/16/2025,Jan,N,Feed,Corn,d,10,2.5,26,V,Nursery,PG-1"],
    "farrowing": ["12/20/2024,A,10,9,100,95,5,90,13,20,", "12/27/2024,A,10,9,100,80,4,76,14,20,", "12/27/2024,B,10,9,100,60,6,54,12,20,"],
    "barn_env": ["1/2/2025,N,B1,39,60,100,1,1", "1/3/2025,N,B1,41,62,120,1,1", "3/1/2025,Finisher E,F1,60,50,300,1,1"],
}
OTHER = {
    "endpointlist": (
        "Commodity,month,year,tradingDay,close,commodityMonth,monthName,weekofYear,week,monthDay,symbol",
        ["HE,M,25,6/18/2025,95,,,,,,HEM25", "HE,N,25,6/18/2025,97,,,,,,HEN25", "ZC,N,25,6/18/2025,448,,,,,,ZCN25", "ZM,N,25,6/17/2025,300,,,,,,ZMN25", "ZM,N,25,6/19/2025,310,,,,,,ZMN25"],
    ),
    "national": ("report_date,wtd_avg", ["6/19/2025,84.5", "6/1/2025,70"]),
    "indexes": ("report_date,purchase_type,amount", ["6/21/2025,Prod. Sold Negotiated,83", "6/20/2025,Packer Owned,1"]),
    "weather": ("date,outdoor_high_f,station", ["1/2/2025,30.5,K1"]),
    "lookup_cme": ("Name,Grouping Date,Strike,Previous", ["CME LEAN HOGS,202506,88,2.5"]),
}


@pytest.fixture
def tables(spark, tmp_path):
    paths = {}
    for name, lines in FILES.items():
        OTHER_HEAD = ",".join(PRODUCER_SCHEMAS[name].fieldNames())
        (tmp_path / f"{name}.csv").write_text("\n".join([OTHER_HEAD, *lines]) + "\n")
        paths[name] = f"{tmp_path}/{name}.csv"
    for name, (head, lines) in OTHER.items():
        (tmp_path / f"{name}.csv").write_text("\n".join([head, *lines]) + "\n")
        paths[name] = f"{tmp_path}/{name}.csv"
    return build.build_from_files(spark, paths | {"disease": f"{tmp_path}/none.csv"})


def test_derived_tables(tables):
    assert "disease" not in tables and {"lifecycle", "hedge_pnl", "weather", "lookup_cme", "feed_cost"} <= set(tables)
    life = {r["pig_group_id"]: r for r in tables["lifecycle"].collect()}
    one, two = life["PG-1"], life["PG-2"]
    assert (one["finisher_barn"], one["head_to_finisher"], one["nursery_avg_temp_f"], one["nursery_temp_alerts"]) == ("F1", 960, 40.0, 1)
    assert one["nursery_env_days"] == 2 and one["finisher_env_days"] == 1 and two["nursery_env_days"] == 0
    pnl = {r["pig_group_id"]: r for r in tables["hedge_pnl"].collect()}
    assert (pnl["PG-1"]["symbol"], pnl["PG-1"]["current_market_cwt"], pnl["PG-1"]["pnl_per_cwt"]) == ("HEM25", 95.0, -5.0)
    assert pnl["PG-2"]["pnl_per_cwt"] == -2.0
    basis = tables["packer_basis"].first()
    assert (basis["eval_check"], basis["basis_vs_national"], basis["basis_vs_cme_index"]) == (82.0, -4.5, -3.0)
    feed = tables["feed_cost"].first()
    assert (feed["date"], feed["corn_cents_bu"], feed["sbm_usd_ton"]) == (date(2025, 6, 18), 448.0, 300.0)
    assert feed["corn_usd_ton"] == pytest.approx(160.0) and feed["feed_cost_usd_ton"] == pytest.approx(180.0) and feed["feed_cost_per_head"] == pytest.approx(72.0)
    board = tables["hog_dashboard"].first()
    assert (board["he_front_close"], board["national_cash"], board["basis"]) == (95.0, 84.5, -10.5)
    assert tables["weather"].first().asDict() == {"date": date(2025, 1, 2), "outdoor_high_f": 30.5, "station": "K1"}


def test_missing_required_files_are_named(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="nursery, flow"):
        build.read_inputs(spark, {})
