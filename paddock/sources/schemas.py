"""Declared schemas: producer tables, futures and the standard upload schemas."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

_TYPES = {"STRING": T.StringType(), "INT": T.IntegerType(), "DOUBLE": T.DoubleType()}


def struct(ddl: str) -> T.StructType:
    """StructType from DDL text such as ``Site STRING, Heads INT, Weight DOUBLE``, without a session."""
    fields = (column.strip().rsplit(" ", 1) for column in ddl.split(","))
    return T.StructType([T.StructField(n.strip("`"), _TYPES[t]) for n, t in fields])


# Columns of the producer files as they arrive; dates are texts.
PRODUCER_SCHEMAS = {
    "nursery": struct(
        "Pig_Group_ID STRING, Placement_Date STRING, Nursery_Site STRING, Nursery_Barn STRING, "
        "Pig_Source STRING, Production_Flow STRING, Expected_Head INT, Received_Head INT, "
        "Avg_Weight_In_lb DOUBLE, Age_Days INT, Health_Status STRING, Placement_Week INT, Notes STRING"
    ),
    "flow": struct(
        "Pig_Group_ID STRING, Movement_Date STRING, From_Site STRING, From_Barn STRING, To_Site STRING, "
        "To_Barn STRING, Event STRING, Head_Moved INT, Avg_Weight_lb DOUBLE, Notes STRING"
    ),
    "hedging": struct(
        "Pig_Group_ID STRING, Expected_Head_From_Nursery INT, Coverage_Percent DOUBLE, Head_Covered INT, "
        "Contracts INT, Instrument_Type STRING, Buy_Sell STRING, Trade_Date STRING, Expiration_Date STRING, "
        "Strike_or_Futures_Price_CWT DOUBLE, Option_or_LRP_Premium_CWT DOUBLE, Contract_Month STRING, "
        "Broker STRING, Notes STRING"
    ),
    "packer": struct(
        "Packer STRING, Plant STRING, Settlement_ID STRING, Scale_Ticket_ID STRING, Kill_Date STRING, "
        "Delivery_Date STRING, Producer STRING, Site STRING, Tattoo STRING, Load_ID STRING, "
        "Contract_Type STRING, Expected_Head INT, Delivered_Head INT, Paid_Head INT, "
        "Live_Weight_Total_lb DOUBLE, Avg_Live_Wt_lb DOUBLE, Avg_Carc_Wt_lb DOUBLE, Avg_Yield_pct DOUBLE, "
        "Base_Price_CWT DOUBLE, Matrix_Premium_CWT DOUBLE, VOB_CWT DOUBLE, Sort_Loss_CWT DOUBLE, "
        "Eval_Price_CWT DOUBLE, Carcass_Total_Weight_lb DOUBLE, Gross_Payment_$ DOUBLE, "
        "Freight_Carrier STRING, Freight_Amount_$ DOUBLE, Checkoff_$ DOUBLE, Yardage_$ DOUBLE, "
        "Other_Deductions_$ DOUBLE, Total_Deductions_$ DOUBLE, Net_Payment_$ DOUBLE, Payment_Date STRING"
    ),
    "accounting": struct(
        "Date STRING, Month STRING, Site STRING, Cost_Category STRING, Cost_Subcategory STRING, "
        "Description STRING, Quantity DOUBLE, Unit_Cost DOUBLE, Total_Cost DOUBLE, Vendor STRING, "
        "Production_Phase STRING, Pig_Group_ID STRING"
    ),
    "farrowing": struct(
        "Week_Start STRING, Sow_Farm STRING, Sows_Bred INT, Farrowings INT, Total_Born INT, Live_Born INT, "
        "PreWean_Mortality_Head INT, Weaned_Pigs INT, Avg_Wean_Weight_lb DOUBLE, Avg_Wean_Age_Days INT, "
        "Notes STRING"
    ),
    "barn_env": struct(
        "Date STRING, Site STRING, Barn STRING, Avg_Temperature_F DOUBLE, Avg_Humidity_pct DOUBLE, "
        "Water_Usage_Gallons DOUBLE, Power_Usage_kWh DOUBLE, Ventilation_Level_pct DOUBLE"
    ),
}

# Date columns of the producer files.
PRODUCER_DATES = {
    "nursery": ["placement_date"],
    "flow": ["movement_date"],
    "hedging": ["trade_date", "expiration_date"],
    "packer": ["kill_date", "delivery_date", "payment_date"],
    "accounting": ["date"],
    "farrowing": ["week_start"],
    "barn_env": ["date"],
}

FUTURES_SCHEMA = struct(
        "symbol STRING, time STRING, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume DOUBLE, "
        "open_interest DOUBLE"
    )
ENDPOINT_SCHEMA = struct(
        "Commodity STRING, month STRING, year STRING, tradingDay STRING, close DOUBLE, "
        "commodityMonth STRING, monthName STRING, weekofYear INT, week STRING, monthDay STRING, symbol STRING"
    )


# Date and number columns of the other input tables, by the names they have in snake case.
OTHER_TABLES: dict[str, tuple[list[str], list[str]]] = {
    "national": (["report_date"], ["wtd_avg"]),
    "western": (["report_date"], ["wtd_avg"]),
    "indexes": (["report_date"], ["amount"]),
    "weather": (["date"], ["outdoor_high_f", "outdoor_low_f", "peak_wind_gust_mph", "avg_wind_mph"]),
    "disease": ([], ["calendar_year", "calendar_month", "cumulative_incidence_pct"]),
    "lrp_quotes": (
        [],
        ["coverage_level_percent", "coverage_price", "per_head_premium", "producer_premium_amount", "subsidy_percent", "cme_premium", "endorsement_length", "grouping_date"],
    ),
    "lookup_cme": ([], ["strike", "previous"]),
    "feed_consumption": (["date"], ["day_in_finisher", "actual_feed_per_head_lb", "expected_feed_per_head_lb"]),
    "weekly_mortality": (["week_start"], ["week_number", "deaths", "cumulative_deaths", "start_head", "head_remaining", "weekly_mortality_pct"]),
    "treatment_logs": (["date"], ["head_treated"]),
    "feed_delivery": (["date", "delivery_date"], []),
    "employee_entry": (["date"], []),
}


@dataclass(frozen=True)
class FieldRule:
    """A column of a standard upload schema and the rules its values have to meet."""

    name: str
    type: str
    description: str
    required: bool = False
    minimum: float | None = None
    maximum: float | None = None
    values: tuple[str, ...] = ()
    pattern: str | None = None


def _r(name, type_, description, low=None, high=None, **more) -> FieldRule:
    return FieldRule(name, type_, description, minimum=low, maximum=high, **more)


# The standard upload schemas.
UPLOAD_SCHEMAS: dict[str, list[FieldRule]] = {
    "Nursery Intake": [
        _r("Pig_Group_ID", "string", "Group identifier", required=True, pattern=r"^[A-Z]{2,4}[-_]?\d+"),
        _r("Placement_Date", "date", "Date pigs arrived", required=True),
        _r("Nursery_Site", "string", "Nursery facility"),
        _r("Nursery_Barn", "string", "Barn within site"),
        _r("Expected_Head", "numeric", "Expected pig count", 0, 10000),
        _r("Received_Head", "numeric", "Actual pigs received", 0, 10000, required=True),
        _r("Avg_Weight_In_lb", "numeric", "Arrival weight lbs", 5, 50),
        _r("Health_Status", "category", "Negative/Monitored/Positive", values=("Negative", "Monitored", "Positive")),
    ],
    "Packer Settlement": [
        _r("Kill_Date", "date", "Processing date", required=True),
        _r("Packer", "string", "Packing company", required=True),
        _r("Plant", "string", "Plant location"),
        _r("Contract_Type", "category", "LEAN/NEGOTIATED/CARCASS", values=("LEAN", "NEGOTIATED", "CARCASS")),
        _r("Delivered_Head", "numeric", "Head delivered", 0, 5000, required=True),
        _r("Avg_Live_Wt_lb", "numeric", "Live weight", 200, 350),
        _r("Avg_Carc_Wt_lb", "numeric", "Carcass weight", 150, 280),
        _r("Base_Price_CWT", "numeric", "Base price $/cwt", 40, 150, required=True),
        _r("Matrix_Premium_CWT", "numeric", "Quality premium"),
        _r("Sort_Loss_CWT", "numeric", "Sort penalty"),
        _r("Net_Payment_$", "numeric", "Final payment"),
    ],
    "Accounting / Costs": [
        _r("Date", "date", "Expense date", required=True),
        _r(
            "Cost_Category", "category", "Feed/Health/Labor/etc.", required=True,
            values=("Feed", "Health", "Labor", "Facilities", "Transportation", "Overhead", "Animal"),
        ),
        _r("Cost_Subcategory", "string", "Specific cost type"),
        _r("Total_Cost", "numeric", "Dollar amount", 0, required=True),
        _r("Quantity", "numeric", "Units"),
        _r("Unit_Cost", "numeric", "Cost per unit"),
        _r("Vendor", "string", "Supplier"),
        _r("Site", "string", "Farm site"),
        _r(
            "Production_Phase", "category", "Breeding/Nursery/Finishing",
            values=("Breeding", "Nursery", "Finishing", "Gilt Development"),
        ),
        _r("Pig_Group_ID", "string", "Group identifier"),
    ],
    "Hedging Positions": [
        _r("Pig_Group_ID", "string", "Group this hedge covers", required=True),
        _r(
            "Instrument_Type", "category", "Futures/Put/LRP", required=True,
            values=("Lean Hog Futures", "Lean Hog Put Option", "LRP Policy"),
        ),
        _r("Trade_Date", "date", "When hedge was placed", required=True),
        _r("Expiration_Date", "date", "When it expires"),
        _r("Strike_or_Futures_Price_CWT", "numeric", "Price $/cwt", 40, 150, required=True),
        _r("Coverage_Percent", "numeric", "Fraction hedged", 0, 1),
        _r("Head_Covered", "numeric", "Head covered", 0, 10000),
        _r("Contract_Month", "string", "e.g., 25-Aug"),
    ],
    "Barn Environmental": [
        _r("Date", "date", "Reading date", required=True),
        _r("Site", "string", "Farm site", required=True),
        _r("Barn", "string", "Specific barn", required=True),
        _r("Avg_Temperature_F", "numeric", "Temperature °F", -20, 120),
        _r("Avg_Humidity_pct", "numeric", "Humidity %", 0, 100),
        _r("Water_Usage_Gallons", "numeric", "Water gal/day", 0),
        _r("Power_Usage_kWh", "numeric", "Electricity kWh", 0),
    ],
}
