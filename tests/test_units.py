from datetime import datetime

import pytest
from conftest import frame_rows

from tonelake.operators.units import UnitReader, conversion_cases, to_common_units

G = "guidance_id long, metric_type string, value_low double, value_high double, unit string, raw_text string, quarter string, year int, low string, extracted_at timestamp"
RATES = [("EUR", "Q1", 2020, 1.1), ("JPY", "Q1", 2020, 0.007)]


def run(spark, rows, rates=RATES):
    g = spark.createDataFrame([(*r, "Q1", 2020, "clash", datetime(2020, 1, 1)) for r in rows], G)
    return to_common_units(g, spark.createDataFrame(rates, "currency string, quarter string, year int, usd_per_unit double"))


@pytest.mark.parametrize(
    ("metric", "low", "high", "unit", "text", "want"),
    [
        ("capex", 1.0, 2.0, "$", "Capital spending outlook in fiscal 2021: $74,850,000K", (74_850_000.0, 74_850_000.0, "USD|1000")),
        ("EPS", 306.0, None, "¢", "Management now sees GAAP EPS at 306 cents per share.", (306.0, 306.0, "CENT|1")),
        ("growth", None, None, None, "Organic growth of -2 per cent to -1.5 per cent in Q4 2020 versus 2.75% last year.", (-2.0, -1.5, "PCT|1")),
        ("growth", None, None, None, "we expect growth of 9.5-11 pct in Q4 2025.", (9.5, 11.0, "PCT|1")),
        ("revenue", None, None, None, "(in thousands) Total revenue outlook, FY2019: 357,000", (357_000.0, 357_000.0, "USD|1000")),
        ("revenue", None, None, None, "($000s) Net sales outlook, Q1 2022: 845,000 to 903,000", (845_000.0, 903_000.0, "USD|1000")),
        ("capex", None, None, None, "six hundred sixteen to six hundred twenty-three million dollars", (616.0, 623.0, "USD|1e+06")),
        ("revenue", None, None, None, "net sales between C$31.8 and C$33.7 million.", (31.8, 33.7, "CAD|1e+06")),
        ("revenue", None, None, None, "from $900 million to $1.1 billion", (0.9, 1.1, "USD|1e+09")),
        ("margin", 0.245, 0.255, "ratio", None, (0.245, 0.255, "RATIO|1")),
        ("other", 2012.6, 2045.5, "mm shares", None, (2012.6, 2045.5, "SHARE|1e+06")),
        ("revenue", 41.5, None, "JPYbn", None, (41.5, 41.5, "JPY|1e+09")),
        ("margin", 155.0, None, None, None, None),
        ("EPS", None, None, None, "Diluted EPS outlook in FY 23: a modest improvement, against $9.90 in the prior period", None),
        ("revenue", 5.0, None, "%", None, None),
    ],
)
def test_reader(metric, low, high, unit, text, want):
    assert UnitReader().read(metric, low, high, unit, text) == want


def test_rows(spark):
    rows = [
        (1, "EPS", 9.04, None, "USD per share", "EPS of $9.04 for FY2022."), (2, "EPS", 904.0, None, "cents", None), (3, "revenue", 1e6, 2e6, "EUR", None), (4, "margin", 12.5, 10.5, "%", None),
        (5, "capex", None, None, None, None), (6, None, None, None, None, ""), (7, "revenue", float("nan"), 3.0, "USD m", "  "), (7, "revenue", float("nan"), 3.0, "USD m", "  "), (8, "revenue", 5.0, None, "CHF m", None),
        (9, "other", 3.0, None, "k shares", "x" * 200_000),
    ]
    got = {r[0]: tuple(r)[1:] for r in run(spark, rows).collect()}
    assert len(got) == 9
    assert got[1] == ("USD/share", 90400, 90400, True) and got[2] == ("USD/share", 90400, 90400, False)
    assert got[3] == ("USD", 1_100_000, 2_200_000, False) and got[4] == ("%", 1050, 1250, True)
    assert got[5][0] is None and got[6][0] is None and got[8][0] is None
    assert got[7][:3] == ("USD", 3_000_000, 3_000_000) and got[9] == ("shares", 3000, 3000, False)


def test_cases_and_empty(spark):
    assert run(spark, []).count() == 0
    g = spark.createDataFrame([(1, "EPS", 5.0, None, "cents", None, "Q1", 2020, "x", None), (2, "EPS", 5.0, None, "$/share", None, "Q1", 2020, "x", None)], G)
    fx = spark.createDataFrame([], "currency string, quarter string, year int, usd_per_unit double")
    assert frame_rows(conversion_cases(g, fx)) == [(1, "USD/share", 500, 500)]
