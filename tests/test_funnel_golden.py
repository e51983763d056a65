"""Rates, drop-offs and flags of hand-made totals: every branch of every formula."""

from decimal import Decimal

from subsight.operators.funnel import TOTALS, rates_and_flags

# totals: signups, trials, activated, paid, churned -> the eight percentages in order, and the flag
CASES = [
    ((160, 23, 23, 10, 1), "14.38 85.62 100.00 0.00 43.48 56.52 10.00 90.00", "consistent"),
    ((3, 2, 1, 1, 1), "66.67 33.33 50.00 50.00 100.00 0.00 100.00 0.00", "consistent"),
    ((10, 4, 2, 5, 0), "40.00 60.00 50.00 50.00 100.00 0.00 0.00 100.00", "paid > activated, paid > trials"),
    ((10, 4, 2, 3, 0), "40.00 60.00 50.00 50.00 100.00 0.00 0.00 100.00", "paid > activated"),
    ((10, 4, 6, 5, 7), "40.00 60.00 100.00 0.00 83.33 16.67 100.00 0.00", "paid > trials, churned > paid"),
    ((0, 0, 0, 0, 0), "0.00 0.00 0.00 0.00 0.00 0.00 0.00 0.00", "consistent"),
    ((0, 1, 1, 1, 0), "0.00 0.00 100.00 0.00 100.00 0.00 0.00 100.00", "no signups but later stages"),
    ((5, 0, 0, 2, 3), "0.00 100.00 0.00 0.00 0.00 0.00 100.00 0.00", "paid > activated, paid > trials, churned > paid"),
    ((800, 1, 1, 1, 0), "0.13 99.87 100.00 0.00 100.00 0.00 0.00 100.00", "consistent"),
]
RATES = [
    "signup_to_trial_pct", "signup_dropoff_pct", "trial_to_activated_pct", "trial_dropoff_pct",
    "activated_to_paid_pct", "activated_dropoff_pct", "paid_to_churn_pct", "paid_retention_pct",
]


def test_rates_and_flags(spark):
    rows = [(f"2023-01-0{k}", "s", "c", "a", *totals) for k, (totals, _, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "month_start string, segment string, country string, source string, " + ", ".join(f"{t} long" for t in TOTALS))
    got = {r["month_start"]: r for r in rates_and_flags(df).collect()}
    for k, (_, rates, flag) in enumerate(CASES):
        r = got[f"2023-01-0{k}"]
        assert [r[c] for c in RATES] == [Decimal(x) for x in rates.split()], (k, r)
        assert r["data_flag"] == flag
