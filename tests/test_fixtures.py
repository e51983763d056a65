"""Hand-made fixtures (a few rows each), one per trap and per rule that must survive."""

import datetime as dt
from decimal import Decimal

import pandas as pd
from pyspark.sql import functions as F

from conftest import rows
from subsight.functions import scalars as S
from subsight.operators import cleaning as C
from subsight.operators import funnel as N
from subsight.operators import metrics as M
from subsight.operators import quality as Q
from subsight.operators.calendar import active_subscription_months
from subsight.plans.workload import Workload
from subsight.sources import staging
from subsight.sources.schemas import STAGING

D = dt.date


def raw(spark, table, data):
    return spark.createDataFrame(data, STAGING[table])


CUSTOMERS = [
    ("C1", " 2023-01-05 ", "  SMB ", " UK ", " t "),
    ("C2", "", "", "", "0"),
    ("C3", "2023-02-30", "Enterprise", "US", "FALSE"),
    ("C4", "bad", None, None, "yes"),
    ("C4", "2023-03-01", "SMB", "DE", "True"),
]
SUBS = [
    ("S1", "C1", "2023-01-01", "", "10.00", "active"),
    ("S2", "C1", "2023-01-01", "", "10.00", "active"),  # same subscription, new id
    ("S3", "C1", "2023-02-01", "2023-01-15", "5", "canceled"),  # start after end
    ("S4", "C2", "2023-01-01", "2023-03-01", "abc", "active"),  # bad price, active with end
    ("S5", "C9", "2023-01-01", "", "-1.00", "trialing"),  # orphan, negative price
    ("S6", "C2", "2023-01-10", "", "0", "canceled"),  # canceled without end, zero price
    ("S7", "C2", "2023-01-10", "", "0", "canceled"),  # duplicate with NULL end date
]
EVENTS = [
    ("E1", "C1", "signup", "2023-01-05", "ads"),
    ("E2", "C1", "signup", "2023-01-05", "ads"),  # same event, second id
    ("E3", "C1", "signup", "2023-01-07", "organic"),  # second signup
    ("E4", "C1", "trial_start", "2023-01-01", "ads"),  # trial before signup
    ("E5", "C9", "activated", "2023-01-02", "ads"),  # orphan
    ("E6", "C2", None, "2023-01-03", "ads"),  # null type
]


def workload(spark):
    return Workload(
        {
            "customers": raw(spark, "customers", CUSTOMERS),
            "subscriptions": raw(spark, "subscriptions", SUBS),
            "events": raw(spark, "events", EVENTS),
        }
    )


def test_dirty_customers(spark):
    got = {(r.customer_id, r.signup_date): r for r in C.clean_customers(raw(spark, "customers", CUSTOMERS)).collect()}
    c1 = got[("C1", D(2023, 1, 5))]
    assert (c1.segment, c1.country, c1.is_enterprise) == ("SMB", "UK", 1)
    c2 = got[("C2", None)]
    assert (c2.segment, c2.country, c2.is_enterprise) == ("Unknown", "", 0)
    c3 = got[("C3", None)]  # 30 February does not parse
    assert c3.is_enterprise == 0
    c4 = got[("C4", None)]
    assert (c4.segment, c4.country, c4.is_enterprise) == ("Unknown", None, None)
    w = workload(spark)
    assert rows(Q.duplicate_key_counts(w.customers_clean0)) == [{"customer_id": "C4", "row_count": 2}]
    cons = {(r.table_name, r.column_name, r.rule): r.violations for r in Q.column_constraints(
        {"customers": w.customers_clean0}).collect()}
    assert cons[("customers", "is_enterprise", "not_null")] == 1


def test_dirty_subscriptions(spark):
    w = workload(spark)
    kept = sorted(r.subscription_id for r in w.subscriptions.collect())
    assert kept == ["S1", "S3", "S4", "S5", "S6"]
    ts = w.typed("subscriptions")
    ids = lambda df: sorted(r.subscription_id for r in df.collect())
    assert ids(Q.invalid_prices(ts)) == ["S5", "S6", "S7"]
    assert ids(Q.invalid_dates(ts)) == ["S3"]
    assert ids(Q.active_with_end(ts)) == ["S4"]
    assert ids(Q.canceled_without_end(ts)) == ["S6", "S7"]
    assert ids(Q.unknown_customer(ts, w.typed("customers"))) == ["S5"]
    assert sorted(r.subscription_id for r in Q.duplicate_rows(ts).collect()) == []
    assert [r.monthly_price for r in w.subscriptions.filter("subscription_id = 'S4'").collect()] == [None]


def test_dirty_events(spark):
    w = workload(spark)
    assert sorted(r.event_id for r in w.events.collect()) == ["E1", "E3", "E4", "E5", "E6"]
    te, tc = w.typed("events"), w.typed("customers")
    assert rows(Q.multiple_signups(te)) == [{"customer_id": "C1", "count": 3}]
    assert rows(Q.event_sequence(te)) == [{"customer_id": "C1", "issues": "trial_before_signup"}]
    before = sorted(r.event_id for r in Q.events_before_signup(te, tc).collect())
    assert before == ["E4"]
    assert sorted(r.event_id for r in Q.unknown_customer(te, tc).collect()) == ["E5"]
    # signup override: first signup event wins over the customer's own date
    c1 = w.customers.filter("customer_id = 'C1'").first()
    assert c1.signup_date == D(2023, 1, 5)
    src = {r.customer_id: r.source for r in w.dim.collect()}
    assert src["C1"] == "organic" and src["C2"] == "Unknown"  # largest signup source


def test_signup_mismatch_counts_missing_event(spark):
    w = workload(spark)
    got = rows(Q.signup_mismatch(w.typed("customers"), w.typed("events")))
    # C1 has three signup events: two match its date, one does not; C4 (dated) has none.
    assert [(r["customer_id"], r["event_signup_date"]) for r in got] == [
        ("C1", D(2023, 1, 7)),
        ("C4", None),
    ]


def test_month_edges(spark):
    lo, hi = D(2023, 1, 1), D(2023, 6, 1)
    data = [
        ("A", "c", D(2023, 1, 15), D(2023, 2, 28)),  # ends on a month's last day
        ("B", "c", D(2023, 1, 1), D(2023, 3, 1)),  # ends on a month's first day
        ("C", "c", D(2023, 1, 31), None),  # starts on a last day, open
        ("D", "c", D(2023, 2, 10), D(2023, 2, 10)),  # start = end
        ("E", "c", D(2022, 11, 1), None),  # starts before the spine
        ("F", "c", D(2023, 3, 5), D(2023, 4, 1)),
    ]
    schema = "subscription_id string, customer_id string, start_date date, end_date date"
    subs = spark.createDataFrame(data, schema).withColumn("monthly_price", F.lit(1).cast("decimal(10,2)")).withColumn(
        "status", F.lit("active")
    )
    got = sorted(
        (r.subscription_id, r.month_start)
        for r in active_subscription_months(subs, F.lit(lo), F.lit(hi)).collect()
    )
    months = pd.date_range(lo, hi, freq="MS").date
    want = []
    for sid, _, start, end in data:
        for m in months:
            m_end = (pd.Timestamp(m) + pd.offsets.MonthEnd(0)).date()
            if start <= m_end and (end is None or end > m_end):
                want.append((sid, m))
    assert got == sorted(want)


def test_lag_gap_and_rates(spark):
    cell = ("SMB", "UK", "ads")
    rev = spark.createDataFrame(
        [
            (D(2023, 1, 1), *cell, Decimal("100.00"), Decimal("1200.00"), 10),
            (D(2023, 3, 1), *cell, Decimal("0.00"), Decimal("0.00"), 2),
            (D(2023, 4, 1), *cell, Decimal("50.00"), Decimal("600.00"), 1),
        ],
        "month_start date, segment string, country string, source string, mrr decimal(22,2), "
        "arr decimal(22,2), active_customers bigint",
    )
    churn = spark.createDataFrame(
        [
            (D(2023, 1, 1), *cell, 3, Decimal("20.00")),
            (D(2023, 2, 1), *cell, 5, Decimal("99.00")),  # no revenue cell: dropped
            (D(2023, 3, 1), *cell, 12, Decimal("30.00")),
            (D(2023, 4, 1), *cell, 1, Decimal("10.00")),
        ],
        "month_start date, segment string, country string, source string, churned_logos bigint, "
        "lost_mrr decimal(22,2)",
    )
    got = {r.month_start: r for r in M.with_churn_rates(rev, churn).collect()}
    assert len(got) == 3
    assert got[D(2023, 1, 1)].logo_churn_rate_pct == Decimal("0.00")  # first row
    assert got[D(2023, 3, 1)].logo_churn_rate_pct == Decimal("120.00")  # previous row is January
    assert got[D(2023, 3, 1)].revenue_churn_rate_pct == Decimal("30.00")
    assert got[D(2023, 4, 1)].logo_churn_rate_pct == Decimal("50.00")
    assert got[D(2023, 4, 1)].revenue_churn_rate_pct == Decimal("0.00")  # previous MRR is 0
    assert got[D(2023, 1, 1)].arpc == Decimal("10.00")


def _brute_churn(events, subs):
    """The fan-out join of the workload, literally, then grouped per customer and month."""
    out = {}
    for cid in {e[0] for e in events} | {s[0] for s in subs}:
        ev = [e for e in events if e[0] == cid] or [None]
        sb = [s for s in subs if s[0] == cid] or [None]
        for e in ev:
            for s in sb:
                ed = e[1] if e else None
                sd = s[1] if s else None
                if ed is None and sd is None:
                    continue
                d = ed or sd
                m = D(d.year, d.month, 1)
                n, lost = out.get((cid, m), (0, None))
                p = s[2] if s else None
                lost = lost if p is None else (p if lost is None else lost + p)
                out[(cid, m)] = (n + 1, lost)
    return out


def test_churn_fanout_matches_pairs(spark):
    events = [
        ("C1", D(2023, 3, 10)), ("C1", D(2023, 4, 2)), ("C2", D(2023, 5, 1)),
        ("C4", None), ("C6", None), ("C6", D(2023, 8, 8)),
    ]
    subs = [
        ("C1", D(2023, 3, 31), Decimal("10.00")), ("C1", D(2023, 6, 15), Decimal("20.00")),
        ("C3", D(2023, 2, 1), Decimal("5.00")), ("C4", D(2023, 7, 1), Decimal("7.00")),
        ("C5", D(2023, 7, 1), None), ("C6", D(2023, 9, 1), Decimal("3.00")),
        ("C6", D(2023, 9, 20), Decimal("4.00")),
    ]
    ev = spark.createDataFrame(
        [(f"E{i}", c, "churned", d, "ads") for i, (c, d) in enumerate(events)],
        "event_id string, customer_id string, event_type string, event_date date, source string",
    )
    sb = spark.createDataFrame(
        [(f"S{i}", c, D(2023, 1, 1), d, p, "canceled") for i, (c, d, p) in enumerate(subs)],
        "subscription_id string, customer_id string, start_date date, end_date date, "
        "monthly_price decimal(10,2), status string",
    )
    got = {(r.customer_id, r.month_start): (r.fanout_rows, r.lost) for r in M.churn_by_customer_month(ev, sb).collect()}
    want = _brute_churn(events, subs)
    assert got == want


def test_funnel_edges(spark):
    dim = spark.createDataFrame(
        [
            ("C1", D(2023, 1, 5), "SMB", "UK", "ads", 0, 0, 0),  # paid without trial
            ("C2", D(2023, 1, 9), "SMB", "UK", "ads", 1, 0, 1),  # churned without paid
            ("C3", D(2023, 1, 9), "SMB", "UK", "ads", 0, 0, 0),  # canceled only
            ("C4", None, None, None, "Unknown", 0, 1, 0),  # null signup date, null segment
        ],
        "customer_id string, signup_date date, segment string, country string, source string, "
        "has_trial_start int, has_activated int, has_churned int",
    )
    subs = spark.createDataFrame(
        [("S1", "C1", D(2023, 2, 1), None, Decimal("1"), "active"),
         ("S3", "C3", D(2023, 2, 1), D(2023, 3, 1), Decimal("1"), "canceled")],
        "subscription_id string, customer_id string, start_date date, end_date date, "
        "monthly_price decimal(10,2), status string",
    )
    got = {(r.month_start, r.segment): r for r in N.funnel_counts(N.customer_funnel_base(dim, subs)).collect()}
    jan = got[(D(2023, 1, 1), "SMB")]
    assert (jan.total_signups, jan.total_trials, jan.total_paid, jan.total_churned) == (3, 1, 1, 0)
    none = got[(None, "Unknown")]
    assert (none.total_signups, none.total_activated) == (1, 1)


def test_flag_rules(spark):
    data = [
        ("a", 10, 8, 5, 6, 1, "paid > activated"),
        ("b", 10, 4, 6, 5, 1, "paid > trials"),
        ("c", 10, 8, 8, 2, 3, "churned > paid"),
        ("d", 0, 1, 1, 0, 0, "no signups but later stages"),
        ("e", 0, 1, 1, 2, 3, "paid > activated, paid > trials, churned > paid, no signups but later stages"),
        ("f", 10, 8, 6, 5, 1, "consistent"),
    ]
    df = spark.createDataFrame(data, "k string, s long, t long, a long, p long, c long, want string")
    got = df.select("want", S.funnel_flag(*[F.col(x) for x in "stapc"]).alias("got")).collect()
    for r in got:
        assert r.got == r.want


def test_rounding(spark):
    data = [(23, 160, "14.38"), (41, 160, "25.63"), (1, 32, "3.13"), (2, 3, "66.67"), (5, 0, "0.00"), (7, 5, "100.00")]
    df = spark.createDataFrame(data, "a long, b long, want string")
    out = df.select(
        "a", "b", "want",
        S.capped_pct(F.col("a"), F.col("b")).alias("pct"),
        S.dropoff_pct(F.col("a"), F.col("b")).alias("drop"),
        S.retention_pct(F.col("a"), F.col("b")).alias("ret"),
    ).collect()
    for r in out:
        assert r.pct == Decimal(r.want)
        if r.b == 0:
            assert r.drop == Decimal("0.00") and r.ret == Decimal("0.00")
        else:
            assert r.drop == Decimal(100) - r.pct and r.ret == max(Decimal(0), Decimal(100) - r.pct)


def test_null_keys(spark):
    cust = staging.typed(raw(spark, "customers", [(None, "", "", "", "1"), (None, "", "", "", "0"), ("C1", "", "", "", "1")]), "customers")
    subs = staging.typed(raw(spark, "subscriptions", [("S1", None, "", "", "1", "active"), ("S2", "C2", "", "", "1", "active")]), "subscriptions")
    # a NULL customer id matches a NULL id on the other side (membership, not SQL equality)
    assert [r.subscription_id for r in Q.unknown_customer(subs, cust).collect()] == ["S2"]
    assert Q.duplicate_key_rows(cust).count() == 2
    assert rows(Q.customers_unique(cust)) == [{"unique_count": 1, "total_rows": 3}]


def test_collation_option(spark):
    events = raw(spark, "events", [
        ("E1", "C1", "Signup", "2023-01-05", "Ads"),
        ("E2", "C1", "SIGNUP", "2023-01-05", "ads"),
        ("E3", "C1", "TRIAL_START", "2023-01-06", "ads"),
    ])
    customers = raw(spark, "customers", [("C1", "2023-01-01", "SMB", "UK", "1")])
    subs = raw(spark, "subscriptions", [("S1", "C1", "2023-01-01", "", "1", "active")])
    tables = {"customers": customers, "subscriptions": subs, "events": events}
    exact = Workload(tables)
    ci = Workload(tables, collation="UNICODE_CI_AI")
    assert exact.events.count() == 3 and ci.events.count() == 2
    # case-insensitive: the 'Signup' event now overrides the signup date, and counts as a trial
    assert exact.customers.first().signup_date == D(2023, 1, 1)
    assert ci.customers.first().signup_date == D(2023, 1, 5)
    assert ci.funnel_base().first().trial == 1 and exact.funnel_base().first().trial == 0
