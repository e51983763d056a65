"""The check summary in few passes against counting every check, and how often it reads the raw tables."""

import datetime as dt
import re

import pytest

from conftest import SMALL
from subsight.operators import quality as Q
from subsight.plans.workload import Workload
from subsight.sources.schemas import STAGING

AS_OF = dt.date(2023, 3, 1)


def raw(spark, customers, subscriptions, events):
    rows = {"customers": customers, "subscriptions": subscriptions, "events": events}
    return Workload({t: spark.createDataFrame(list(r), STAGING[t]) for t, r in rows.items()})


def numbers(df):
    return {r["check_name"]: r["rows"] for r in df.collect()}


CUSTOMERS = [
    ("1", "2023-01-05", "SMB", "US", "True"),
    ("1", "2023-01-05", "SMB", "US", "True"),
    ("1", "2023-02-05", "ENT", "US", "True"),
    ("2", "", "SMB", "US", "True"),
    ("3", "2023-05-01", "SMB", "US", "no"),
    ("", "2023-01-01", "", "", ""),
    (None, "2023-01-01", None, None, None),
    (None, None, None, None, None),
    ("4", "2023-01-09", " SMB", "US", "1"),
    ("4", "2023-01-09", "SMB ", "US", "1"),
]
SUBSCRIPTIONS = [
    ("s1", "1", "2023-01-10", "", "10.00", "active"),
    ("s1", "1", "2023-01-10", "", "10.00", "active"),
    ("s2", "9", "2023-01-10", "2023-01-01", "-1", "canceled"),
    ("s3", "", "2023-04-10", "", "x", "canceled"),
    ("s4", None, "2023-01-10", "2023-06-01", "0", "active"),
    ("s5", "3", "", "", "", ""),
]
EVENTS = [
    ("e1", "1", "signup", "2023-01-05", "ads"),
    ("e2", "1", "signup", "2023-01-06", "ads"),
    ("e3", "1", "signup", "", "ads"),
    ("e4", "1", "trial_start", "2023-01-01", "ads"),
    ("e5", "1", "churned", "2023-01-20", "ads"),
    ("e6", "8", "churned", "2023-01-20", "ads"),
    ("e6", "8", "churned", "2023-01-20", "ads"),
    ("e7", None, "signup", "2022-12-01", "ads"),
    ("e8", "", "signup", "2022-12-02", "ads"),
    ("e9", "4", "signup", "2023-01-09", "ads"),
    ("e10", "4", " signup ", "2023-01-01", "ads"),
]


@pytest.mark.parametrize("keep", [slice(None), slice(0, 0), slice(5, 8), slice(0, 3)])
def test_same_numbers_as_counting_every_check(spark, keep):
    w = raw(spark, CUSTOMERS[keep], SUBSCRIPTIONS[keep], EVENTS[keep])
    assert numbers(Q.workload_summary(w, AS_OF)) == numbers(Q.summary(Q.all_checks(w, AS_OF)))


def test_a_table_may_be_empty(spark):
    for gone in range(3):
        w = raw(spark, *[[] if k == gone else rows for k, rows in enumerate((CUSTOMERS, SUBSCRIPTIONS, EVENTS))])
        assert numbers(Q.workload_summary(w, AS_OF)) == numbers(Q.summary(Q.all_checks(w, AS_OF)))


def test_driver_tables(spark):
    w = Workload.from_testdata(spark, SMALL)
    assert numbers(Q.workload_summary(w)) == numbers(Q.summary(Q.all_checks(w)))


def test_reads_of_the_raw_tables(spark):
    plan = Q.workload_summary(Workload.from_testdata(spark, SMALL))._jdf.queryExecution().optimizedPlan().toString()
    relations = re.findall(r"Relation \[(\w+)#", plan)
    # a customers read has one relation of customer, nation, region and (first order) orders
    customers, events = relations.count("c_custkey"), sum(r.startswith(("event_id", "user_id", "ts")) for r in relations)
    subscriptions = sum(r.startswith("o_") for r in relations) - customers
    assert (customers, subscriptions, events) == (3, 2, 2), relations
    assert "Join Cross" not in plan and "Join FullOuter" not in plan
