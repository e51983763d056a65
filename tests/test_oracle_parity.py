"""Spark queries vs the DuckDB oracle on the smallest driver tables."""

import pytest

from conftest import SMALL

NAMES = [
    "raw_subscriptions",
    "clean_customers",
    "dedup_subscriptions",
    "customers_override_signup",
    "month_spine",
    "active_customers_by_month",
    "revenue_by_cell",
    "churn_base",
    "core_metrics",
    "funnel_performance",
    "check_signup_mismatch",
    "check_event_sequence",
    "check_dup_rows_subscriptions",
    "check_summary",
    "profile_numeric_subscriptions",
    "profile_categorical_customers",
    "report_metrics_cube",
    "report_funnel_stages",
    "report_mrr_growth",
    "preview_customers",
    "check_duplicate_customer_ids",
    "check_dup_rows_customers",
    "check_customers_no_subs",
    "check_null_dates",
    "profile_dates_subscriptions_end",
    "profile_categorical_events",
    "report_funnel_by_segment",
]
DEALT = "op"  # the training-data queries have tests of their own


@pytest.fixture(scope="module")
def duck():
    from oracle_check import duck as make

    return make(SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, duck, name):
    import __spark_entry__ as E
    from oracle_check import canon

    sdf = E.queries()[name](spark, SMALL).toPandas()
    ddf = duck.sql(E.oracle_sql()[name]).df()
    assert sorted(sdf.columns) == sorted(ddf.columns)
    assert len(sdf) == len(ddf)
    assert canon(sdf) == canon(ddf)


def test_every_query_has_an_oracle():
    import __spark_entry__ as E

    ours = {q for q in E.queries() if q != "pipeline" and not q.startswith(DEALT)}
    assert ours <= set(E.oracle_sql())


def test_entry_smoke(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.count() > 0
    assert "mrr" in df.columns and "logo_churn_rate_pct" in df.columns
