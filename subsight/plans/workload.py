"""The workload as one lazily-built chain of DataFrames.

raw (all strings) -> typed read (profiling / rule checks) -> cleaned -> deduped
-> per-customer event profile -> customer dimension -> products.

Each attribute is a DataFrame built on first access and shared by everything
downstream, so Catalyst sees one plan per product and prunes the columns it does
not need. Only the lineage cuts ``land`` and ``materialize`` run a job: they write tables where
the caller says (the load and create-table-as-select steps of the workload) and go on from the files.
"""

from __future__ import annotations

import os
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cleaning as C
from ..operators import funnel as N
from ..operators import metrics as M
from ..operators.calendar import month_spine, spine_bounds
from ..sources import staging, testdata
from ..sources.schemas import STAGING


def _read_landed(spark: SparkSession, name: str, path: str) -> DataFrame:
    # The schema is known (all-string staging): no footer reads at planning time.
    return spark.read.schema(STAGING[name]).parquet(path).select(*STAGING[name].fieldNames())


class Workload:
    """``collation`` (default None = exact match) is applied to the text columns of the
    cleaned layer, e.g. 'UNICODE_CI_AI' to match values case- and accent-insensitively
    as a database with such a default collation would."""

    def __init__(self, raw: dict[str, DataFrame], collation: str | None = None):
        self.raw = raw
        self.collation = collation
        self._cleaned: dict[str, DataFrame] | None = None

    # --- constructors ------------------------------------------------------

    @classmethod
    def from_testdata(cls, spark: SparkSession, sf_dir: str) -> "Workload":
        """The raw trio derived from the driver tables, which every use reads."""
        return cls(testdata.raw_trio(spark, sf_dir))

    @classmethod
    def from_csv(cls, spark: SparkSession, folder: str) -> "Workload":
        return cls(staging.read_staging_dir(spark, folder))

    @classmethod
    def from_staging(cls, spark: SparkSession, folder: str) -> "Workload":
        """The raw trio from the parquet staging tables ``folder/<table>`` written by
        the incremental landing stream (``streaming.ingest.land_all``)."""
        return cls({t: _read_landed(spark, t, os.path.join(folder, t)) for t in STAGING})

    # --- layers ------------------------------------------------------------

    def typed(self, table: str) -> DataFrame:
        # One DataFrame object per table: later operations reuse its analysed plan.
        cache = self.__dict__.setdefault("_typed", {})
        if table not in cache:
            cache[table] = staging.typed(self.raw[table], table)
        return cache[table]

    @cached_property
    def customers_clean0(self) -> DataFrame:
        return C.with_collation(C.clean_customers(self.raw["customers"]), self.collation)

    @cached_property
    def subscriptions_clean0(self) -> DataFrame:
        return C.with_collation(C.clean_subscriptions(self.raw["subscriptions"]), self.collation)

    @cached_property
    def events_clean0(self) -> DataFrame:
        return C.with_collation(C.clean_events(self.raw["events"]), self.collation)

    # Derived frames are built once per workload (cached_property) so every use
    # shares one analysed plan; ``materialize`` replaces them with file scans.

    @cached_property
    def events(self) -> DataFrame:
        return C.dedup_events(self.events_clean0)

    @cached_property
    def subscriptions(self) -> DataFrame:
        return C.dedup_subscriptions(self.subscriptions_clean0)

    @cached_property
    def profile(self) -> DataFrame:
        return C.customer_event_profile(self.events)

    @cached_property
    def dim(self) -> DataFrame:
        return C.customer_dimension(self.customers_clean0, self.profile)

    @cached_property
    def customers(self) -> DataFrame:
        return self.dim.select(*C.CUSTOMER_COLS)

    @cached_property
    def spine(self) -> DataFrame:
        return spine_bounds(self.customers, self.subscriptions, self.events)

    def bounds(self) -> tuple[Column, Column]:
        """First and last month, as scalar subqueries of one row: no job runs while a plan is being built."""
        return self.spine.select("lo").scalar(), self.spine.select("hi").scalar()

    # --- products ----------------------------------------------------------

    def month_spine(self) -> DataFrame:
        return month_spine(self.spine)

    def customer_month_revenue(self) -> DataFrame:
        lo, hi = self.bounds()
        return M.customer_month_revenue(self.subscriptions, lo, hi)

    def customer_segments(self) -> DataFrame:
        lo, hi = self.bounds()
        return M.customer_segments_of(self.subscriptions, lo, hi)

    def revenue_by_cell(self) -> DataFrame:
        _, hi = self.bounds()
        return M.revenue_by_cell(self.customer_segments(), self.dim, hi)

    def churn_base(self) -> DataFrame:
        return M.churn_base(M.churn_by_customer_month(self.events, self.subscriptions), self.dim)

    def core_metrics(self) -> DataFrame:
        lo, hi = self.bounds()
        return M.core_metrics(self.subscriptions, self.events, self.dim, lo, hi)

    def funnel_base(self) -> DataFrame:
        return N.customer_funnel_base(self.dim, self.subscriptions)

    def funnel_performance(self) -> DataFrame:
        return N.funnel_performance(self.dim, self.subscriptions)

    # --- lineage cut -------------------------------------------------------

    def land(self, folder: str) -> "Workload":
        """Write the raw trio as parquet under ``folder`` (shared on a cluster) and go on from the files:
        raw text is parsed once, whatever is asked of the workload afterwards."""
        for name, df in self.raw.items():
            df.write.mode("overwrite").parquet(os.path.join(folder, name))
        spark = self.raw["customers"].sparkSession
        return Workload({t: _read_landed(spark, t, os.path.join(folder, t)) for t in self.raw}, self.collation)

    def materialize(self, folder: str) -> "Workload":
        """Write deduped events/subscriptions and the customer dimension as parquet
        under ``folder`` (a shared path on a cluster) and continue from the files.

        A lost executor then recomputes from these files, not from the raw scans.
        """
        spark = self.raw["customers"].sparkSession
        tables = {"events": self.events, "subscriptions": self.subscriptions, "dim": self.dim}
        out = {}
        for name, df in tables.items():
            path = os.path.join(folder, name)
            df.write.mode("overwrite").parquet(path)
            out[name] = spark.read.parquet(path)
        self._cleaned = out
        for name in ("events", "subscriptions", "dim"):
            self.__dict__[name] = out[name]
        self.__dict__["customers"] = out["dim"].select(*C.CUSTOMER_COLS)
        for name in ("profile", "spine"):
            self.__dict__.pop(name, None)
        return self
