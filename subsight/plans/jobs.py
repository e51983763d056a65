"""The whole workload as one batch job, in the workload's run order.

1. land the raw trio once (CSV drop folder, or the driver tables for testing) as parquet;
2. write every data check to its own table plus ``check_summary``;
3. clean + deduplicate, and write the cleaned tables (the lineage cut both
   products share; a lost executor re-reads these files);
4. write the metrics table and the funnel table, partitioned by month so
   dashboard filters on month prune files;
5. write the report roll-ups.

Usage::

    python -m subsight.plans.jobs --sf-dir /root/testdata/sf0.01 --out /shared/out
    python -m subsight.plans.jobs --csv-dir /landing --out /shared/out
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession

from ..operators import quality as Q
from ..operators import report as R
from ..sources import sinks
from .workload import Workload


def run(spark: SparkSession, w: Workload, out: str, as_of=Q.DEFAULT_AS_OF) -> dict[str, str]:
    paths = {"raw": os.path.join(out, "raw")}
    w = w.land(paths["raw"])
    sinks.write_checks(Q.all_checks(w, as_of), os.path.join(out, "checks"))
    paths["checks"] = os.path.join(out, "checks")
    w.materialize(os.path.join(out, "cleaned"))
    paths["cleaned"] = os.path.join(out, "cleaned")
    cm = sinks.write_table(w.core_metrics(), os.path.join(out, "core_saas_metrics_detailed"), ["month_start"])
    fp = sinks.write_table(w.funnel_performance(), os.path.join(out, "funnel_performance_detailed"), ["month_start"])
    reports = {
        "report_metrics_cube": R.metrics_cube(cm),
        "report_mrr_growth": R.mrr_growth(cm),
        "report_overall_churn": R.churn_by(cm),
        "report_churn_by_segment": R.churn_by(cm, ("segment",)),
        "report_churn_by_country": R.churn_by(cm, ("country",)),
        "report_churn_by_source": R.churn_by(cm, ("source",)),
        "report_arpc_by_segment": R.arpc_by(cm),
        "report_funnel_by_month": R.funnel_by(fp, ["month_start"]),
        "report_funnel_by_source": R.funnel_by(fp, ["source"]),
        "report_funnel_stages": R.funnel_stages(fp),
        "report_flag_share": R.flag_share(fp),
    }
    for name, df in reports.items():
        sinks.write_table(df, os.path.join(out, "reports", name))
    paths["reports"] = os.path.join(out, "reports")
    return paths


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(description=__doc__)
    src = ap.add_mutually_exclusive_group(required=True)
    src.add_argument("--sf-dir", help="driver tables folder (test mapping)")
    src.add_argument("--csv-dir", help="folder with customers.csv, subscriptions.csv, events.csv")
    ap.add_argument("--out", required=True)
    args = ap.parse_args(argv)
    from ..session import build_session

    spark = build_session()
    w = Workload.from_testdata(spark, args.sf_dir) if args.sf_dir else Workload.from_csv(spark, args.csv_dir)
    for k, v in run(spark, w, args.out).items():
        print(k, v)
    spark.stop()


if __name__ == "__main__":
    main()
