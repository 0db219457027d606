"""Jobs for spark-submit.

    spark-submit jobs.py build  <raw folder> <lake folder> [as_of]
    spark-submit jobs.py stream <landing folder> <lake folder> <checkpoint folder> [refresh_every]
    spark-submit jobs.py report <lake folder> <report name> <output folder> [parameter=value ...]

Parameters are those of the report, such as granularity=monthly, limit=20, min_support=5 or city=Rome.
"""

from __future__ import annotations

import sys

from tidemart.functions.columns import finite
from tidemart.plans import kpi, lakehouse, quality, questions, rollups
from tidemart.session import clear_scratch, get_session
from tidemart.streaming import ingest

REPORTS = {
    name: getattr(module, name)
    for module, names in (
        (kpi, ["clv", "market_basket", "summary_kpis", "revenue_timeseries", "city_sales", "top_products",
               "inventory_turnover", "delivery_metrics", "seasonal_trends", "customer_segmentation"]),
        (rollups, ["clv_headline", "segment_share", "delivery_headline", "region_bottlenecks", "carrier_performance",
                   "inventory_headline", "stock_by_category", "seasonal_pivot", "reorder_alerts"]),
        (questions, ["total_revenue", "order_count", "average_order_value", "city_revenue", "category_product_count",
                     "category_revenue", "best_store", "previous_month_revenue", "city_top_customers"]),
    )
    for name in names
} | {
    "quality_scores": lambda gold, **given: quality.scores(gold["fact_transactions"], **given),
    "quality_trend": lambda gold: quality.trend(gold["fact_transactions"]),
    "table_checks": quality.checks,
}


def main(args: list[str]) -> None:
    if not args or args[0] not in ("build", "stream", "report"):
        raise SystemExit(__doc__)
    spark = get_session("tidemart")
    command, rest = args[0], args[1:]
    if command == "build":
        raw_root, lake, *as_of = rest
        lakehouse.build_from_files(spark, raw_root, lake, as_of[0] if as_of else None).show(100, truncate=False)
    elif command == "stream":
        landing, lake, checkpoint, *every = rest
        ingest.start(spark, landing, lake, checkpoint, refresh_every=int(every[0]) if every else 1).awaitTermination()
    else:
        lake, name, out, *options = rest
        given = {k: int(v) if v.isdigit() else v for k, _, v in (o.partition("=") for o in options)}
        finite(REPORTS[name](lakehouse.read_gold(spark, lake), **given)).write.mode("overwrite").parquet(out)
    clear_scratch(spark)


if __name__ == "__main__":
    main(sys.argv[1:])
