import datetime as dt
import itertools
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tidemart.operators.basket import pair_counts
from tidemart.plans import bindings, kpi, lakehouse, quality, questions, registry, rollups
from tidemart.schemas import EMPTY_KPIS
from tidemart.sources import tables


def _fact(spark, data):
    return spark.createDataFrame(
        [(t, int(d.strftime("%Y%m%d")), d, a, u, p) for t, d, a, u, p in data],
        "transaction_id string, date_key int, timestamp timestamp, amount double, user_key int, product_key int")


def _day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def brute_pairs(baskets, support):
    seen = Counter()
    for items in baskets.values():
        seen.update(itertools.combinations(sorted(items), 2))
    return sorted((a, b, n) for (a, b), n in seen.items() if n >= support)


@pytest.mark.parametrize("support", [1, 2, 3])
@pytest.mark.parametrize("large", [1, 3, 6, 1000])
def test_pair_counts_match_brute_force_whatever_counts_as_large(spark, support, large):
    rng = random.Random(support * 10 + large)
    baskets = {f"T{i}": set(rng.sample(range(14), rng.randint(1, 8))) for i in range(25)}
    baskets["HUGE"], baskets["HUGE2"] = set(range(14)), set(range(3, 60))
    lines = spark.createDataFrame(
        [(t, p) for t, items in baskets.items() for p in items], "transaction_id string, product_key int")
    assert rows(pair_counts(lines, support, large)) == sorted(brute_pairs(baskets, support), key=repr)


def test_lines_without_a_transaction_are_one_basket(spark):
    baskets = {None: {1, 2, 3}, "": {1, 2}, "+": {2, 3}, "T": {1, 2, 3}}
    lines = spark.createDataFrame(
        [(t, p) for t, items in baskets.items() for p in items], "transaction_id string, product_key int")
    for large in (2, 1000):
        assert rows(pair_counts(lines, 2, large)) == sorted(brute_pairs(baskets, 2), key=repr)


def test_baskets_hang_on_the_same_shuffles(spark, tmp_path):
    """All joins read the lines with one filter, so that Spark shuffles them once for all."""
    spark.range(4000).selectExpr("concat('T', cast(id div 2 as string)) as transaction_id", "cast(id % 20 as int) as product_key") \
        .repartition(4).write.parquet(str(tmp_path / "l"))
    df = pair_counts(spark.read.parquet(str(tmp_path / "l")), 2)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert set(re.findall(r"PushedFilters: \[(.*?)\]", plan)) == {"IsNotNull(product_key)"}


def test_one_huge_basket_is_not_unfolded(spark):
    """A third of all lines in one transaction: 20,000 lines would be 200 million pairs."""
    huge = spark.range(20000).selectExpr("'HUGE' as transaction_id", "cast(id as int) as product_key")
    rest = spark.range(40000).selectExpr(
        "concat('T', cast(id div 2 as string)) as transaction_id", "cast(id % 20000 as int) as product_key")
    found = pair_counts(huge.unionByName(rest), 3)
    # every ordinary pair (2k, 2k+1) is in two ordinary baskets and in the huge one
    assert found.count() == 10000
    assert found.agg(F.min("times_bought_together"), F.max("times_bought_together")).first() == (3, 3)


def test_reports_without_tables_are_empty_with_their_columns(spark):
    calls = {
        "clv": kpi.clv, "market_basket": kpi.market_basket, "city_sales": kpi.city_sales,
        "top_products": kpi.top_products, "inventory_turnover": kpi.inventory_turnover,
        "delivery_metrics": kpi.delivery_metrics, "seasonal_trends": kpi.seasonal_trends,
        "customer_segmentation": kpi.customer_segmentation,
    }
    for name, call in calls.items():
        df = call({})
        assert df.count() == 0 and ", ".join(f"{c} {t}" for c, t in df.dtypes) == EMPTY_KPIS[name]
    assert rows(kpi.summary_kpis({})) == [(0.0, 0, 0)]
    assert kpi.revenue_timeseries({}, "yearly").columns == ["year", "revenue", "order_count"]
    with pytest.raises(ValueError):
        kpi.revenue_timeseries({}, "hourly")


def test_empty_report_schemas_equal_filled_ones(spark, sf):
    for name in EMPTY_KPIS:
        filled = registry.QUERIES[name](spark, sf)
        assert ", ".join(f"{c} {t}" for c, t in filled.dtypes) == EMPTY_KPIS[name], name


def test_segmentation_counts_a_customer_on_both_sides(spark):
    fact = _fact(spark, [("T1", _day(0), 10.0, 1, 1), ("T2", _day(7), 20.0, 1, 1), ("T3", _day(8), 30.0, 1, 1),
                         ("T3", _day(8), 50.0, 1, 2), ("T4", _day(90), 5.0, 2, 1), ("T5", _day(1), 9.0, -1, 1)])
    gold = {"fact_transactions": fact}
    assert rows(kpi.customer_segmentation(gold)) == [
        ("New", 2, 3, 35.0, 35.0 / 3), ("Returning", 1, 1, 80.0, 40.0)]
    assert rows(rollups.segment_share(gold)) == [(3, 75, 25)]
    only_new = {"fact_transactions": fact.filter("transaction_id = 'T1'")}
    assert rows(rollups.segment_share(only_new)) == [(1, 0, 100)]


def test_unknown_members_are_left_out(spark):
    gold = {
        "fact_transactions": _fact(spark, [("T1", _day(0), 10.0, 1, 1), ("T2", _day(0), 7.5, -1, -1)]),
        "dim_users": spark.createDataFrame(
            [(1, "U1", "Ann", "Rome", True)],
            "surrogate_key int, user_id string, name string, city string, is_current boolean"),
        "dim_products": spark.createDataFrame(
            [(1, "P1", "pen", "office", 2.0), (2, "P2", "ink", "office", 3.0)],
            "product_key int, product_id string, product_name string, category string, price double"),
        "fact_inventory": spark.createDataFrame(
            [(1, 0, True), (1, 1, False), (-1, 9, True)], "product_key int, stock_level int, needs_reorder boolean"),
    }
    assert rows(kpi.summary_kpis(gold)) == [(17.5, 1, 2)]
    assert rows(kpi.clv(gold)) == [("U1", "Ann", "Rome", 1, 10.0, 10.0, 0, 10.0)]
    assert rows(kpi.city_sales(gold)) == [("Rome", 1, 10.0, 10.0, 1)]
    assert rows(kpi.inventory_turnover(gold)) == [("ink", "office", 0, 0.0, 0.0, None), ("pen", "office", 1, 0.5, 2.0, 1)]
    assert rows(questions.city_top_customers(gold, "Rome")) == [("Ann", 10.0, 1)]
    scores = quality.scores(gold["fact_transactions"], "2024-01-20", 30).first()
    assert tuple(scores) == (100.0, 100.0, 50.0, 100.0)


def test_quality_of_an_empty_table(spark):
    assert rows(quality.scores(_fact(spark, []), "2024-01-01")) == [(0.0, 0.0, 0.0, 0.0)]
    assert rows(quality.checks({"t": spark.range(0), "u": spark.range(2)})) == [
        ("t", "warning", 0, 0), ("u", "pass", 2, 0)]


def test_column_profile(spark):
    df = spark.createDataFrame(
        [("a", 1.5, None), ("b", None, None), ("a", 2.5, None)], "Country string, unit_price double, email string")
    assert rows(quality.column_profile(df)) == [
        (0, "Country", "string", 0, 0.0, 2, "a|b"), (1, "unit_price", "price", 1, 1 / 3, 2, "1.5|2.5"),
        (2, "email", "email", 3, 1.0, 0, None)]


def test_previous_month_does_not_mix_years(spark):
    fact = _fact(spark, [("T1", dt.datetime(2023, 12, 31, 23), 1.0, 1, 1), ("T2", dt.datetime(2022, 12, 5), 2.0, 1, 1),
                         ("T3", dt.datetime(2024, 1, 1), 4.0, 1, 1)])
    got = questions.previous_month_revenue({"fact_transactions": fact}, "2024-01-15")
    assert rows(got) == [(1.0,)]


def test_a_report_builds_the_tables_it_reads(spark, sf, tmp_path):
    own = tmp_path / "given"
    own.symlink_to(sf)
    here, root = str(own), registry._lake(spark, str(own))

    def built():
        silver, gold = tables.discover(spark, lakehouse.silver_root(root)), tables.discover(spark, lakehouse.gold_root(root))
        return set(silver), gold

    same = {n: rows(registry.QUERIES[n](spark, sf)) for n in ("dim_stores", "ask_average_order_value", "top_pairs", "delivery_metrics")}
    assert rows(registry.QUERIES["dim_stores"](spark, here)) == same["dim_stores"]
    assert built() == ({"transactions"}, {})
    for name in ("ask_average_order_value", "top_pairs"):
        assert rows(registry.QUERIES[name](spark, here)) == same[name]
    silver, sales = built()
    assert silver == {"transactions", "users", "products"}
    assert set(sales) == {"dim_users", "dim_products", "dim_stores", "dim_dates", "fact_transactions"}
    assert rows(registry.QUERIES["delivery_metrics"](spark, here)) == same["delivery_metrics"]
    silver, gold = built()
    assert silver == {"transactions", "users", "products", "shipments"}
    assert gold.pop("fact_shipments") and gold == sales  # what was there stays
    assert rows(registry.QUERIES["layer_tables"](spark, here)) == rows(registry.QUERIES["layer_tables"](spark, sf))


def test_guarded_sql_builds_what_its_role_reads(spark, sf, tmp_path):
    own = tmp_path / "given"
    own.symlink_to(sf)
    assert rows(registry.QUERIES["guarded_sql"](spark, str(own))) == rows(registry.QUERIES["guarded_sql"](spark, sf))
    root = registry._lake(spark, str(own))
    assert set(tables.discover(spark, lakehouse.silver_root(root))) == {"transactions", "users", "products"}
    assert set(tables.discover(spark, lakehouse.gold_root(root))) == {"dim_users", "dim_products", "dim_stores", "dim_dates", "fact_transactions"}


def test_a_build_drops_its_shuffles_and_large_tables_take_turns(spark, sf, tmp_path, monkeypatch):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        found = blocks.getAllFiles()
        return {name for name in (found.apply(i).getName() for i in range(found.size())) if name.startswith("shuffle_")}

    do, busy, most = lakehouse.Run._do, [], []

    def watched(run, step):
        busy.append(step[1])
        most.append(len([name for name in busy if name in lakehouse.LARGE]))
        status = do(run, step)
        busy.remove(step[1])
        return status

    monkeypatch.setattr(lakehouse.Run, "_do", watched)
    before = shuffles()
    status = lakehouse.build_lakehouse(spark, bindings.raw_tables(spark, sf), str(tmp_path), registry.AS_OF, by_month=False)
    assert not shuffles() - before
    assert max(most) == 1
    want = [*lakehouse.ENTITIES, "dim_users", "dim_products", "dim_stores", "dim_dates", *(fact for fact, _, _ in lakehouse.FACTS.values())]
    assert [(r.table, r.status) for r in status.collect()] == [(name, "built") for name in want]


def test_seasonal_pivot_adds_years_up(spark, sf):
    gold = registry.gold(spark, sf)
    total = sum(sum(v for v in r[1:] if v) for r in rows(rollups.seasonal_pivot(gold)))
    assert total == gold["fact_transactions"].count()


JOINS = ["clv", "city_sales", "top_products", "inventory_turnover", "delivery_metrics", "seasonal_trends",
         "customer_segmentation", "revenue_monthly", "market_basket", "fact_transactions", "fact_inventory",
         "fact_shipments", "scd2_merge"]


@pytest.mark.parametrize("name", JOINS)
def test_plans_have_no_products_of_tables(spark, sf, name):
    df = registry.QUERIES[name](spark, sf)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", ["clv", "city_sales", "customer_segmentation", "revenue_daily"])
def test_scans_read_only_what_they_need(spark, sf, name):
    plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    fact = next(line for line in plan.splitlines() if "FileScan" in line and "transaction_id" in line)
    assert "store_key" not in fact and "region" not in fact


SKEW = {
    "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16",
}


@pytest.fixture
def hot_gold(spark, sf, tmp_path):
    """The gold tables with one customer, product and store on a third of all lines, in several files."""
    gold = dict(registry.gold(spark, sf).items())
    hot = F.pmod(F.xxhash64("transaction_id", "product_key"), F.lit(3)) == 0
    fact = gold["fact_transactions"]
    for key in ("user_key", "store_key"):
        fact = fact.withColumn(key, F.when(hot, F.lit(7)).otherwise(F.col(key)))
    many = fact.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(9))))
    many = many.withColumn("transaction_id", F.concat_ws("-", "transaction_id", "copy")).drop("copy")
    many.repartition(12).write.parquet(str(tmp_path / "fact"))
    gold["fact_transactions"] = spark.read.parquet(str(tmp_path / "fact"))
    return gold


@pytest.mark.parametrize("report", [kpi.city_sales, kpi.customer_segmentation])
def test_hot_customers_are_split_over_tasks(spark, hot_gold, report):
    want = rows(report(hot_gold))
    old = {k: spark.conf.get(k, None) for k in SKEW}
    for k, v in SKEW.items():
        spark.conf.set(k, v)
    try:
        df = report(hot_gold)
        assert rows(df) == want
        assert "skew=true" in df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_hot_products_are_split_over_tasks(spark, tmp_path):
    """One product on a third of all lines, in the step that drops rare products."""
    lines = spark.range(60000).selectExpr(
        "concat('T', cast(id div 2 as string)) as transaction_id",
        "cast(case id % 3 when 0 then 1 when 1 then id % 997 else id + 1000 end as int) as product_key")
    lines.repartition(12).write.parquet(str(tmp_path / "l"))
    lines = spark.read.parquet(str(tmp_path / "l"))
    old = {k: spark.conf.get(k, None) for k in SKEW}
    for k, v in SKEW.items():
        spark.conf.set(k, v)
    try:
        df = pair_counts(lines, 2)
        df.collect()
        assert "skew=true" in df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_reports_run_without_broadcast(spark, sf):
    """Beyond the broadcast limit the same plans sort and merge, with the same results."""
    names = ["clv", "city_sales", "top_products", "seasonal_trends", "market_basket", "delivery_metrics"]
    before = {n: rows(registry.QUERIES[n](spark, sf)) for n in names}
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for n in names:
            assert rows(registry.QUERIES[n](spark, sf)) == before[n], n
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_reports_without_their_tables_are_empty(spark):
    from tidemart.plans import questions, rollups

    calls = [
        (questions.total_revenue, ()), (questions.order_count, ()), (questions.average_order_value, ()), (questions.city_revenue, ("x",)),
        (questions.category_product_count, ("x",)), (questions.category_revenue, ()), (questions.best_store, ()),
        (questions.previous_month_revenue, ()), (questions.city_top_customers, ("x",)), (questions.top_customers, ()),
        (questions.top_products, ()), (rollups.delivery_headline, ()), (rollups.region_bottlenecks, ()),
        (rollups.stock_by_category, ()), (rollups.reorder_alerts, ()), (rollups.carrier_performance, ()),
    ]
    for report, args in calls:
        assert report({}, *args).count() == 0, report.__name__


def test_checks_report_what_cannot_be_read(spark, tmp_path):
    from tidemart.plans import quality

    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    broken = spark.read.parquet(path).filter("id >= 0")
    for part in (tmp_path / "t").glob("*.parquet"):
        part.write_bytes(b"no parquet")
    tables = {"good": spark.range(2), "none": spark.range(0), "bad": broken}
    assert rows(quality.checks(tables)) == sorted([("good", "pass", 2, 0), ("none", "warning", 0, 0), ("bad", "fail", 0, 1)], key=repr)
    assert rows(quality.checks({})) == [("No data", "warning", 0, 0)]


def test_counting_does_not_multiply_rows(spark, sf):
    gold = registry.gold(spark, sf)
    for report in (kpi.summary_kpis, kpi.city_sales, kpi.customer_segmentation):
        assert "Expand" not in report(gold)._jdf.queryExecution().toString(), report.__name__
