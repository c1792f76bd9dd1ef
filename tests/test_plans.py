"""What the plans must and must not do, whatever the size of the data."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from tallyhouse.operators import items
from tallyhouse.plans import etl, reports
from tallyhouse.schemas import SALES
from tallyhouse.session import fresh_dir, shared_root, stored
from tallyhouse.sources import landing, tables
from workload import standins

SF_DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def lake(spark):
    """Sales as stored by their job, and their items partitioned by day."""
    nested, flat = fresh_dir(spark, "nested"), fresh_dir(spark, "flat")
    sales = standins.sales(spark, SF_DIR).where("venue_id < 5")
    sales.write.parquet(nested)
    month = items.sale_items(sales).where("sale_date BETWEEN '2000-01-01' AND '2000-01-31'")
    tables.write_table(month, flat, ("sale_date",))
    return spark.read.parquet(nested), spark.read.parquet(flat)


def test_reports_prune_stored_items(lake):
    report = plan(reports.beverage_sales_total(lake[1], 1, "2000-01-05", "2000-01-06"))
    filters = report[report.index("PartitionFilters") :].split("PushedFilters")[0]
    assert "sale_date" in filters
    assert "EqualTo(master_group_id,1)" in report
    schema = report[report.index("ReadSchema") :]
    assert "product_name" not in schema


def test_nested_scan_pushes_the_range_and_reads_one_leaf(lake):
    flat = items.sale_items(lake[0])
    report = plan(reports.daily_sales(flat.where(F.col("transaction_date") >= "2000-01-01")))
    assert "PushedFilters" in report
    assert "Sales_Details.Transaction_Date" in report[report.index("PushedFilters") :]
    schema = report[report.index("ReadSchema") :]
    assert "Product_Name" not in schema
    assert "Member_Name" not in schema


def test_venue_name_reaches_the_timesheet_scan(spark, lake):
    path = fresh_dir(spark, "timesheets")
    standins.timesheets(spark, SF_DIR).write.parquet(path)
    stored_sheets = spark.read.parquet(path)
    report = plan(
        reports.daily_sales_vs_wages(lake[1], stored_sheets, 2, "2000-01-01", "2000-01-31")
    )
    scan = next(line for line in report.splitlines() if "timesheet_cost" in line and "FileScan" in line)
    assert "ScalarSubquery" in scan or "subquery" in scan.lower()


def test_landing_levels_skip_directories(spark):
    root = fresh_dir(spark, "landing")
    standins.raw_sales(spark, SF_DIR).where("year = 2000").write.partitionBy(*SALES.partitions).json(root)
    scan = plan(landing.read_landing(spark, root, SALES).where("month = 3"))
    assert "month" in scan[scan.index("PartitionFilters") :].split("PushedFilters")[0]


def test_etl_transforms_do_not_shuffle(spark):
    root = fresh_dir(spark, "landing")
    standins.raw_sales(spark, SF_DIR).where("year = 2000").write.partitionBy(*SALES.partitions).json(root)
    assert "Exchange" not in plan(etl.sales_table(landing.read_landing(spark, root, SALES)))


def test_top_products_never_sorts_all_groups(lake):
    assert "TakeOrderedAndProject" in plan(reports.top_products(lake[1], "2000-01-31 12:00:00"))


@pytest.mark.parametrize("name", ["member_spend", "daily_sales", "hourly_wages", "top_products"])
def test_facts_are_reduced_by_hash_before_the_shuffle(spark, name):
    report = plan(driver.queries()[name](spark, SF_DIR))
    assert "partial_sum" in report
    assert "SortAggregate" not in report


def test_venue_names_sort_only_distinct_pairs(spark):
    report = plan(items.venue_dimension(standins.sales(spark, SF_DIR)))
    lowest = [line for line in report.splitlines() if "Aggregate" in line][-1]
    assert "HashAggregate" in lowest
    assert "SortAggregate" not in lowest


# Calls that only read; the others write files and are covered by their rows.
PURE = [
    "coalesce_times", "daily_sales", "daily_sales_vs_wages", "daily_wages", "dashboard_daily",
    "document_context", "explode_items", "hourly_wages", "member_spend", "role_gate",
    "role_gate_allowed", "role_gate_refused", "top_products", "venue_dimension",
]


@pytest.mark.parametrize("name", PURE)
def test_no_cross_joins_or_python(spark, name):
    report = plan(driver.queries()[name](spark, SF_DIR))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "EvalPython"):
        assert operator not in report


@pytest.mark.parametrize("name", ["role_gate", "venue_dimension", "dashboard_daily"])
def test_nothing_is_broadcast_by_hint(spark, name):
    """With broadcasting off, the joins fall back to shuffles."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        report = plan(driver.queries()[name](spark, SF_DIR))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" not in report
    assert "SortMergeJoin" in report


def test_a_hot_order_is_split(spark, tmp_path):
    """A third of all lines on one order: the join's own exchange is dealt out anew."""
    for name in ("orders", "customer", "nation", "part"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{SF_DIR}/{name}.parquet")
    lines = spark.read.schema(standins.SCHEMAS["lineitem"]).parquet(f"{SF_DIR}/lineitem.parquet")
    hot = F.when(F.xxhash64("l_partkey", "l_linenumber", "l_orderkey") % 3 == 0, F.lit(4)).otherwise(F.col("l_orderkey"))
    lines.withColumn("l_orderkey", hot.cast("bigint")).repartition(6).write.parquet(f"{tmp_path}/lineitem.parquet")
    low = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
    }
    for key, value in low.items():
        spark.conf.set(key, value)
    try:
        sales = standins.sales(spark, str(tmp_path))
        assert len(sales.collect()) == lines.count()
        assert "skew=true" in plan(sales)
    finally:
        for key in low:
            spark.conf.unset(key)


def test_shared_folder_comes_from_the_session(spark):
    assert shared_root(spark) == spark.conf.get("spark.checkpoint.dir")
    kept = stored(spark.range(5), "kept")
    assert kept.count() == 5
    assert all(shared_root(spark) in f for f in kept.inputFiles())
