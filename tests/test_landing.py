"""What it takes to land and read the sales feed."""

import json
import time

import pytest
from pyspark.sql import functions as F

from tallyhouse.plans import etl
from tallyhouse.schemas import SALES
from tallyhouse.sources import landing, tables
from tallyhouse.streaming import ingest
from workload import queries, standins

ITEM = {"Product_Name": "pot", "Master_Group_Id": 1, "Quantity": "1", "Total_Inc": 2.50, "Size": "L"}
SALE = {"Transaction_Id": 7, "Transaction_Date": "2024-05-02T10:00:00.000", "Member_Name": "a", "Items": [ITEM, None, {"Product_Name": "cup"}], "Clerk": "Jo"}


@pytest.fixture
def landed(tmp_path):
    folder = tmp_path / "landing" / "year=2024" / "month=5" / "day=1"
    folder.mkdir(parents=True)
    records = [{"venue_id": 1, "venue_name": "v", "Sales": [SALE, None, {"Transaction_Id": 8, "Items": None}], "till": 3}, {"venue_id": 2, "Sales": None}]
    (folder / "a.json").write_text("\n".join(json.dumps(r) for r in records))
    return str(tmp_path / "landing")


def test_nested_records_are_taken_apart_once(spark, landed):
    """An element is not looked up by taking the whole array, and the record around it, apart again."""
    raw = landing.read_whole(spark, landed, SALES)
    plan = raw._jdf.queryExecution().optimizedPlan().toString()
    assert "try_variant_get" in plan
    assert "try_variant_get(try_variant_get(" not in plan
    found = raw.where("venue_id = 1").select(
        F.to_json("rest"), F.transform("Sales", lambda x: F.to_json(x["rest"])),
        F.transform("Sales", lambda x: F.transform(x["Items"], lambda y: F.to_json(y["rest"]))),
    ).first()
    assert tuple(found) == ('{"till":3}', ['{"Clerk":"Jo"}', None, None], [['{"Size":"L"}', None, None], None, None])


def test_a_batch_that_replaces_is_parsed_once(spark, tmp_path, landed, monkeypatch):
    merged, plans = ingest._merged, []

    def watched(table, rows, key, levels):
        plans.append(rows._jdf.queryExecution().optimizedPlan().toString())
        return merged(table, rows, key, levels)

    monkeypatch.setattr(ingest, "_merged", watched)
    out = str(tmp_path / "sales")
    ingest.upsert_new_files(spark, etl.SALES_JOB, "Sales_Details.Transaction_Id", landed, out, str(tmp_path / "checkpoint"))
    assert len(plans) == 1 and "from_json" not in plans[0]
    rows = etl.read_table(spark, out, etl.SALES_JOB, rest=True).select("Sales_Details.Transaction_Id", F.to_json("rest")).collect()
    assert sorted(map(tuple, rows), key=repr) == sorted([(7, '{"till":3}'), (8, '{"till":3}'), (None, '{"till":3}')], key=repr)
    assert spark.read.schema("line string, year int").parquet(etl.malformed_path(out)).count() == 0


def test_landings_are_packed_and_lines_meet_orders_once(spark, tmp_path):
    tables_at = "/root/testdata/sf0.001"
    records = standins.raw_sales(spark, tables_at)
    queries._land(records, SALES, str(tmp_path / "packed"))
    tables.rebalanced(records, SALES.partitions).write.partitionBy(*SALES.partitions).json(str(tmp_path / "plain"))
    packed, plain = (sum(f.stat().st_size for f in (tmp_path / name).rglob("part-*")) for name in ("packed", "plain"))
    assert 2 * packed < plain
    assert spark.read.text(str(tmp_path / "packed")).exceptAll(spark.read.text(str(tmp_path / "plain"))).count() == 0
    assert spark.read.text(str(tmp_path / "packed")).count() == records.count()
    last = records._jdf.queryExecution().optimizedPlan().toString().split("Join ")[1]
    assert "l_orderkey" in last.split("\n")[0]


def test_sales_are_fitted_once(spark, landed):
    """Unnesting asks for the size of the array, which must not fit all its sales over again."""
    for raw in (landing.read_whole(spark, landed, SALES), landing.read_landing(spark, landed, SALES)):
        plan = etl.sales_table(raw)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("as decimal(12,2)") == 4  # a sale's two amounts, an item's two


def test_records_are_made_after_lines_have_been_shuffled(spark):
    """The shuffle by directory carries lines, whose order and customer are in them once, and gives the same records."""
    at = "/root/testdata/sf0.001"
    for made in (standins.raw_sales, standins.raw_sales_wide):
        grouped = made(spark, at, grouped=True)
        plan = grouped._jdf.queryExecution().optimizedPlan().toString()
        assert "named_struct" in plan.split("RebalancePartitions")[0] and "named_struct" not in plan.split("RebalancePartitions")[1]
        mine, plain = (df.select(F.to_json(F.struct("*"))) for df in (grouped, made(spark, at)))
        assert mine.exceptAll(plain).count() == plain.exceptAll(mine).count() == 0


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}


def test_written_tables_and_landings_leave_no_shuffles(spark, tmp_path):
    def land(rows, path):
        queries._land(rows, SALES, path)

    rows = spark.range(1000).selectExpr("id % 7 AS year", "id % 5 AS month", "id % 3 AS day", "id")
    for name, write in {"landing": land, "table": lambda df, path: tables.write_table(df, path, SALES.partitions)}.items():
        before = shuffle_files(spark)
        write(rows, str(tmp_path / name))
        for _ in range(100):
            if not (left := shuffle_files(spark) - before):
                break
            time.sleep(0.1)
        assert not left
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_records_land_a_second_time_as_they_lie_there(spark, tmp_path):
    """Line by line, in the same directories, one without a date too; nothing is joined or shuffled for it."""
    root = str(tmp_path / "landing")
    rows = spark.createDataFrame([(1, 2024, 5, 1), (1, 2024, 5, 1), (2, 2024, 5, 2), (3, None, None, None)], "venue_id int, year int, month int, day int")
    queries._land(rows, SALES, root)
    before = shuffle_files(spark)
    queries._land_again(spark, SALES, root)
    assert not shuffle_files(spark) - before
    twice = spark.read.json(root).select("venue_id", "year", "month", "day").collect()
    assert sorted(map(tuple, twice), key=repr) == sorted([tuple(r) for r in rows.collect()] * 2, key=repr)
