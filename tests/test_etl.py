import json
import os
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.functions.rest import rest_field
from tallyhouse.plans import etl
from tallyhouse.schemas import ROSTERS, SALES
from tallyhouse.sources import landing, tables
from tallyhouse.streaming import ingest


NOTHING = dict.fromkeys(("records", "rows", "malformed", "unparsed_times", "unparsed_values", "cleared"), 0)


def land(root, where, *records):
    folder = root / where
    folder.mkdir(parents=True, exist_ok=True)
    name = f"part-{len(list(folder.iterdir()))}.json"
    (folder / name).write_text("\n".join(json.dumps(r) for r in records))


def sale(at, *items, sale_id=1):
    return {
        "Transaction_Id": sale_id,
        "Transaction_Date": at,
        "Member_Id": 7,
        "Items": [
            {"Product_Name": p, "Master_Group_Id": 1, "Quantity": 1, "Total_Inc": 2.5} for p in items
        ],
    }


def venue(*sales, **extra):
    return {"venue_id": 1, "venue_name": "Bar", "Sales": list(sales), **extra}


@pytest.fixture
def sales_landing(tmp_path):
    root = tmp_path / "landing"
    land(root, "year=2024/month=05/day=1", venue(sale("2024-05-01T10:00:00.123", "ale", "tea")))
    land(root, "year=2024/month=5/day=02", venue(sale("2024-05-01T10:00:00"), sale("x", "ale")))
    land(root, "year=2024/month=5/day=3", venue(), {"venue_id": 2, "venue_name": "Inn"})
    return root


def test_sales_job(spark, tmp_path, sales_landing, rows):
    out = str(tmp_path / "sales")
    audit = etl.run_job(spark, etl.SALES_JOB, str(sales_landing), out)
    table = etl.read_table(spark, out, etl.SALES_JOB)
    assert rows(table, "year", "month", "day", "Sales_Details.Transaction_Date") == sorted(
        [
            (2024, 5, 1, datetime(2024, 5, 1, 10, 0, 0, 123000)),
            (2024, 5, 2, None),
            (2024, 5, 2, None),
        ],
        key=repr,
    )
    assert audit == {**NOTHING, "records": 4, "rows": 3, "unparsed_times": 2}
    assert dict(table.dtypes)["venue_id"] == "int"


def test_levels_come_first_and_unknown_columns_stay_out(spark, sales_landing):
    raw = landing.read_landing(spark, str(sales_landing), SALES)
    assert etl.sales_table(raw).columns == [
        "year", "month", "day", "venue_id", "venue_name", "Sales_Details",
    ]


def test_other_top_level_columns_are_kept_when_declared_or_inferred(spark, tmp_path):
    root = tmp_path / "landing"
    land(root, "year=2024/month=5/day=1", venue(sale("2024-05-01T10:00:00.123"), till="T1"))
    wider = SALES.with_fields(T.StructField("till", T.StringType()))
    declared = etl.sales_table(landing.read_landing(spark, str(root), wider))
    inferred = etl.sales_table(landing.read_landing(spark, str(root), SALES, infer=True))
    assert declared.first()["till"] == inferred.first()["till"] == "T1"
    assert inferred.first()["month"] == 5


def test_repeating_a_job(spark, tmp_path, sales_landing):
    replaced, appended = str(tmp_path / "replaced"), str(tmp_path / "appended")
    for _ in range(2):
        etl.run_job(spark, etl.SALES_JOB, str(sales_landing), replaced)
        etl.run_job(spark, etl.SALES_JOB, str(sales_landing), appended, mode="append")
    assert etl.read_table(spark, replaced, etl.SALES_JOB).count() == 3
    assert etl.read_table(spark, appended, etl.SALES_JOB).count() == 6


def test_replacing_leaves_other_directories_alone(spark, tmp_path):
    out = str(tmp_path / "t")
    both = spark.createDataFrame([(1, 2024, 1), (2, 2024, 2)], "v int, year int, month int")
    tables.write_table(both, out, ("year", "month"))
    tables.write_table(
        both.where("month = 2").withColumn("v", F.lit(9)), out, ("year", "month"),
        mode="replace_partitions",
    )
    assert sorted(r["v"] for r in spark.read.parquet(out).collect()) == [1, 9]


def test_unknown_write_mode(spark, tmp_path):
    with pytest.raises(ValueError, match="mode"):
        tables.write_table(spark.range(1), str(tmp_path / "t"), ("id",), mode="upsert")


def test_files_are_snappy_parquet(spark, tmp_path, sales_landing):
    out = tmp_path / "sales"
    etl.run_job(spark, etl.SALES_JOB, str(sales_landing), str(out))
    files = list(out.glob("year=2024/month=5/day=*/*.parquet"))
    assert files
    assert all(f.name.endswith(".snappy.parquet") for f in files)


def test_empty_landing(spark, tmp_path):
    root = tmp_path / "landing"
    root.mkdir()
    table = etl.sales_table(landing.read_landing(spark, str(root), SALES))
    assert table.count() == 0
    assert table.columns[:3] == ["year", "month", "day"]
    rosters = etl.rosters_table(landing.read_landing(spark, str(root), ROSTERS))
    assert dict(rosters.dtypes)["Roster_Start_Time"] == "timestamp_ntz"


@pytest.mark.parametrize("job", [etl.SALES_JOB, etl.ROSTERS_JOB, etl.TIMESHEETS_JOB])
def test_a_job_on_an_empty_landing(spark, tmp_path, job):
    root, out = tmp_path / "landing", str(tmp_path / "out")
    root.mkdir()
    audit = etl.run_job(spark, job, str(root), out)
    assert set(audit.values()) == {0}
    table = etl.read_table(spark, out, job)
    assert table.count() == 0
    assert set(job.feed.partitions) < set(table.columns)


def test_a_table_has_the_columns_of_its_job(spark, tmp_path, sales_landing):
    out = str(tmp_path / "sales")
    etl.run_job(spark, etl.SALES_JOB, str(sales_landing), out)
    stated = etl.read_table(spark, out, etl.SALES_JOB, rest=True)
    found = spark.read.parquet(out)
    assert set(stated.dtypes) == set(found.dtypes)
    declared = etl.read_table(spark, out, etl.SALES_JOB)
    assert "rest" not in declared.columns and "rest" not in declared.schema["Sales_Details"].dataType.names


def test_timesheet_formats(spark, tmp_path, rows):
    root, out = tmp_path / "landing", str(tmp_path / "out")
    land(
        root,
        "year=2024/month=5",
        {
            "location_name": "Bar",
            "Timesheet_Date": "2024-05-01T00:00:00",
            "Pay_Date": "2024-05-01T00:00:00.000",
            "Pay_Start_Time": "2024-05-01T10:00:00.5",
            "Pay_End_Time": "2024-05-01T12:00:00",
            "Clocked_Start_Time": None,
            "Clocked_End_Time": "",
            "timesheet_cost": 10.25,
        },
    )
    audit = etl.run_job(spark, etl.TIMESHEETS_JOB, str(root), out)
    row = etl.read_table(spark, out, etl.TIMESHEETS_JOB).first()
    assert row["Pay_Date"] is None
    assert row["Pay_Start_Time"] == datetime(2024, 5, 1, 10, 0, 0, 500000)
    assert row["Pay_End_Time"] == datetime(2024, 5, 1, 12)
    assert row["Clocked_Start_Time"] is None
    assert row["timesheet_cost"] == Decimal("10.25")
    assert audit == {**NOTHING, "records": 1, "rows": 1, "unparsed_times": 2}


def test_stream_loads_each_file_once(spark, tmp_path, sales_landing):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def load():
        ingest.ingest_new_files(spark, etl.SALES_JOB, str(sales_landing), out, checkpoint, 1)
        return spark.read.parquet(out).count()

    assert load() == 3
    assert load() == 3
    land(sales_landing, "year=2024/month=05/day=1", venue(sale("2024-05-01T11:00:00.000", "ale")))
    assert load() == 4
    levels = spark.read.parquet(out).select("year", "month", "day").distinct().collect()
    assert {tuple(r) for r in levels} == {(2024, 5, 1), (2024, 5, 2)}


def test_stream_equals_batch(spark, tmp_path, sales_landing, rows):
    streamed, batch = str(tmp_path / "streamed"), str(tmp_path / "batch")
    ingest.ingest_new_files(
        spark, etl.SALES_JOB, str(sales_landing), streamed, str(tmp_path / "checkpoint")
    )
    etl.run_job(spark, etl.SALES_JOB, str(sales_landing), batch)
    columns = ("year", "month", "day", "venue_name", "Sales_Details")
    assert rows(spark.read.parquet(streamed), *columns) == rows(spark.read.parquet(batch), *columns)


def test_stream_starts_on_an_empty_landing(spark, tmp_path):
    root = tmp_path / "landing"
    root.mkdir()
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    ingest.ingest_new_files(spark, etl.ROSTERS_JOB, str(root), out, checkpoint)
    land(
        root, "year=2024/month=5", {"location_name": "Bar", "Roster_Start_Time": "2024-05-01T10:00:00"}
    )
    ingest.ingest_new_files(spark, etl.ROSTERS_JOB, str(root), out, checkpoint)
    assert spark.read.parquet(out).count() == 1


def test_marks(spark, tmp_path, rows):
    path = tmp_path / "mark"
    path.mkdir()
    (path / "first.txt").write_text("2024-05-13 20:45:46.150Z")
    mark = ingest.read_mark(spark, str(path)).first()["mark"]
    assert mark == datetime(2024, 5, 13, 20, 45, 46, 150000)
    times = [mark, datetime(2024, 5, 13, 20, 45, 46, 151000), datetime(2024, 5, 12)]
    df = spark.createDataFrame([(t,) for t in times], "t timestamp_ntz")
    assert ingest.rows_since(df, "t", None).count() == 3
    new = ingest.rows_since(df, "t", mark)
    assert [r["t"] for r in new.collect()] == [times[1]]
    ingest.write_mark(ingest.next_mark(new, "t"), str(path))
    assert ingest.read_mark(spark, str(path)).first()["mark"] == times[1]
    # A run without new rows leaves the mark where it was.
    ingest.write_mark(ingest.next_mark(df.limit(0), "t"), str(path))
    assert ingest.read_mark(spark, str(path)).first()["mark"] == times[1]


def test_compaction(spark, tmp_path, rows):
    path, out = str(tmp_path / "many"), tmp_path / "few"
    df = spark.range(100).selectExpr("id", "2024 AS year", "cast(id % 2 AS int) AS month")
    df.repartition(20).write.partitionBy("year", "month").parquet(path)
    tables.compact_table(spark, path, str(out), ("year", "month"))
    assert len(list(out.glob("year=*/month=*/*.parquet"))) == 2
    assert rows(spark.read.parquet(str(out)), "id", "month") == rows(df, "id", "month")


def test_egm_columns_are_read_by_name(spark, tmp_path, rows):
    path = tmp_path / "egm"
    path.mkdir()
    (path / "a.csv").write_text(
        "Floor,EGM Wins,Date,EGM Turnover,Time,Venue\n"
        "2,1.50,2024-05-01,10.25,09:30,4\n"
        "2,n/a,2024-05-02,,09:45,4\n"
    )
    out = landing.extract_egm(landing.read_egm_csv(spark, str(path)))
    assert out.columns == ["Venue_Id", "Date", "Time", "EGM Turnover", "EGM Wins"]
    assert rows(out, "Venue_Id", "EGM Turnover", "EGM Wins") == [("4", "10.25", "1.50"), ("4", None, "n/a")]
    typed = landing.typed_egm(out)
    assert rows(typed, "Venue_Id", "EGM Turnover", "EGM Wins") == [
        (4, Decimal("10.25"), Decimal("1.50")),
        (4, None, None),
    ]


def test_egm_values_are_kept_as_written_and_typed_by_named_forms(spark, rows):
    df = spark.createDataFrame(
        [("1", "17/05/2024", "x", "1,234.50", "12,50"), ("z", "2024-05-17", "y", "-5", "1,23,456")],
        "Venue string, Date string, Time string, `EGM Turnover` string, `EGM Wins` string",
    )
    typed = landing.typed_egm(landing.extract_egm(df))
    assert rows(typed, "Venue_Id", "Date", "EGM Turnover", "EGM Wins") == sorted(
        [(1, date(2024, 5, 17), Decimal("1234.50"), None), (None, date(2024, 5, 17), Decimal("-5.00"), None)], key=repr
    )
    unread = landing.unread_egm(landing.extract_egm(df)).collect()
    assert {r["column"]: r["unread"] for r in unread} == {"Venue_Id": 1, "Date": 0, "Time": 0, "EGM Turnover": 0, "EGM Wins": 2}


def test_egm_files_with_another_column_order_are_not_misread(spark, tmp_path):
    path = tmp_path / "egm"
    path.mkdir()
    (path / "a.csv").write_text("Venue,Date,Time,EGM Turnover,EGM Wins\n4,2024-05-01,09:30,10,1\n")
    (path / "b.csv").write_text("Venue,Date,Time,EGM Wins,EGM Turnover\n4,2024-05-01,09:30,1,10\n")
    with pytest.raises(Exception, match="CSV header"):
        landing.read_egm_csv(spark, str(path)).collect()


def test_a_directory_holding_most_rows_is_written_by_several_tasks(spark, tmp_path):
    """Rebalancing splits the hot directory and leaves a file each to the others."""
    out = tmp_path / "t"
    df = spark.range(300_000).selectExpr(
        "id", "sha(string(id)) AS body", "CASE WHEN id % 10 < 9 THEN 1 ELSE id % 100 END AS level"
    )
    small = {
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1MB",
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    }
    for key, value in small.items():
        spark.conf.set(key, value)
    try:
        tables.write_table(df, str(out), ("level",))
    finally:
        for key in small:
            spark.conf.unset(key)
    files = {d.name: len(list(d.glob("*.parquet"))) for d in out.glob("level=*")}
    assert files.pop("level=1") > 3
    assert max(files.values()) <= 2
    assert spark.read.parquet(str(out)).count() == 300_000


def test_late_files_are_loaded(spark, tmp_path, sales_landing):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    ingest.ingest_new_files(spark, etl.SALES_JOB, str(sales_landing), out, checkpoint)
    assert spark.read.parquet(out).count() == 3
    for days in (0, 8, 30, 400):
        folder = "year=2023/month=1/day=9"
        land(sales_landing, folder, venue(sale("2023-01-09T10:00:00.000", "ale", sale_id=days)))
        newest = max((sales_landing / folder).iterdir(), key=lambda f: f.stat().st_ctime_ns)
        then = newest.stat().st_mtime - days * 86400
        os.utime(newest, (then, then))
    ingest.ingest_new_files(spark, etl.SALES_JOB, str(sales_landing), out, checkpoint)
    assert spark.read.parquet(out).count() == 7


def test_a_batch_into_a_streamed_table_is_refused(spark, tmp_path, sales_landing):
    out = str(tmp_path / "out")
    ingest.ingest_new_files(spark, etl.SALES_JOB, str(sales_landing), out, str(tmp_path / "checkpoint"))
    with pytest.raises(ValueError, match="stream"):
        etl.run_job(spark, etl.SALES_JOB, str(sales_landing), out)


def test_an_emptied_directory_is_cleared(spark, tmp_path):
    root, out = tmp_path / "landing", str(tmp_path / "out")
    land(root, "year=2024/month=5/day=1", venue(sale("2024-05-01T10:00:00.000", "ale")))
    land(root, "year=2024/month=5/day=2", venue(sale("2024-05-02T10:00:00.000", "ale")))
    etl.run_job(spark, etl.SALES_JOB, str(root), out)
    (root / "year=2024/month=5/day=1/part-0.json").write_text(json.dumps(venue()))
    assert etl.run_job(spark, etl.SALES_JOB, str(root), out, levels="day = 2")["cleared"] == 0
    audit = etl.run_job(spark, etl.SALES_JOB, str(root), out)
    assert (audit["rows"], audit["cleared"]) == (1, 1)
    assert [r["day"] for r in etl.read_table(spark, out, etl.SALES_JOB).collect()] == [2]


def test_broken_lines_are_counted_and_set_aside(spark, tmp_path):
    root, out = tmp_path / "landing", str(tmp_path / "out")
    land(root, "year=2024/month=5", {"location_name": "Bar", "roster_cost": "12,50"}, {"location_name": "Inn", "roster_cost": 7})
    (root / "year=2024/month=5/cut.json").write_text('{"location_name": "Ba')
    audit = etl.run_job(spark, etl.ROSTERS_JOB, str(root), out)
    assert audit == {**NOTHING, "records": 3, "rows": 2, "malformed": 1, "unparsed_values": 1}
    costs = {r["location_name"]: r["roster_cost"] for r in etl.read_table(spark, out, etl.ROSTERS_JOB).collect()}
    assert costs == {"Bar": None, "Inn": Decimal("7.00")}
    lines = spark.read.parquet(etl.malformed_path(out)).collect()
    assert [(r["line"], r["month"]) for r in lines] == [('{"location_name": "Ba', 5)]


def test_streams_set_broken_lines_aside(spark, tmp_path):
    root, out = tmp_path / "landing", str(tmp_path / "out")
    land(root, "year=2024/month=5", {"location_name": "Inn", "roster_cost": 7})
    (root / "year=2024/month=5/cut.json").write_text('{"location_name": "Ba')
    ingest.ingest_new_files(spark, etl.ROSTERS_JOB, str(root), out, str(tmp_path / "checkpoint"))
    assert [r["location_name"] for r in spark.read.parquet(out).collect()] == ["Inn"]
    assert [r["line"] for r in spark.read.parquet(etl.malformed_path(out)).collect()] == ['{"location_name": "Ba']


def test_an_inferred_table_is_typed_and_keeps_unnamed_fields(spark, tmp_path):
    root, out = tmp_path / "landing", str(tmp_path / "out")
    sold = sale("2024-05-01T10:00:00.123", "ale") | {"Operator": "X"}
    sold["Items"][0]["Size"] = "pint"
    land(root, "year=2024/month=5/day=1", venue(sold, till="T1"))
    etl.run_job(spark, etl.SALES_JOB, str(root), out, infer=True)
    row = etl.read_table(spark, out, etl.SALES_JOB).first()
    assert (row["venue_id"], row["Sales_Details"]["Items"][0]["Total_Inc"]) == (1, Decimal("2.50"))
    whole = spark.read.parquet(out).select("till", "Sales_Details.Operator", "Sales_Details.Items.Size").first()
    assert tuple(whole) == ("T1", "X", ["pint"])


def test_a_range_prunes_directories(spark, tmp_path, sales_landing):
    raw = landing.read_landing(spark, str(sales_landing), SALES).where("year = 2024 AND day = 1")
    plan = raw._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "day" in plan.split("PartitionFilters: [")[1].split("]")[0]
    out = str(tmp_path / "sales")
    etl.run_job(spark, etl.SALES_JOB, str(sales_landing), out)
    land(sales_landing, "year=2024/month=5/day=1", venue(sale("2024-05-01T12:00:00.000", "ale")))
    land(sales_landing, "year=2024/month=5/day=2", venue(sale("2024-05-02T12:00:00.000", "ale")))
    audit = etl.run_job(spark, etl.SALES_JOB, str(sales_landing), out, levels="day = 1")
    assert audit["rows"] == 2
    assert etl.read_table(spark, out, etl.SALES_JOB).count() == 4


def odd_sale():
    sold = sale("2024-05-01T10:00:00.123", "ale", "tea") | {"Clerk": {"no": 7, "name": "Jo"}, "Discount": 1.50}
    sold["Items"][1]["Size"] = "pot"
    return sold


def test_a_declared_run_keeps_unnamed_fields(spark, tmp_path, rows):
    """At every level, through the load, a reload of the same directory and a compaction; other directories have none."""
    root, out, few = tmp_path / "landing", str(tmp_path / "out"), str(tmp_path / "few")
    land(root, "year=2024/month=5/day=1", venue(odd_sale(), sale("2024-05-01T11:00:00.000"), till="T1", rest=[1, None]), venue(sale("2024-05-01T12:00:00.000")))
    land(root, "year=2024/month=5/day=2", venue(sale("2024-05-02T10:00:00.000", "ale")))

    def kept(path):
        table = etl.read_table(spark, path, etl.SALES_JOB, rest=True)
        own, inner = F.col("rest"), F.col("Sales_Details.rest")
        size = F.transform("Sales_Details.Items", lambda x: rest_field(x["rest"], "$.Size", "string"))
        return rows(table.select(
            "day", rest_field(own, "$.till", "string"), F.to_json(rest_field(own, "$.rest", "variant")),
            rest_field(inner, "$.Clerk.no", "int"), rest_field(inner, "$.Discount", "decimal(12,2)"), size, own.isNull(), inner.isNull(),
        ))

    expected = sorted([
        (1, "T1", "[1,null]", 7, Decimal("1.50"), [None, "pot"], False, False),
        (1, "T1", "[1,null]", None, None, [], False, True),
        (1, None, None, None, None, [], True, True),
        (2, None, None, None, None, [None], True, True),
    ], key=repr)
    audit = etl.run_job(spark, etl.SALES_JOB, str(root), out)
    assert audit == {**NOTHING, "records": 3, "rows": 4}
    assert kept(out) == expected
    etl.run_job(spark, etl.SALES_JOB, str(root), out, levels="day = 1")
    tables.compact_table(spark, out, few, SALES.partitions)
    assert kept(out) == kept(few) == expected
    found = {r["level"]: r["fields"] for r in etl.rest_schemas(etl.read_table(spark, out, etl.SALES_JOB, rest=True)).collect()}
    assert found == {
        "record": "OBJECT<rest: ARRAY<BIGINT>, till: STRING>",
        "sale": "OBJECT<Clerk: OBJECT<name: STRING, no: BIGINT>, Discount: DECIMAL(2,1)>",
        "item": "OBJECT<Size: STRING>",
    }


def test_a_stream_keeps_unnamed_fields(spark, tmp_path):
    root, out = tmp_path / "landing", str(tmp_path / "out")
    land(root, "year=2024/month=05/day=1", venue(odd_sale(), till="T1"))
    ingest.ingest_new_files(spark, etl.SALES_JOB, str(root), out, str(tmp_path / "checkpoint"))
    row = etl.read_table(spark, out, etl.SALES_JOB, rest=True).select("month", rest_field(F.col("rest"), "$.till", "string"), rest_field(F.col("Sales_Details.rest"), "$.Clerk.name", "string")).first()
    assert tuple(row) == (5, "T1", "Jo")


def test_lines_of_every_kind(spark, tmp_path, rows):
    """Arrays of records, empty lines, repeated keys, numbers, nulls, cut lines, awkward names: read or set aside, never lost."""
    root, out = tmp_path / "landing", str(tmp_path / "out")
    folder = root / "year=2024/month=5"
    folder.mkdir(parents=True)
    lines = [
        '[{"location_name": "a", "x": 1}, {"location_name": "b"}]', "", "   ", "[]",
        '{"location_name": "c", "location_name": "d"}', "5", "null", '{"location_name": "e", "roster_cost": {"no": 1}}', '{"location_name": "cu',
        '{"location_name": "f", "it\'s": {"a.b": [true]}, "REST": 2}', '  {"location_name": "g", "roster_cost": "1,5"}', '{"h": null}', "{}", '[{"location_name": "h"}, 3]',
    ]
    (folder / "a.json").write_text("\n".join(lines))
    audit = etl.run_job(spark, etl.ROSTERS_JOB, str(root), out)
    loaded = etl.read_table(spark, out, etl.ROSTERS_JOB, rest=True)
    assert rows(loaded.select("location_name", F.to_json("rest"))) == sorted(
        [("a", '{"x":1}'), ("b", None), ("e", None), ("f", '{"REST":2,"it\'s":{"a.b":[true]}}'), ("g", None), (None, '{"h":null}'), (None, None), ("h", None)], key=repr
    )
    aside = sorted(r["line"] for r in spark.read.parquet(etl.malformed_path(out)).collect())
    assert aside == sorted(["5", "null", '{"location_name": "cu', '{"location_name": "c", "location_name": "d"}', "3"])
    assert (audit["records"], audit["rows"], audit["malformed"], audit["unparsed_values"]) == (13, 8, 5, 2)


def test_no_broken_line_is_lost_with_an_archive(spark, tmp_path):
    """Files that land while a load goes on, in several batches; what is archived has been read for good."""
    root, out, checkpoint, archive = (tmp_path / n for n in ("landing", "out", "checkpoint", "archive"))
    for i in range(5):
        (root / "year=2024/month=5").mkdir(parents=True, exist_ok=True)
        (root / f"year=2024/month=5/whole-{i}.json").write_text(json.dumps({"location_name": f"Inn {i}", "roster_cost": i}))
        (root / f"year=2024/month=5/cut-{i}.json").write_text(f'{{"location_name": "Ba{i}')
        ingest.ingest_new_files(spark, etl.ROSTERS_JOB, str(root), str(out), str(checkpoint), files_per_batch=1, archive=str(archive))
    ingest.ingest_new_files(spark, etl.ROSTERS_JOB, str(root), str(out), str(checkpoint), files_per_batch=1, archive=str(archive))
    loaded = etl.read_table(spark, str(out), etl.ROSTERS_JOB).collect()
    assert sorted(r["location_name"] for r in loaded) == [f"Inn {i}" for i in range(5)]
    lines = spark.read.parquet(etl.malformed_path(str(out))).collect()
    assert sorted(r["line"] for r in lines) == [f'{{"location_name": "Ba{i}' for i in range(5)]
    assert list(archive.rglob("*.json"))


def test_a_batch_that_is_repeated_adds_nothing(spark, tmp_path, sales_landing, monkeypatch):
    """A run that dies after the rows of its batch were written, before the batch counts as done."""
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def dies(*args):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(ingest, "_set_aside", dies)
        with pytest.raises(Exception, match="lost"):
            ingest.ingest_new_files(spark, etl.SALES_JOB, str(sales_landing), out, checkpoint)
    assert spark.read.parquet(out).count() == 3
    ingest.ingest_new_files(spark, etl.SALES_JOB, str(sales_landing), out, checkpoint)
    assert etl.read_table(spark, out, etl.SALES_JOB).count() == 3


def test_a_table_belongs_to_one_checkpoint(spark, tmp_path, sales_landing):
    out = str(tmp_path / "out")
    ingest.ingest_new_files(spark, etl.SALES_JOB, str(sales_landing), out, str(tmp_path / "one"))
    with pytest.raises(ValueError, match="checkpoint"):
        ingest.ingest_new_files(spark, etl.SALES_JOB, str(sales_landing), out, str(tmp_path / "two"))


def upserted(spark, root, tmp_path, rows):
    ingest.upsert_new_files(spark, etl.SALES_JOB, "Sales_Details.Transaction_Id", str(root), str(tmp_path / "out"), str(tmp_path / "log" / "checkpoint"))
    table = etl.read_table(spark, str(tmp_path / "out"), etl.SALES_JOB, rest=True)
    sale = F.col("Sales_Details")
    return rows(table.select("day", sale["Transaction_Id"], F.transform(sale["Items"], lambda x: x["Product_Name"]), rest_field(F.col("rest"), "$.till", "string")))


def at_day(day, name, *sold):
    return f"year=2024/month=5/day={day}", venue(*[sale("2024-05-01T10:00:00.123", name, sale_id=i) for i in sold], till=name)


def test_a_record_sent_again_replaces_the_older_one(spark, tmp_path, rows):
    root = tmp_path / "landing"
    land(root, *at_day(1, "ale", 1, 2, None))
    land(root, *at_day(2, "ale", 3))
    land(root, *at_day(3, "ale", 5))
    first = upserted(spark, root, tmp_path, rows)
    assert len(first) == 5
    untouched = {f.name for f in (tmp_path / "out").rglob("day=3/*.parquet")}
    land(root, *at_day(2, "tea", 1, 4, None))  # the first sale comes again, another day
    expected = sorted(
        [(1, 1, ["tea"], "tea"), (1, 2, ["ale"], "ale"), (1, None, ["ale"], "ale"), (2, 3, ["ale"], "ale"), (2, 4, ["tea"], "tea"), (2, None, ["tea"], "tea"), (3, 5, ["ale"], "ale")],
        key=repr,
    )
    assert upserted(spark, root, tmp_path, rows) == upserted(spark, root, tmp_path, rows) == expected
    assert {f.name for f in (tmp_path / "out").rglob("day=3/*.parquet")} == untouched


def test_of_two_in_one_batch_the_newest_file_counts(spark, tmp_path, rows):
    root = tmp_path / "landing"
    for k, name in enumerate(("ale", "tea", "gin")):
        land(root, *at_day(1, name, 1))
        file = root / f"year=2024/month=5/day=1/part-{k}.json"
        os.utime(file, (1_700_000_000 + (50 if name == "tea" else k), 1_700_000_000 + (50 if name == "tea" else k)))
    assert upserted(spark, root, tmp_path, rows) == [(1, 1, ["tea"], "tea")]


@pytest.mark.parametrize("step", ["write_table", "log_line"])
@pytest.mark.parametrize("call", [1, 2, 3])
def test_an_upsert_that_dies_is_taken_up_again(spark, tmp_path, rows, monkeypatch, step, call):
    """Wherever it stops, also half way through putting the directories in place, the next run ends with the same rows."""
    root = tmp_path / "landing"
    land(root, *at_day(1, "ale", 1, 2, None))
    land(root, *at_day(2, "ale", 3))
    upserted(spark, root, tmp_path, rows)
    land(root, *at_day(2, "tea", 1, 4, None))
    real, calls = getattr(ingest, step), []

    def dies(*args, **more):
        calls.append(args)
        if len(calls) == call + (step == "write_table"):  # the first one only sees to it that there is a table
            if step == "write_table" and len(args) > 3 and args[1].endswith("/out"):
                for file in (tmp_path / "out").rglob("day=1/*.parquet"):
                    file.unlink()  # the directory is gone, the new one not there yet
            raise RuntimeError("lost")
        return real(*args, **more)

    with monkeypatch.context() as m:
        m.setattr(ingest, step, dies)
        try:
            upserted(spark, root, tmp_path, rows)
        except Exception as error:
            assert "lost" in str(error)
    expected = [(1, 1, ["tea"], "tea"), (1, 2, ["ale"], "ale"), (1, None, ["ale"], "ale"), (2, 3, ["ale"], "ale"), (2, 4, ["tea"], "tea"), (2, None, ["tea"], "tea")]
    assert upserted(spark, root, tmp_path, rows) == sorted(expected, key=repr)


def test_overlapping_pulls_lose_no_late_row(spark, tmp_path):
    """A row late by less than the overlap comes once, however often it is pulled; a later one is told."""
    pulls, out, checkpoint = (str(tmp_path / n) for n in ("pulls", "out", "checkpoint"))
    schema = "id bigint, at timestamp_ntz, amount int"
    begin = datetime(2024, 5, 1)

    def pull(*hours):
        rows = [(h, begin + timedelta(hours=h), 1) for h in hours]
        spark.createDataFrame(rows, schema).write.mode("append").parquet(pulls)
        ingest.ingest_pulls(spark, pulls, schema, "id", "at", timedelta(hours=10), out, checkpoint)
        loaded = spark.read.schema(schema).parquet(out)
        missed = ingest.missed_rows(spark.read.schema(schema).parquet(pulls), loaded, "id")
        return sorted(r["id"] for r in loaded.collect()), sorted(r["id"] for r in missed.collect())

    assert pull(0, 20) == ([0, 20], [])
    assert pull(12, 20, 0, 12) == ([0, 12, 20], [])  # eight hours late, twice in one pull
    assert pull(12, 3, 30) == ([0, 12, 20, 30], [3])  # seventeen hours late
    assert pull() == ([0, 12, 20, 30], [3])
    assert pull(21, 30, 25, 3, 20) == ([0, 12, 20, 21, 25, 30], [3])
    df = spark.createDataFrame([(1, begin), (2, begin + timedelta(hours=3))], "id bigint, at timestamp_ntz")
    assert ingest.overlapping(df, "at", None, timedelta(hours=1)).count() == 2
    assert [r["id"] for r in ingest.overlapping(df, "at", begin + timedelta(hours=4), timedelta(hours=2)).collect()] == [2]
