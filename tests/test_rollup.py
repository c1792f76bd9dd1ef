"""Totals of ranges from stored sums."""

import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyhouse.plans import rollup

BEGIN = datetime(2023, 11, 1)


@pytest.fixture(scope="module")
def moments():
    rng = random.Random(4)
    return [BEGIN + timedelta(seconds=rng.randint(0, 150 * 86400), milliseconds=rng.randint(0, 999)) for _ in range(3000)]


@pytest.fixture(scope="module")
def rows(moments):
    rng = random.Random(5)
    out = [(rng.choice(["A", "A", "A", "B"]), t, Decimal(rng.randint(-500, 9999)) / 100) for t in moments]
    return [*out, ("A", None, Decimal(5)), (None, BEGIN, Decimal(7)), ("A", BEGIN, None), ("A", BEGIN, Decimal(1)), ("B", datetime(2024, 1, 1), Decimal(2))]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory, rows):
    root = tmp_path_factory.mktemp("rollup")
    df = spark.createDataFrame(rows, "v string, t timestamp_ntz, c decimal(12,2)")
    items = df.selectExpr("to_date(t) AS sale_date", "v AS venue_name", "t AS transaction_date", "c AS total_inc")
    items.write.partitionBy("sale_date").parquet(str(root / "items"))
    shifts = df.selectExpr("v AS location_name", "t AS timesheet_date", "t AS roster_start_time", "c * 2 AS timesheet_cost", "c * 3 AS roster_cost")
    feeds = rollup.Feeds(spark.read.parquet(str(root / "items")), shifts, shifts)
    rollup.build_rollups(feeds, str(root / "sums"))
    return str(root / "sums"), feeds


def test_a_cover_is_whole_and_coarse():
    rng = random.Random(6)
    for _ in range(500):
        start = BEGIN + timedelta(seconds=rng.randint(0, 10**7))
        stop = start + timedelta(seconds=rng.choice([rng.randint(0, 5000), rng.randint(0, 10**6), rng.randint(0, 10**8)]))
        pieces = rollup.cover(start, stop)
        assert len(pieces) <= 9
        assert [a for _, a, _ in pieces] == [start, *[z for *_, z in pieces[:-1]]][: len(pieces)]
        assert not pieces or pieces[-1][2] == stop
        for level, a, z in pieces:
            if level != rollup.EDGE:
                assert rollup._up(a, level) == a and rollup._up(z, level) == z
            else:
                assert z - a < timedelta(hours=1)
        rank = [[rollup.EDGE, *rollup.LEVELS].index(level) for level, *_ in pieces]
        top = rank.index(max(rank)) if rank else 0
        assert rank[:top] == sorted(rank[:top]) and rank[top:] == sorted(rank[top:], reverse=True)
    assert rollup.cover(datetime(2024, 1, 1), datetime(2025, 1, 1)) == [("month", datetime(2024, 1, 1), datetime(2025, 1, 1))]


def test_totals_equal_direct_sums(spark, stored, rows):
    path, feeds = stored
    rng = random.Random(7)
    ranges = []
    for k in range(60):
        a = BEGIN + timedelta(seconds=rng.randint(-10**6, 150 * 86400))
        a = rng.choice([a, a.replace(minute=0, second=0), a.replace(hour=0, minute=0, second=0), a.replace(day=1, hour=0, minute=0, second=0)])
        ranges.append(rollup.Range(k, rng.choice(["A", "B", "C"]), a, a + timedelta(seconds=rng.choice([0, 60, 10**4, 10**6, 10**7]))))
    found = {r["range_id"]: tuple(r)[1:] for r in rollup.range_totals(spark, path, feeds, ranges).collect()}
    for r in ranges:
        total = sum((c for v, t, c in rows if v == r.venue and t is not None and c is not None and r.start <= t < r.stop), Decimal(0))
        assert found[r.range_id] == (total, 2 * total, 3 * total)


def test_items_are_read_for_edge_days_only(spark, stored):
    path, feeds = stored
    ranges = [rollup.Range(1, "A", datetime(2023, 11, 3, 10, 30), datetime(2024, 3, 9, 4, 20))]
    plan = rollup.range_totals(spark, path, feeds, ranges)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line and "total_inc" in line]
    assert scans and all("sale_date" in s.split("PartitionFilters: [")[1] for s in scans)
    files = rollup.amounts(feeds, [(a, z) for level, a, z in rollup.cover(*ranges[0][2:]) if level == rollup.EDGE])
    read = files.where("measure = 'sales'").agg(F.count_distinct(F.to_date("at"))).first()[0]
    assert read <= 2
    whole = rollup.range_totals(spark, path, feeds, [rollup.Range(1, "A", datetime(2023, 12, 1), datetime(2024, 2, 1))])
    assert "total_inc" not in "".join(x for x in whole._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Relation" in x)
