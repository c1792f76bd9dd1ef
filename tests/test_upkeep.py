"""The stored dashboard is brought up to date day by day."""

from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyhouse.plans import dashboard, upkeep
from tallyhouse.sources.tables import write_table


@pytest.fixture
def shop(spark, tmp_path):
    """Feeds in directories by day; what is landed is added to them, and a refresh is one call."""
    root, out, state = tmp_path / "feeds", str(tmp_path / "out"), str(tmp_path / "state")
    kinds = {
        "items": "venue_id int, venue_name string, transaction_date timestamp_ntz, total_inc decimal(12,2), sale_date date",
        "timesheets": "location_name string, timesheet_date timestamp_ntz, timesheet_cost decimal(12,2), day date",
        "rosters": "location_name string, roster_start_time timestamp_ntz, roster_cost decimal(12,2), day date",
        "egm": "Venue_Id int, `EGM Turnover` decimal(14,2), `EGM Wins` decimal(14,2), Date date",
    }
    venues = spark.createDataFrame([(1, "A"), (2, "B")], "venue_id int, venue_name string")
    level = {"items": "sale_date", "timesheets": "day", "rosters": "day", "egm": "Date"}

    def land(name, *rows):
        write_table(spark.createDataFrame([r for r in rows], kinds[name]), str(root / name), [level[name]])

    def frames():
        return {n: spark.read.schema(k).parquet(str(root / n)) for n, k in kinds.items()}

    def refresh():
        sources = {n: upkeep.Source(f, [level[n]], F.col(level[n])) for n, f in frames().items()}
        return upkeep.refresh_dashboard(spark, sources, venues, out, state)

    def same_as_a_full_run():
        f = frames()
        whole = dashboard.dashboard_daily(f["items"], f["timesheets"], f["rosters"], f["egm"], "2024-01-01", "2024-12-31", venues=venues)
        columns = ["venue", "date", *dashboard.MEASURES]
        expected, found = (sorted((tuple(r) for r in df.select(columns).collect()), key=repr) for df in (whole, upkeep.read_dashboard(spark, out)))
        assert expected == found
        return len(found)

    for name in kinds:
        land(name)
        (root / name).mkdir(parents=True, exist_ok=True)
    return root, tmp_path / "out", land, refresh, same_as_a_full_run


def sold(venue, day, amount):
    return (venue, " AB"[venue], datetime(2024, 5, day, 10), Decimal(amount), date(2024, 5, day))


def test_refresh(shop):
    root, out, land, refresh, same_as_a_full_run = shop
    assert refresh() == []
    land("items", sold(1, 1, 5), sold(2, 1, 7), sold(1, 2, 9))
    land("timesheets", ("A", datetime(2024, 5, 3), Decimal(4), date(2024, 5, 3)))
    land("rosters", ("C", datetime(2024, 5, 1, 9), Decimal(2), date(2024, 5, 1)))
    land("egm", (1, Decimal(10), Decimal(1), date(2024, 5, 4)), (9, Decimal(3), None, date(2024, 5, 4)))
    assert refresh() == [date(2024, 5, k) for k in (1, 2, 3, 4)]
    assert same_as_a_full_run() == 7
    before = {f: f.stat().st_mtime_ns for f in out.rglob("*.parquet")}
    assert refresh() == []
    land("items", sold(1, 5, 5), sold(1, 2, 1))  # a new day, and a late row of an older one
    assert refresh() == [date(2024, 5, 2), date(2024, 5, 5)]
    assert same_as_a_full_run() == 8
    after = {f: f.stat().st_mtime_ns for f in out.rglob("*.parquet")}
    untouched = {f: t for f, t in before.items() if "date=2024-05-02" not in str(f)}
    assert untouched.items() <= after.items()
    for file in (root / "items").rglob("sale_date=2024-05-0[12]/*"):  # a day is taken back, one of them wholly
        file.unlink()
    assert refresh() == [date(2024, 5, 1), date(2024, 5, 2)]
    assert same_as_a_full_run() == 5


def test_a_refresh_that_dies_is_made_again(shop, monkeypatch):
    _, _, land, refresh, same_as_a_full_run = shop
    land("items", sold(1, 1, 5))
    write = upkeep.write_table

    def dies(*args, **more):
        write(*args, **more)
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(upkeep, "write_table", dies)
        with pytest.raises(RuntimeError, match="lost"):
            refresh()
    assert refresh() == [date(2024, 5, 1)]
    assert same_as_a_full_run() == 1
