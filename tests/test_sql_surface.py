import pytest

from tallyhouse.plans import sql_functions, sql_surface
from tallyhouse.plans.worked_sql import WORKED_SQL
from tallyhouse.session import fresh_dir
from tallyhouse.sources import tables
from workload import standins as s


@pytest.fixture
def view(spark):
    tables.register_views({"shifts": spark.createDataFrame([(1, "x")], "cost int, note string")})


def test_valid_text(spark, view):
    assert sql_surface.check_sql(spark, "SELECT sum(cost) AS c FROM shifts") == sql_surface.PASSED
    outcome = sql_surface.run_sql(spark, "SELECT sum(cost) AS c FROM shifts")
    assert outcome.status == "success"
    assert outcome.frame.first()["c"] == 1


@pytest.mark.parametrize(
    ("text", "part"),
    [
        ("SELEC 1", "PARSE_SYNTAX_ERROR"),
        ("SELECT missing FROM shifts", "missing"),
        ("SELECT * FROM nowhere", "nowhere"),
    ],
)
def test_invalid_text_gives_its_message(spark, view, text, part):
    assert part in sql_surface.check_sql(spark, text)
    outcome = sql_surface.run_sql(spark, text)
    assert (outcome.status, outcome.frame) == ("error", None)
    assert part in outcome.message


@pytest.mark.parametrize(
    "text",
    ["DROP VIEW shifts", "CREATE DATABASE probe_db", "INSERT INTO shifts VALUES (2, 'y')", "SET spark.x = 1",
     "WITH a AS (SELECT 1 AS cost, 'x' AS note) INSERT INTO shifts SELECT * FROM a", "SELECT 1; DROP VIEW shifts", "DROP VIEW shifts;", "SELECT 1;;"],
)
def test_commands_are_refused_and_nothing_runs(spark, view, text):
    assert sql_surface.check_sql(spark, text) != sql_surface.PASSED
    assert sql_surface.run_sql(spark, text).status == "error"
    assert sql_surface.run_sql_into(spark, text, fresh_dir(spark, "answer")).status == "error"
    assert spark.table("shifts").count() == 1
    assert not spark.catalog.databaseExists("probe_db")
    assert spark.conf.get("spark.x", None) is None


@pytest.mark.parametrize("text", ["WITH a AS (SELECT 1 AS x) SELECT x FROM a ORDER BY x -- all", "VALUES (1)", "TABLE shifts", "select 1 as a;", "select ';' as a ; \n"])
def test_every_kind_of_query_passes(spark, view, text):
    assert sql_surface.check_sql(spark, text) == sql_surface.PASSED
    assert sql_surface.run_sql(spark, text).frame.count() == 1


def test_worked_texts_pass_with_their_parameters(spark):
    sf_dir = "/root/testdata/sf0.001"
    tables.register_views({"sales": s.sales(spark, sf_dir), "timesheets": s.timesheets(spark, sf_dir), "rosters": s.rosters(spark, sf_dir)})
    values = {"venue_id": 1, "location": "NATION_2", "start": "2000-01-01", "stop": "2000-02-01", "as_of": "2000-01-01 00:00:00"}
    for text in WORKED_SQL.values():
        assert sql_surface.check_sql(spark, text) != sql_surface.PASSED  # without values
        own = {k: v for k, v in values.items() if f":{k}" in text}
        assert sql_surface.check_sql(spark, text, **own) == sql_surface.PASSED


def test_run_time_errors_are_messages(spark, view):
    text = "SELECT cast(note AS int) AS n FROM shifts"
    assert sql_surface.check_sql(spark, text) == sql_surface.PASSED
    outcome = sql_surface.run_sql_into(spark, text, fresh_dir(spark, "answer"))
    assert outcome.status == "error"
    assert "CAST_INVALID_INPUT" in outcome.message


def test_a_result_is_executed_once_and_kept(spark, view):
    path = fresh_dir(spark, "answer")
    outcome = sql_surface.run_sql_into(spark, "SELECT cost * 2 AS c FROM shifts", path)
    assert [r["c"] for r in outcome.frame.collect()] == [2]
    assert [r["c"] for r in spark.read.parquet(path).collect()] == [2]


def test_tables_by_their_full_name(spark, tmp_path):
    plain, levelled = str(tmp_path / "plain"), str(tmp_path / "levelled")
    spark.range(3).write.parquet(plain)
    df = spark.range(4).selectExpr("id", "2024 AS year", "cast(id % 2 AS int) AS month")
    tables.write_table(df, levelled, ("year", "month"))
    for _ in range(2):
        tables.register_lake(
            spark, "lake_db", str(tmp_path / "db"), {"plain": plain, "levelled": levelled}
        )
    assert spark.sql("SELECT count(*) FROM lake_db.plain").first()[0] == 3
    assert spark.sql("SELECT count(*) FROM lake_db.levelled WHERE month = 1").first()[0] == 2


def test_compaction_by_size(spark, tmp_path):
    """Only directories with small files are written again; a reader under way and one that begins later find the same rows."""
    path = tmp_path / "t"
    df = spark.range(600).selectExpr("id", "parse_json(concat('{\"a\":', id, '}')) AS rest", "2024 AS year", "concat('m ', id % 3, '/x') AS month")
    df.where("month <> 'm 2/x'").repartition(5).write.partitionBy("year", "month").parquet(str(path))
    df.where("month = 'm 2/x'").coalesce(1).write.mode("append").partitionBy("year", "month").parquet(str(path))
    tables.register_lake(spark, "compact_db", str(tmp_path / "db"), {"t": str(path)})
    before = {f: f.stat().st_mtime_ns for f in path.rglob("*.parquet")}
    reader = spark.table("compact_db.t")
    assert reader.count() == 600
    files = {r["month"]: (r["files"], r["small"]) for r in tables.directory_files(reader, ["year", "month"]).collect()}
    assert files == {"m 0/x": (5, 5), "m 1/x": (5, 5), "m 2/x": (1, 1)}
    assert tables.compact_lake(spark, "compact_db.t", str(tmp_path / "compacted")) == 2
    assert {f: f.stat().st_mtime_ns for f in path.rglob("*.parquet")} == before
    rows = spark.table("compact_db.t").selectExpr("id", "month", "variant_get(rest, '$.a', 'bigint') AS a").collect()
    assert sorted((r["id"], r["month"], r["a"]) for r in rows) == [(i, f"m {i % 3}/x", i) for i in range(600)]
    assert reader.count() == 600
    files = {r["month"]: r["files"] for r in tables.directory_files(spark.table("compact_db.t"), ["year", "month"]).collect()}
    assert files == {"m 0/x": 1, "m 1/x": 1, "m 2/x": 1}
    assert tables.compact_lake(spark, "compact_db.t", str(tmp_path / "compacted")) == 0


def test_questions_as_table_functions(spark, tmp_path):
    """Each is called in a larger query, with the rows of the text itself; arguments reach the scan as filters."""
    sf_dir = "/root/testdata/sf0.001"
    frames = {"sales": s.sales(spark, sf_dir), "timesheets": s.timesheets(spark, sf_dir), "rosters": s.rosters(spark, sf_dir)}
    for name, frame in frames.items():
        frame.write.parquet(str(tmp_path / name))
    tables.register_views({name: spark.read.parquet(str(tmp_path / name)) for name in frames})
    assert sorted(sql_functions.register_questions(spark)) == sorted(WORKED_SQL)
    values = {"venue_id": 2, "location": "NATION_2", "start": "1996-01-01", "stop": "2002-01-01", "as_of": "2000-03-31 12:00:00"}
    for name, text in WORKED_SQL.items():
        own = {k: values[k] for k in sql_functions.parameters(name)}
        call = f"{name}({', '.join(f'{k} => :{k}' for k in own)})"
        called = sql_surface.run_sql(spark, f"SELECT q.* FROM {call} AS q JOIN (SELECT 1 AS one) ON one = 1;", **own)
        assert called.status == "success", called.message
        assert sorted(map(repr, called.frame.collect())) == sorted(map(repr, spark.sql(text, args=own).collect()))
    plan = spark.sql("SELECT * FROM total_roster_vs_timesheet(location => 'NATION_2', start => '2000-01-01', stop => '2000-02-01')")
    scans = [x for x in plan._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in x]
    assert len(scans) == 2 and all("EqualTo(location_name,NATION_2)" in x and "GreaterThanOrEqual" in x for x in scans)
    lateral = spark.sql("""SELECT v, b.* FROM VALUES (1), (2), (3) AS x(v), LATERAL beverage_sales_total(venue_id => x.v, start => '1996-05-01', stop => '1999-05-18') AS b""")
    direct = {v: spark.sql(WORKED_SQL["beverage_sales_total"], args={"venue_id": v, "start": "1996-05-01", "stop": "1999-05-18"}).first()[0] for v in (1, 2, 3)}
    assert {r["v"]: r["beverage_sale_inc"] for r in lateral.collect()} == direct
