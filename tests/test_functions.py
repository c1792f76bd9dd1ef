from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tallyhouse.functions import calendar, hours, text, timeparse
from tallyhouse.plans.grain import pick_grain

TIMES = [
    "2024-05-01T10:00:00.123",
    "2024-05-01T10:00:00",
    "2024-05-01T10:00:00.1234567",
    "",
    "x",
    None,
]


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("formats", "expected"),
    [
        ((timeparse.WITH_MILLIS,), [datetime(2024, 5, 1, 10, 0, 0, 123000), None]),
        ((timeparse.WITHOUT_MILLIS,), [None, datetime(2024, 5, 1, 10)]),
        (
            (timeparse.WITH_MILLIS, timeparse.WITHOUT_MILLIS),
            [datetime(2024, 5, 1, 10, 0, 0, 123000), datetime(2024, 5, 1, 10)],
        ),
    ],
)
def test_parse_timestamp(spark, formats, expected):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TIMES)], "i int, t string")
    parsed = timeparse.parse_timestamp(F.col("t"), *formats)
    out = df.select("i", parsed.alias("p"), timeparse.is_unparsed(F.col("t"), parsed).alias("u"))
    got = {r["i"]: (r["p"], r["u"]) for r in out.collect()}
    assert [got[0][0], got[1][0]] == expected
    assert [got[i][0] for i in range(2, 6)] == [None] * 4
    assert [got[i][1] for i in range(2, 6)] == [True, True, True, False]
    assert dict(out.dtypes)["p"] == "timestamp_ntz"


@pytest.mark.parametrize(
    ("path", "expected"),
    [("/a/month=05/f", 5), ("/a/month=5/f", 5), ("/a/month=x/f", None), ("/a/f", None)],
)
def test_path_level(spark, path, expected):
    assert one(spark, timeparse.path_level(F.col("v"), "month"), path) == expected


SHIFTS = {
    # start, end -> counted hours, slots
    ("10:00", "10:30"): (1, ["10:00"]),
    ("10:00", "11:00"): (1, ["10:00"]),
    ("10:30", "14:00"): (3, ["10:30", "11:30", "12:30"]),
    ("10:00", "09:00"): (1, ["10:00"]),
    ("10:00", None): (None, None),
    (None, "10:00"): (None, None),
}


@pytest.mark.parametrize(("shift", "expected"), SHIFTS.items())
def test_hours_and_slots(spark, shift, expected):
    at = [t and datetime.fromisoformat(f"2024-05-07 {t}") for t in shift]
    df = spark.createDataFrame([tuple(at)], "a timestamp_ntz, b timestamp_ntz")
    row = df.select(
        hours.counted_hours(F.col("a"), F.col("b")).alias("n"),
        hours.hour_slots(F.col("a"), F.col("b")).alias("s"),
    ).first()
    slots = row["s"] and [t.strftime("%H:%M") for t in row["s"]]
    assert (row["n"], slots) == expected


def test_slots_do_not_follow_the_session_zone(spark):
    """A night on which clocks change in some zones has its usual hours."""
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.createDataFrame(
            [(datetime(2024, 3, 10, 0), datetime(2024, 3, 10, 6))],
            "a timestamp_ntz, b timestamp_ntz",
        )
        row = df.select(
            hours.elapsed_hours(F.col("a"), F.col("b")).alias("n"),
            F.transform(
                hours.hour_slots(F.col("a"), F.col("b")), lambda t: hours.hour_label(t)
            ).alias("s"),
        ).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert row["n"] == 6
    assert row["s"] == [f"2024-03-10 0{h}:00:00" for h in range(6)]


def test_hour_label_is_text(spark):
    label = hours.hour_label(F.col("v"))
    assert one(spark, label, datetime(2024, 5, 7, 9, 59), "timestamp_ntz") == "2024-05-07 09:00:00"


def test_day_range_is_half_open(spark):
    days = [datetime(2024, 5, 17, 23, 59, 59, 999999), datetime(2024, 5, 18), datetime(2024, 5, 1)]
    df = spark.createDataFrame([(d,) for d in days], "t timestamp_ntz")
    kept = df.where(calendar.day_range(F.col("t"), "2024-05-01", "2024-05-17")).collect()
    assert {r["t"] for r in kept} == {days[0], days[2]}


def test_months_before_keeps_the_time_of_day(spark):
    shifted = calendar.months_before(F.col("v"), 3)
    assert one(spark, shifted, datetime(2024, 5, 31, 8, 15), "timestamp_ntz") == datetime(
        2024, 2, 29, 8, 15
    )


def test_last_n_days_counts_today(spark):
    days = [datetime(2024, 5, d, 12) for d in range(9, 18)]
    df = spark.createDataFrame([(d,) for d in days], "t timestamp_ntz")
    kept = df.where(calendar.last_n_days(F.col("t"), "2024-05-15 07:00:00", 5)).collect()
    assert sorted(r["t"].day for r in kept) == [11, 12, 13, 14, 15]


@pytest.mark.parametrize(
    ("start", "end", "grain"),
    [
        ("2024-05-01", "2024-05-01", "hour"),
        ("2024-05-01", "2024-05-31", "day"),
        ("2024-05-01", "2024-06-01", "total"),
        ("2024-01-31", "2024-02-28", "day"),
        ("2024-01-31", "2024-02-29", "total"),
        (date(2023, 12, 15), date(2024, 1, 14), "day"),
        ("2023-12-01", "2024-05-17", "total"),
    ],
)
def test_pick_grain(start, end, grain):
    assert pick_grain(start, end) == grain


@pytest.mark.parametrize(
    ("value", "flat"),
    [
        ("", ""),
        ("plain {a} text", "plain {{a}} text"),
        ('{\n    "a": 1,\n    "b": [\n        2\n    ]\n}', '{{"a": 1,"b": [2]}}'),
        # A line feed takes at most 20 spaces along, and one stacked before it takes of what is left.
        ("\n" + " " * 20 + "x", "x"),
        ("\n" + " " * 21 + "x", " x"),
        ("\n\n" + " " * 21 + "x", "x"),
        ("a\n" + " " * 25 + "b\n\n\n" + " " * 40 + "c\n", "a" + " " * 5 + "bc"),
        ("\n" * 30 + " " * 30, ""),
        ("\n" * 2 + " " * 50, " " * 11),
        ("a \n b\n{", "a b{{"),
    ],
)
def test_flatten_text(spark, value, flat):
    assert one(spark, text.flatten_text(F.col("v")), value) == flat


REPLIES = {
    # reply -> (status, message), (strict status, strict message)
    "NO\nwhy": (("error", "\nwhy"), ("error", "why")),
    "```sql\nselect 1\n```": (("success", " select 1"), ("success", "select 1")),
    "text ```\nselect 1 -- c\nfrom t\n``` more": (
        ("success", "select 1 -- c from t"),
        ("success", "select 1 -- c\nfrom t"),
    ),
    "\t select 2\n": (("success", "select 2"), ("success", "select 2")),
    "select 1 where a is NOT null": (
        ("error", "T null"),
        ("success", "select 1 where a is NOT null"),
    ),
    "NO a NO b": (("error", " a "), ("error", "a NO b")),
    "NOW() is a function": (("error", "W() is a function"), ("success", "NOW() is a function")),
}


@pytest.mark.parametrize(("reply", "expected"), REPLIES.items())
def test_replies(spark, reply, expected):
    for strict, (status, message) in zip((False, True), expected, strict=True):
        assert one(spark, text.reply_status(F.col("v"), strict), reply) == status
        assert one(spark, text.reply_message(F.col("v"), strict), reply) == message
