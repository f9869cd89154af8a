"""Timestamps and quantities against literal expectations and brute force."""

from datetime import date, datetime
from itertools import combinations
from zoneinfo import ZoneInfo

import pytest

from ledgerwright.operators import instants, quantities

WRITERS = [(1, "America/New_York", "mdy", "a"), (2, "Europe/Berlin", "dmy", "b"), (3, "Asia/Taipei", "dmy", "c"), (4, "Asia/Kolkata", "dmy", "d"), (5, None, None, "e"), (1, "America/New_York", "mdy", "again")]
LINES = [
    ("2025-01-06 06:16:26", 1, "2025-01-06T11:16:26"), ("2025-01-08T14:11:07+05:45", 1, "2025-01-08T08:26:07"), ("Mon, 06 Jan 2025 10:25:22 +1100", 1, "2025-01-05T23:25:22"),
    ("2025-01-08 01:53:37.262716 UTC", 3, "2025-01-08T01:53:37.262716"), ("2025-01-05T22:58:34.617Z", 2, "2025-01-05T22:58:34.617"), ("2025/01/05 17:04:08 EST", 1, "2025-01-05T22:04:08"),
    ("11-Jan-25 08:18", 2, "2025-01-11T07:18:00"), ("20250112T091839", 3, "2025-01-12T01:18:39"), ("1736371276455708", 1, "2025-01-08T21:21:16.455708"), ("1736466267212", 1, "2025-01-09T23:44:27.212"),
    ("1736142665", 5, "2025-01-06T05:51:05"), ("1736314184.435", 5, "2025-01-08T05:29:44.435"), ("Jan 11, 2025 8:52:16 PM EST", 1, "2025-01-12T01:52:16"), ("01/07/2025 4:56:19 PM", 1, "2025-01-07T21:56:19"),
    ("01/07/2025 4:56:19 PM", 2, "2025-07-01T14:56:19"), ("06.01.25 00:58", 4, "2025-01-05T19:28:00"), ("2025-01-09T13:07:35 America/Chicago", 2, "2025-01-09T19:07:35"), ("2025-01-10T09:55:56[Australia/Sydney]", 5, "2025-01-09T22:55:56"),
    ("2025/01/05 12:00:00 CST", 3, "2025-01-05T04:00:00"), ("Jan 5, 2025 12:00:00 AM IST", 4, "2025-01-04T18:30:00"), (" 2025-01-11 11:42:20 ", 1, "2025-01-11T16:42:20"),
    ("2025-11-02 01:30:00", 1, "2025-11-02T05:30:00"), ("2025/11/02 01:30:00 EST", 1, "2025-11-02T06:30:00"), ("2025-10-26 02:30:00", 2, "2025-10-26T00:30:00"), ("2025-03-09 02:30:00", 1, None),
    ("n/a", 1, None), ("", 1, None), (None, 1, None), ("2025-02-30 10:00:00", 1, None), ("2025-01-06 25:00:00", 1, None), ("2025-01-06 06:00:00", 5, None), ("2025-01-06 06:00:00", 99, None), ("2025-01-06 06:00:00", None, None),
]


def test_notations(spark):
    lines = spark.createDataFrame([(i, t, None, p, "x") for i, (t, p, _) in enumerate(LINES)], "ledger_id long, ts string, date string, pid int, zone string")
    writers = spark.createDataFrame(WRITERS, "pid int, zone_name string, day_order string, role_name string")
    got = {r.ledger_id: r for r in instants.normalise(lines, writers).collect()}
    assert len(got) == len(LINES)
    for i, (text, _, want) in enumerate(LINES):
        at = got[i].utc_instant
        assert (at and at.isoformat(timespec="milliseconds")[:23]) == (want and datetime.fromisoformat(want).isoformat(timespec="milliseconds")[:23]), text
    readings = {LINES[i][0]: r.reading for i, r in got.items()}
    assert readings["2025-11-02 01:30:00"] == "ambiguous" and readings["2025-03-09 02:30:00"] == "nonexistent" and readings["n/a"] == "unreadable"


def test_far_years_and_large_interval_tables(spark):
    rows = [(1, "1890-07-01 12:00:00", None, 2), (2, "2150-07-01 12:00:00 America/New_York", None, 2), (3, "2025-01-06 06:00:00 Nowhere/Land", None, 2)]
    lines = spark.createDataFrame(rows, "ledger_id long, ts string, date string, pid int")
    writers = spark.createDataFrame(WRITERS, "pid int, zone_name string, day_order string, role_name string")
    got = {r.ledger_id: (r.utc_instant and r.utc_instant.isoformat(), r.reading) for r in instants.normalise(lines, writers).collect()}
    assert got[2] == ("2150-07-01T16:00:00", "unique") and got[1][1] == "unique" and got[1][0].startswith("1890-07-01T11:06") and got[3] == (None, "unreadable")


def test_days(spark):
    rows = [(1, None, "01/08/2025", 1), (2, None, "01/08/2025", 2), (3, None, "20250108", 1), (4, "1736142665", "2025-01-07", 1), (5, "1736142665", "Jan 6, 2025", 1), (6, "n/a", "2025-01-07", 1), (7, "1736142665", None, 1), (8, None, "01/08/2025", 5), (9, None, "08.01.2025", 2)]
    lines = spark.createDataFrame(rows, "ledger_id long, ts string, date string, pid int")
    writers = spark.createDataFrame(WRITERS, "pid int, zone_name string, day_order string, role_name string")
    day = {r.ledger_id: r.utc_day for r in instants.normalise(lines, writers).collect()}
    assert [day[k] for k in range(1, 10)] == [date(2025, 1, 8), date(2025, 8, 1), date(2025, 1, 8), date(2025, 1, 6), date(2025, 1, 6), date(2025, 1, 7), date(2025, 1, 6), None, date(2025, 1, 8)]
    assert [r.ledger_id for r in instants.wrong_days(lines, writers).collect()] == [4]
    assert instants.normalise(lines.limit(0), writers).count() == 0 and instants.normalise(lines, writers.limit(0)).count() == 9


@pytest.mark.parametrize("name", ["America/New_York", "Australia/Lord_Howe", "Africa/Casablanca", "UTC"])
def test_intervals_follow_the_zone(name):
    zone = ZoneInfo(name)
    spans = instants.zone_intervals(name, 2000, 2030)
    assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    for lo, hi, off, _ in spans:
        for t in (lo, hi - 1):
            assert datetime.fromtimestamp(t, zone).utcoffset().total_seconds() == off


P = "Company: A | Report: A_2020_10K.pdf | "
STATED = [
    (P + "Line Item: Selling area | 2022: 29.5 | FY2021: 33 | Unit: acres", [("Selling area", 2022, 29.5 * 4046.8564224), ("Selling area", 2021, 33 * 4046.8564224)]),
    (P + "Line Item: Fuel burned (thousand gallons) | Fiscal 2020: 2 | Fiscal 2019: 1", [("Fuel burned", 2020, 2000 * 3.785411784), ("Fuel burned", 2019, 3785.411784)]),
    (P + "Line Item: Order backlog | Table: Operating data (in USD millions) | FY2020: 1,200.5 | FY2019: (3)", [("Order backlog", 2020, 1200.5e6), ("Order backlog", 2019, -3e6)]),
    (P + "Line Item: Freight carried | 2020: 5 short tons | 2019: 6 million lbs", [("Freight carried", 2020, 5 * 907.18474), ("Freight carried", 2019, 6e6 * 0.45359237)]),
    ("x | Content: The ratio for 2018 was 3.1. Dividend per share for fiscal 2017 was US$0.38, it says.", [("Dividend per share", 2017, 0.38)]),
    ("x | Content: We closed fiscal 2015 with customer deposits of $24.5M, which is adequate.", [("Customer deposits", 2015, 24.5e6)]),
    ("x | Content: In FY2020 order backlog amounted to USD 1,180 thousand; fine.", [("Order backlog", 2020, 1.18e6)]),
    ("x | Content: The appendix gives 2 thousands of square feet as the selling area for 2023.", [("Selling area", 2023, 185.80608)]),
    ("x | Content: At the end of 2016, average borrowing rate came to 552 basis points.", [("Average borrowing rate", 2016, 5.52)]),
    ("x | Content: At the end of 2016, fleet distance came to 552 litres.", []),
    ("x | Content: Nothing here in 2016.", []), ("", []),
]


def test_stated_values(spark):
    rows = [(i, "A", "operating_data", t, "clash") for i, (t, _) in enumerate(STATED)] + [(90, "A", "operating_data", None, ""), (91, "A", None, STATED[0][0], ""), (92, None, "operating_data", STATED[5][0], "")]
    df = spark.createDataFrame(rows, "ord long, company string, section string, content string, unit string")
    got = quantities.common_values(df).collect()
    for i, (text, want) in enumerate(STATED):
        mine = sorted((r.measure, r.fiscal_year, round(r.value, 6)) for r in got if r.ord == i)
        assert mine == sorted((m, y, round(v, 6)) for m, y, v in want), text
    assert not [r for r in got if r.ord in (90, 91)] and quantities.common_values(df.limit(0)).count() == 0


def test_contradictions_match_brute_force(spark):
    import random

    rnd = random.Random(3)
    rows = [(k, rnd.choice(["A", "B", None]), "operating_data", f"x | Content: At the end of {rnd.choice([2019, 2020])}, order backlog came to USD {rnd.choice([100, 100.5, 101.9, 102.1, 104, 0, 300])} thousand.") for k in range(120)]
    df = spark.createDataFrame(rows, "ord long, company string, section string, content string")
    said = [(r.ord, r.company, r.fiscal_year, r.value) for r in quantities.common_values(df).collect()]
    want = {(min(a[0], b[0]), max(a[0], b[0])) for a, b in combinations(said, 2) if a[1] and a[1:3] == b[1:3] and abs(a[3] - b[3]) > 0.02 * max(a[3], b[3])}
    got = [tuple(r) for r in quantities.contradictions(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want
