"""Mixed timestamp notations and zones: one UTC instant and one UTC day per line.

Method: the first characters of a line tell its notation, whose pattern then runs once and gives all parts; column
expressions make a local time of them and what the text says about its zone. Zone offsets are a table of intervals of
local time, exploded by zone and local year, made for the zones and years that occur. So an as-of join meets a handful
of intervals per line: two that hold the local time mean it is ambiguous, none that it doesn't exist, one gives the
offset. The table has a row per zone and year at most; it and the writers are broadcast after their number was checked.
"""

from __future__ import annotations

import zoneinfo
from collections.abc import Callable, Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwright.runtime import broadcast_if_small, cut

_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
_DAY_US = 86_400_000_000


def _offset(zone: zoneinfo.ZoneInfo, at: int) -> tuple[int, str]:
    t = datetime.fromtimestamp(at, UTC).astimezone(zone)
    return int(t.utcoffset().total_seconds()), t.tzname() or ""


def zone_intervals(name: str, first: int, last: int) -> list[tuple[int, int, int, str]]:
    """(from, to, offset, abbreviation) in UTC seconds, in order, found by probing the zone every four weeks and bisecting."""
    zone = zoneinfo.ZoneInfo(name)
    at, end = (int(datetime(y, 1, 1, tzinfo=UTC).timestamp()) + d * 86_400 for y, d in ((first, -2), (last + 1, 2)))
    out, start, now = [], at, _offset(zone, at)
    while at < end:
        nxt = min(at + 28 * 86_400, end)
        if (then := _offset(zone, nxt)) != now:
            lo, hi = at, nxt
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (mid, hi) if _offset(zone, mid) == now else (lo, mid)
            out.append((start, hi, *now))
            start, now, nxt = hi, _offset(zone, hi), hi
        at = nxt
    out.append((start, end, *now))
    return out


def _known(name: str) -> bool:
    try:
        return bool(zoneinfo.ZoneInfo(name))
    except (zoneinfo.ZoneInfoNotFoundError, ValueError, OSError):
        return False


def interval_table(occurring: DataFrame) -> DataFrame:
    """zone, year, spans of the (zone, year) that occur: the intervals that touch the local year; none for an unknown zone."""
    spans = "array<struct<lo:bigint,hi:bigint,off:bigint,abbr:string>>"

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, year in zip(batch["zone"], batch["year"]):
                if name is not None and pd.notna(year) and 2 <= year <= 9998 and _known(name):
                    made = zone_intervals(name, int(year), int(year))
                    rows.append((name, int(year), [{"lo": (lo + off) * 1_000_000, "hi": (hi + off) * 1_000_000, "off": off * 1_000_000, "abbr": abbr} for lo, hi, off, abbr in made]))
            yield pd.DataFrame(rows, columns=["zone", "year", "spans"])

    return occurring.mapInPandas(explode, f"zone string, year int, spans {spans}")


def _int(c: Column) -> Column:
    return F.expr("try_cast(null as int)") if c is None else c.try_cast("int")


def _day(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970 of a valid date, else null."""
    return F.unix_date(F.try_to_date(F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")), "yyyy-MM-dd"))


def _month(name: Column) -> Column:
    table = F.create_map(*(x for i, m in enumerate(_MONTHS, 1) for x in (F.lit(m), F.lit(i))))
    return F.try_element_at(table, F.lower(F.substring(name, 1, 3)))


def _year(text: Column) -> Column:
    return F.when(F.length(text) == 2, _int(text) + 2000).otherwise(_int(text))


# Notations: what they begin with, their pattern, and the groups of year, month, day, hour, minute, second, fraction, half of
# the day and zone in them. The first one that a line begins like is tried.
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2}))?(?:[.,](\d{1,9}))?(?:\s*([AaPp][Mm])(?![A-Za-z]))?"
_ZONE = r"\s*(\[?[A-Za-z][A-Za-z0-9_+\-/]*\]?|[+\-]\d{2}:?\d{2})?"
_TIMES = {
    "epoch": (r"^\d{9,19}(?:\.|$)", r"^(\d{9,19})(?:\.(\d{1,9}))?$", "12"),
    "iso": (r"^\d{4}[-/.]", rf"^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}})[T ]{_CLOCK}{_ZONE}$", "123456789"),
    "compact": (r"^\d{8}", r"^(\d{4})(\d{2})(\d{2})T?(\d{2})(\d{2})(\d{2})?()()" + _ZONE + "$", "123456789"),
    "numbers": (r"^\d{1,2}[/.\-]\d", rf"^(\d{{1,2}})[/.\-](\d{{1,2}})[/.\-](\d{{4}}|\d{{2}}) {_CLOCK}{_ZONE}$", "312456789"),
    "rfc": (r"^(?:[A-Za-z]{3,9},? )?\d{1,2}[- ][A-Za-z]", rf"^(?:[A-Za-z]{{3,9}},? )?(\d{{1,2}})[- ]([A-Za-z]{{3,9}})[- ](\d{{4}}|\d{{2}}) {_CLOCK}{_ZONE}$", "321456789"),
    "us": (r"^[A-Za-z]", rf"^([A-Za-z]{{3,9}}) (\d{{1,2}}),? (\d{{4}}) {_CLOCK}{_ZONE}$", "312456789"),
}
_DATES = {
    "iso": (r"^\d{4}[-/.]", r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})$", "123"), "compact": (r"^\d{8}$", r"^(\d{4})(\d{2})(\d{2})$", "123"),
    "numbers": (r"^\d{1,2}[/.\-]\d", r"^(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{4}|\d{2})$", "312"), "rfc": (r"^\d{1,2}[- ][A-Za-z]", r"^(\d{1,2})[- ]([A-Za-z]{3,9})[- ](\d{4}|\d{2})$", "321"),
    "us": (r"^[A-Za-z]", r"^([A-Za-z]{3,9}) (\d{1,2}),? (\d{4})$", "312"),
}
_MARK = "\x1f"


def _taken_apart(text: Column, notations: dict[str, tuple[str, str, str]]) -> Column:
    """[notation, parts in order]: one match per line; null if the text isn't in the notation it begins like."""
    t, made = F.trim(text), None
    for name, (begins, pattern, order) in notations.items():
        parts = F.regexp_replace(t, pattern, _MARK.join([name, *(f"${g}" for g in order)]))
        made = F.when(t.rlike(begins), parts) if made is None else made.when(t.rlike(begins), parts)
    parts = F.split(made, _MARK)
    return F.when(F.contains(made, F.lit(_MARK)), parts)


def _day_of(p: Column, dmy: Column) -> Column:
    """Day number of parts. Numbers alone stand in the writer's order, or give null if the order isn't known."""
    kind, a, b = F.get(p, 0), F.get(p, 2), F.get(p, 3)
    numbers = kind == "numbers"
    month = F.when(numbers & dmy, _int(b)).when(kind.isin("rfc", "us"), _month(a)).otherwise(_int(a))
    return F.when(~numbers | dmy.isNotNull(), _day(_year(F.get(p, 1)), month, F.when(numbers & dmy, _int(a)).otherwise(_int(b))))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is made once, however often it is used and wherever the optimiser puts the expression."""
    return F.get(F.transform(F.array(value), use), 0)


def parsed_day(text: Column, dmy: Column) -> Column:
    """The date a text names, or null."""
    return _once(_taken_apart(text, _DATES), lambda p: F.date_from_unix_date(_day_of(p, dmy)))


def _clock(p: Column) -> Column:
    """Microseconds of the day."""
    h, m, s = (F.coalesce(_int(F.get(p, i)), F.lit(0)) for i in (4, 5, 6))
    micros = _int(F.rpad(F.substring(F.get(p, 7), 1, 6), 6, "0"))
    half = F.lower(F.get(p, 8))
    ok = (m < 60) & (s < 60) & F.when(half == "", h < 24).otherwise(h.between(1, 12))
    h = F.when(half == "", h).otherwise(h % 12 + F.when(half == "pm", 12).otherwise(0))
    return F.when(ok, ((h * 60 + m) * 60 + s).cast("bigint") * 1_000_000 + F.coalesce(micros, F.lit(0)))


def _epoch(p: Column) -> Column:
    """UTC microseconds of a count of seconds, milli-, micro- or nanoseconds, told apart by its length."""
    n = F.get(p, 1)
    size, whole = F.length(n), n.try_cast("bigint")
    micros = F.coalesce(_int(F.rpad(F.substring(F.get(p, 2), 1, 6), 6, "0")), F.lit(0))
    return F.when(size <= 11, whole * 1_000_000 + micros).when(size.between(12, 14), whole * 1000).when(size.between(15, 17), whole).when(size >= 18, F.floor(whole / 1000))


def parsed_time(text: Column, dmy: Column) -> Column:
    """struct<utc, local, zone>: microseconds since 1970 in UTC, or of the wall clock, and the zone text, '' if none."""

    def read(p: Column) -> Column:
        epoch = F.get(p, 0) == "epoch"
        local = _day_of(p, dmy).cast("bigint") * _DAY_US + _clock(p)
        return F.struct(F.when(epoch, _epoch(p)).alias("utc"), F.when(~epoch, local).alias("local"), F.when(~epoch, F.regexp_replace(F.get(p, 9), r"[\[\]]", "")).alias("zone"))

    return _once(_taken_apart(text, _TIMES), read)


def normalise(lines: DataFrame, writers: DataFrame, ts: str = "ts", date: str = "date", key: str = "ledger_id", writer: str = "pid") -> DataFrame:
    """key, utc_instant (timestamp), utc_day (date), written_day (date), reading: one row per line.

    utc_instant: the instant of `ts`, null where none can be read. utc_day: its UTC day, without it the day of `date`.
    written_day: the day `date` names. reading: `zoned` (the text says its offset), `unique`, `ambiguous` (the first of
    the two instants is taken), `nonexistent` (skipped by a clock change; null instant), `unreadable`. Writers that are
    missing or without zone leave local times unreadable; of writers listed twice the least zone counts. Repeated lines
    come out as often as they come in; extra columns are ignored, whatever their names.
    """
    who = writers.groupBy(F.col(writer).alias("_w")).agg(F.min("zone_name").alias("_home"), F.min("day_order").alias("_order"))
    src = lines.select(F.col(key).alias("_k"), F.col(ts).alias("_ts"), F.col(date).alias("_date"), F.col(writer).alias("_w"))
    src = src.join(broadcast_if_small(who), "_w", "left")
    dmy = F.when(F.col("_order").isin("dmy", "mdy"), F.col("_order") == "dmy")
    src = src.select("_k", "_home", parsed_time(F.col("_ts"), dmy).alias("_t"), parsed_day(F.col("_date"), dmy).alias("_written"))
    z = F.col("_t.zone")
    signed = z.rlike(r"^[+\-]\d{2}:?\d{2}$")
    digits = F.regexp_replace(z, "[^0-9]", "")
    shift = (F.substring(digits, 1, 2).try_cast("int") * 60 + F.substring(digits, 3, 2).try_cast("int")).cast("bigint") * F.when(z.startswith("-"), -60_000_000).otherwise(60_000_000)
    fixed = F.when(signed, shift).when(F.upper(z).isin("Z", "UTC"), F.lit(0).cast("bigint"))
    named = z.contains("/")
    abbr = F.when((z != "") & ~signed & ~named, F.upper(z))
    src = src.select(
        "_k", "_written", F.col("_t.utc").alias("_utc"), F.col("_t.local").alias("_local"), fixed.alias("_fixed"), abbr.alias("_abbr"),
        F.when(named, z).otherwise(F.col("_home")).alias("zone"), F.year(F.date_from_unix_date(F.floor(F.col("_t.local") / _DAY_US).cast("int"))).alias("year"),
    )
    local_only = F.col("_fixed").isNull() & F.col("_local").isNotNull()
    # no filter: it would be pushed below the parsing and parse once more for each of its columns
    occurring = src.select(F.when(local_only, F.col("zone")).alias("zone"), F.when(local_only, F.col("year")).alias("year")).distinct()
    src = src.join(broadcast_if_small(cut(interval_table(occurring))), ["zone", "year"], "left")
    right_name = lambda s: F.col("_abbr").isNull() | (F.upper(s["abbr"]) == F.col("_abbr"))
    holding = F.filter("spans", lambda s: (s["lo"] <= F.col("_local")) & (F.col("_local") < s["hi"]) & right_name(s))
    # an abbreviation that isn't in force at that local time still names an offset of the zone
    out_of_season = F.when(F.col("_abbr").isNotNull(), F.filter("spans", right_name))
    src = src.withColumn("_m", F.coalesce(holding, F.array().cast("array<struct<lo:bigint,hi:bigint,off:bigint,abbr:string>>"))).withColumn("_o", out_of_season)
    most = F.array_max(F.transform("_m", lambda s: s["off"]))  # the greatest offset is the first instant
    utc = F.coalesce(F.col("_utc"), F.col("_local") - F.col("_fixed"), F.col("_local") - most, F.col("_local") - F.get(F.col("_o"), 0)["off"])
    reading = (
        F.when(F.col("_utc").isNotNull() | (F.col("_local") - F.col("_fixed")).isNotNull(), "zoned")
        .when(F.col("_local").isNull() | F.col("spans").isNull(), "unreadable")
        .when(F.size("_m") > 1, "ambiguous")
        .when(F.size("_m") == 1, "unique")
        .when(F.col("_abbr").isNotNull(), F.when(F.size("_o") > 0, "unique").otherwise("unreadable"))
        .otherwise("nonexistent")
    )
    instant = F.timestamp_micros(utc)
    day = F.date_from_unix_date(F.floor(utc / _DAY_US).cast("int"))
    return src.select(F.col("_k").alias(key), instant.alias("utc_instant"), F.coalesce(day, "_written").alias("utc_day"), F.col("_written").alias("written_day"), reading.alias("reading"))


def wrong_days(lines: DataFrame, writers: DataFrame, key: str = "ledger_id") -> DataFrame:
    """The lines whose instant falls on another UTC day than the one written; lines without either are no case."""
    return normalise(lines, writers, key=key).where(F.col("utc_instant").isNotNull() & F.col("written_day").isNotNull() & (F.col("utc_day") != F.col("written_day"))).select(key)
