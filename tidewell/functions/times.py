"""Timestamps and dates in mixed formats, precisions and zones, as columns.

The cascade tries anchored patterns in order; the first that matches the whole
cleaned string decides.  A matching string with an impossible part (month 13,
30 February, 25 o'clock, an unknown zone) has no value; nothing is repaired.
"""

from __future__ import annotations

import zoneinfo

from pyspark.sql import Column
from pyspark.sql import functions as F

# Zone abbreviations with the offset in minutes that they stand for.
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "Z": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MET": 60, "MEST": 120,
    "EET": 120, "EEST": 180, "MSK": 180, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420,
    "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600, "JST": 540, "KST": 540,
    "HKT": 480, "SGT": 480, "AWST": 480, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780,
}
# English month names.
MONTHS = ("JANUARY", "FEBRUARY", "MARCH", "APRIL", "MAY", "JUNE", "JULY", "AUGUST", "SEPTEMBER", "OCTOBER",
          "NOVEMBER", "DECEMBER")

_DAY_US = 86_400_000_000
_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?(?: ?([AP])\.? ?M\.?(?![A-Z]))?"
_ZONE = r" ?(Z|[A-Z]{2,5}|(?:UTC|GMT)?[+-]\d{2}:?\d{2}|[A-Z][A-Z_]+(?:/[A-Z0-9_+-]+)+)"
_MONTH = "(" + "|".join(m if m == "MAY" else f"{m[:3]}(?:{'T?' if m == 'SEPTEMBER' else ''}|{m[3:]})" for m in MONTHS) + r")\.?"
_TAIL = rf"(?:{_TIME}(?:{_ZONE})?)"
_DOW = r"(?:(?:MON|TUE|TUES|WED|WEDNES|THU|THUR|THURS|FRI|SAT|SATUR|SUN)(?:DAY)?\.?,? )?"


def _order(*parts: int) -> str:
    """A replacement that puts year, month and day first, then hour, minute, second, fraction, half and zone."""
    return "|".join(f"${i}" for i in (*parts, 4, 5, 6, 7, 8, 9))


#: Anchored patterns in order, each with the replacement by the feed's date order ("" holds for any other).
SHAPES: tuple[tuple[str, dict[str, str]], ...] = (
    (rf"^(\d{{4}})-(\d{{1,2}})-(\d{{1,2}})(?:[T ]{_TAIL})?$", {"": _order(1, 2, 3)}),
    (rf"^(\d{{4}})[/.](\d{{1,2}})[/.](\d{{1,2}})(?:[T ]{_TAIL})?$", {"": _order(1, 2, 3)}),
    (r"^(\d{4})(\d{2})(\d{2})(?:[T ]?(\d{2})(\d{2})(\d{2})(?:[.,](\d{1,9}))?()(Z|[+-]\d{2}:?\d{2})?)?$", {"": _order(1, 2, 3)}),
    (rf"^(\d{{1,2}})[/.-](\d{{1,2}})[/.-](\d{{2}})(?:,? {_TAIL})?$", {"ymd": _order(1, 2, 3), "mdy": _order(3, 1, 2), "": _order(3, 2, 1)}),
    (rf"^(\d{{1,2}})[/.-](\d{{1,2}})[/.-](\d{{4}})(?:,? {_TAIL})?$", {"mdy": _order(3, 1, 2), "": _order(3, 2, 1)}),
    (rf"^{_DOW}(\d{{1,2}})(?: |-){_MONTH}(?: |-)(\d{{4}}|\d{{2}})(?:,? {_TAIL})?$", {"": _order(3, 2, 1)}),
    (rf"^{_DOW}{_MONTH} (\d{{1,2}}),? (\d{{4}})(?:,? {_TAIL})?$", {"": _order(3, 1, 2)}),
)
_EPOCH = r"^(\d{10}|\d{13})$"


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def cleaned(value: Column) -> Column:
    """Upper case, one blank for each run of white space, none at the ends; invisible characters removed."""
    visible = F.regexp_replace(value.cast("string"), r"[\u200B-\u200F\u2060\uFEFF\u00AD]", "")
    return F.upper(F.trim(F.regexp_replace(visible, r"[\s\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+", " ")))


def _number(text: Column) -> Column:
    return F.when(text == "", None).otherwise(text).try_cast("int")


def _month(text: Column) -> Column:
    """1 to 12 from digits or the first three letters of a name."""
    names = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS) for x in (m[:3], i + 1)])
    return F.coalesce(_number(text), F.try_element_at(names, F.substring(text, 1, 3)))


def _year(text: Column) -> Column:
    """Two digits are years of this century."""
    return F.when(F.length(text) == 2, _number(text) + 2000).otherwise(_number(text))


def _days(year: Column, month: Column, day: Column) -> Column:
    """Days since 1970-01-01, null for a day that no calendar has."""
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    length = F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
    fits = year.between(1900, 2199) & month.between(1, 12) & day.between(1, length)
    return F.when(fits, F.unix_date(F.when(fits, F.make_date(year, month, day))))


def _parts(text: Column, order: Column) -> Column:
    """struct(day, clock, zone) by the first shape that matches the whole string; else null."""
    canon = None
    for pattern, orders in SHAPES:
        made = F.regexp_replace(text, pattern, orders[""])
        for name, replacement in orders.items():
            if name:
                made = F.when(order == name, F.regexp_replace(text, pattern, replacement)).otherwise(made)
        hit = text.rlike(pattern)
        canon = F.when(hit, made) if canon is None else canon.when(hit, made)

    def numbers(p: Column) -> Column:
        hour = _number(p[3])
        half = F.when(hour.between(1, 12), hour % 12 + F.when(p[7] == "P", 12).otherwise(0))
        return F.struct(
            _year(p[0]).alias("y"), _month(p[1]).alias("m"), _number(p[2]).alias("d"),
            F.when(p[3] == "", F.lit(0)).when(p[7] == "", hour).otherwise(half).alias("hour"),
            F.coalesce(_number(p[4]), F.lit(0)).alias("minute"), F.coalesce(_number(p[5]), F.lit(0)).alias("second"),
            F.substring(F.rpad(p[6], 6, "0"), 1, 6).cast("long").alias("micros"), p[8].alias("zone"),
        )

    def checked(n: Column) -> Column:
        timed = n["hour"].between(0, 23) & n["minute"].between(0, 59) & n["second"].between(0, 59)
        seconds = ((n["hour"] * 60 + n["minute"]) * 60 + n["second"]).cast("long")
        return F.struct(
            _days(n["y"], n["m"], n["d"]).alias("day"),
            F.when(timed, seconds * 1_000_000 + n["micros"]).alias("clock"), n["zone"].alias("zone"),
        )

    return _let(_let(F.split(canon, r"\|"), numbers), checked)


def _zone_ids() -> dict[str, str]:
    return {name.upper(): name for name in sorted(zoneinfo.available_timezones()) if "/" in name and not name.startswith("posix")}


def to_utc_micros(value: Column, zone: Column, order: Column) -> Column:
    """Microseconds since 1970 of a raw time string; null where it has no readable value.

    A zone in the string (offset, abbreviation or region) holds, else ``zone``
    (UTC where that is null).  A local hour that occurs twice is its first
    pass; one that a change skips takes the offset in force before the change.
    """
    short = F.create_map(*[F.lit(x) for pair in ABBREVIATIONS.items() for x in pair])
    known = F.create_map(*[F.lit(x) for pair in _zone_ids().items() for x in pair])

    def resolved(p: Column) -> Column:
        local = p["day"].cast("long") * _DAY_US + p["clock"]
        digits = F.regexp_extract(p["zone"], r"^(?:UTC|GMT)?([+-]\d{2}:?\d{2})$", 1)
        away = F.substring(digits, 2, 2).try_cast("int") * 60 + F.substring(digits, -2, 2).try_cast("int")
        minutes = F.when(digits.startswith("-"), -away).when(digits != "", away).otherwise(F.try_element_at(short, p["zone"]))
        region = F.when(p["zone"] == "", F.coalesce(zone, F.lit("UTC"))).when(p["zone"].contains("/"), F.try_element_at(known, p["zone"]))
        return F.struct(local.alias("local"), F.when(minutes.between(-1080, 1080), minutes).alias("minutes"), region.alias("region"))

    def instant(r: Column) -> Column:
        in_region = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(r["local"]), r["region"]))
        return F.when(r["minutes"].isNotNull(), r["local"] - r["minutes"].cast("long") * 60_000_000).otherwise(in_region)

    def read(text: Column) -> Column:
        number = F.when(text.rlike(_EPOCH), text).try_cast("long")
        epoch = F.when(F.length(text) == 13, number * 1000).otherwise(number * 1_000_000)
        return F.when(text.rlike(_EPOCH), epoch).otherwise(_let(_let(_parts(text, F.coalesce(order, F.lit("ymd"))), resolved), instant))

    return _let(cleaned(value), read)


def to_written_day(value: Column, order: Column) -> Column:
    """The calendar day as written, whatever time or zone follows it; null where there is none."""
    day = lambda p: F.when(p["clock"].isNotNull(), F.date_from_unix_date(p["day"]))
    return _let(cleaned(value), lambda text: _let(_parts(text, F.coalesce(order, F.lit("ymd"))), day))


def iso_instant(micros: Column) -> Column:
    """``yyyy-MM-ddTHH:mm:ss.SSSSSSZ``, independent of the session's zone."""
    two = lambda c: F.lpad(c.cast("long").cast("string"), 2, "0")

    def text(us: Column) -> Column:
        rest = F.pmod(us, F.lit(_DAY_US))
        second = F.floor(rest / 1_000_000)
        return F.concat(
            F.date_from_unix_date(F.floor(us / F.lit(_DAY_US)).cast("int")).cast("string"), F.lit("T"),
            two(F.floor(second / 3600)), F.lit(":"), two(F.floor(second / 60) % 60), F.lit(":"), two(second % 60),
            F.lit("."), F.lpad((rest % 1_000_000).cast("string"), 6, "0"), F.lit("Z"),
        )

    return _let(micros, text)


def end_of_day(day: Column) -> Column:
    """The last microsecond of a date."""
    return F.timestamp_micros(F.unix_micros(F.date_add(F.to_date(day), 1).cast("timestamp")) - 1)


def moment(text: Column, last: bool = False) -> Column:
    """An ISO date or time as UTC instant, null if it is neither; a bare date is its first or, with ``last``, its last microsecond."""
    bare = F.length(F.trim(text)) == 10
    at = F.try_to_timestamp(F.trim(text))
    return F.when(bare & F.lit(last), end_of_day(at)).otherwise(at)


def horizon(cutoff: Column, given: Column, days: int = 90) -> Column:
    """The given horizon, else the end of the day ``days`` after the cutoff."""
    return F.coalesce(given, end_of_day(F.date_add(F.to_date(cutoff), days)))


def week_ending(day: Column, weekday: str = "FRI") -> Column:
    """The given weekday on or after a date."""
    return F.next_day(F.date_sub(F.to_date(day), 1), weekday)


def in_open_interval(at: Column, start: Column, stop: Column) -> Column:
    """start < at <= stop; an open end has no bound."""
    return (start.isNull() | (at > start)) & (stop.isNull() | (at <= stop))
