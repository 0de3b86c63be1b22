"""Date parsing and month buckets."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the label a missing or unparseable date gets; it is a real group.
MISSING_MONTH = "NaT"

# A four-digit year, then nothing or month, day and time; so no serial numbers
# and no text of a time alone, which a cast would take.
ISO_PATTERN = r"^\s*[0-9]{4}(-[0-9]{1,2}(-[0-9]{1,2}([T ].*)?)?)?\s*$"
COMPACT_PATTERN = r"^[0-9]{8}$"
OFFSET_PATTERN = r"^(.*[T ][0-9]{1,2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]*)?)?)\s*(?:Z|UTC|[+-][0-9]{1,2}(?::?[0-9]{2})?)\s*$"

# Month names, whose first three letters are their short form.
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September",
          "October", "November", "December")
_MONTH = "(?:" + "|".join(f"{m[:3]}(?:{m[3:]})?" if m[3:] else m for m in MONTHS) + "|Sept)"
_TIME = r"(?:[T ]\s*([0-9]{1,2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]{1,6})?)?)\s*([AaPp][Mm])?)?\s*$"
_NUMBERS = r"^\s*([0-9]{1,2})([/.-])([0-9]{1,2})\2([0-9]{%s})" + _TIME


@dataclass(frozen=True)
class DateFormat:
    """One way to write a date; ``place`` has the pattern's groups of year,
    month, day, time and half of the day."""

    name: str
    pattern: str
    place: tuple[int, int, int, int, int]
    named_month: bool = False


#: Date formats in the order that decides equal counts; month first before day
#: first.  ``iso`` stands for the default forms of :func:`parse_date`.
DATE_FORMATS = (
    DateFormat("iso", ISO_PATTERN, (0, 0, 0, 0, 0)),
    DateFormat("year/month/day", r"^\s*([0-9]{4})([/.])([0-9]{1,2})\2([0-9]{1,2})" + _TIME, (1, 3, 4, 5, 6)),
    DateFormat("month/day/year", _NUMBERS % "4", (4, 1, 3, 5, 6)),
    DateFormat("day/month/year", _NUMBERS % "4", (4, 3, 1, 5, 6)),
    DateFormat("month/day/yy", _NUMBERS % "2", (4, 1, 3, 5, 6)),
    DateFormat("day/month/yy", _NUMBERS % "2", (4, 3, 1, 5, 6)),
    DateFormat("month day, year", rf"(?i)^\s*({_MONTH})\.?\s+([0-9]{{1,2}})(?:st|nd|rd|th)?,?\s+([0-9]{{4}})" + _TIME,
               (3, 1, 2, 4, 5), True),
    DateFormat("day month year", rf"(?i)^\s*([0-9]{{1,2}})(?:st|nd|rd|th)?[ -]({_MONTH})\.?[ ,-]+([0-9]{{4}})" + _TIME,
               (3, 2, 1, 4, 5), True),
)
BY_NAME = {f.name: f for f in DATE_FORMATS}


def parse_as(c: Column | str, fmt: DateFormat | str) -> Column:
    """Parse a date text written in one format; any other text -> null.

    The text is put into ISO order by its pattern and cast, so days that do
    not exist are null.  Two-digit years up to 68 are of this century.
    """
    fmt = BY_NAME[fmt] if isinstance(fmt, str) else fmt
    c = F.col(c) if isinstance(c, str) else c
    if fmt.name == "iso":
        return parse_date(c)
    txt = c.cast("string")
    year, month, day, time, half = fmt.place
    stamp = F.regexp_replace(txt, fmt.pattern, f"${year}-${month}-${day} ${time}")
    if fmt.named_month:
        # The month's name follows the year; its place among the short names, three letters each.
        names = F.lit("".join(m[:3] for m in MONTHS).lower())
        number = ((F.instr(names, F.lower(F.substring(stamp, 6, 3))) + F.lit(2)) / F.lit(3)).cast("int")
        stamp = F.concat(F.substring(stamp, 1, 5), number, F.regexp_replace(stamp, "^[^-]*-[^-]*", ""))
    if fmt.name.endswith("/yy"):
        stamp = F.concat(F.when(F.substring(stamp, 1, 2) <= "68", F.lit("20")).otherwise(F.lit("19")), stamp)
    parsed = F.when(txt.rlike(fmt.pattern), stamp.try_cast("timestamp"))
    # A time of the day's halves: hours 1 to 12, 12 being the first.
    half_of = F.lower(F.regexp_extract(txt, fmt.pattern, half))
    hour = F.hour(parsed)
    halved = F.when(hour.between(1, 12), F.timestamp_add("HOUR", F.when(half_of == "pm", 12).otherwise(0) - F.when(
        hour == 12, 12).otherwise(0), parsed))
    return F.when(txt.rlike(r"[AaPp][Mm]\s*$"), halved).otherwise(parsed)


def parse_date(c: Column | str, formats: Sequence[str] | DateFormat | None = None) -> Column:
    """Parse a date/timestamp text; unparseable -> null.

    Default is ISO (``2025-01-05``, ``2025-01-05T10:00:00``, ``2025-04``,
    ``20250105``).  A time's offset is left out: the date is the wall clock's.
    ``formats`` adds explicit datetime patterns, tried in order after the ISO
    cast, independently of the row order; or it is the one ``DateFormat`` of
    the column (see ``operators.date_formats``), and nothing else is parsed.
    """
    if isinstance(formats, DateFormat) and formats.name != "iso":
        return parse_as(c, formats)
    c = F.col(c) if isinstance(c, str) else c
    txt = c.cast("string")
    wall = F.regexp_replace(txt, OFFSET_PATTERN, "$1")
    parsed = [F.when(txt.rlike(ISO_PATTERN), wall.try_cast("timestamp")),
              F.when(txt.rlike(COMPACT_PATTERN), F.try_to_timestamp(txt, F.lit("yyyyMMdd")))]
    for fmt in formats if formats and not isinstance(formats, DateFormat) else ():
        parsed.append(F.try_to_timestamp(txt, F.lit(fmt)))
    return F.coalesce(*parsed)


def month_bucket(c: Column | str, formats: Sequence[str] | DateFormat | None = None) -> Column:
    """``yyyy-MM`` label of a date, ``NaT`` when it cannot be parsed."""
    return F.coalesce(F.date_format(parse_date(c, formats), "yyyy-MM"), F.lit(MISSING_MONTH))
