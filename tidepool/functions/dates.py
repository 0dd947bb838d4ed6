"""Dates in texts, as milliseconds since 1970 in UTC; 0 where there is none."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidepool.functions.constants import DAY_MS, MONTHS
from tidepool.functions.text import column

ISO = r"^\s*(\d{1,4})-(\d{1,2})-(\d{1,2})(?:[T ](\d{1,2})(?::(\d{1,2})(?::(\d{1,2}))?)?)?"
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def _part(text: Column, pattern: str, group: int, otherwise: int = 0) -> Column:
    found = F.regexp_extract(text, pattern, group)
    return F.when(found == "", otherwise).otherwise(found.cast("int"))


def _month_start_days(year: Column, month: Column) -> Column:
    """Days from 1970 to the first of a month; months beyond 12 run into the next years."""
    first = F.make_date(year, F.lit(1), F.lit(1))
    return F.datediff(F.add_months(first, month - 1), F.lit("1970-01-01").cast("date"))


def iso_ms(c: str | Column) -> Column:
    """``Y-M-D`` with an optional time; fractions and zones are passed over, overlong parts carry over."""
    text = F.coalesce(column(c), F.lit(""))
    day = _month_start_days(_part(text, ISO, 1, 1970), _part(text, ISO, 2, 1)) + _part(text, ISO, 3, 1) - 1
    seconds = day.cast("long") * 86400 + _part(text, ISO, 4) * 3600 + _part(text, ISO, 5) * 60 + _part(text, ISO, 6)
    return F.when(text.rlike(ISO), seconds * 1000).otherwise(F.lit(0).cast("long"))


def shown_iso(ms: str | Column) -> Column:
    """``yyyy-MM-ddTHH:mm:ss.SSSZ``."""
    return F.date_format(F.timestamp_millis(column(ms)), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def natural_ms(c: str | Column, context_year: int) -> Column:
    """An ISO date, or ``Month D[st][,] [YYYY]`` at noon; without a year from 1900 to 2100 the context's year."""
    text = F.coalesce(column(c), F.lit(""))
    names = "|".join(f"{m}|{m[:3]}" for m in MONTHS)
    pattern = rf"(?i)^\s*({names})(?![A-Za-z])[\s,]*(\d{{1,9}})(?:st|nd|rd|th)?[\s,]*(\d{{1,9}})?"
    short = F.substring(F.lower(F.regexp_extract(text, pattern, 1)), 1, 3)
    month = F.array_position(F.array(*[F.lit(m[:3]) for m in MONTHS]), short).cast("int")
    day, year = _part(text, pattern, 2), _part(text, pattern, 3)
    year = F.when(year.between(1900, 2100), year).otherwise(context_year)
    days = (_month_start_days(year, month) + day - 1).cast("long")
    spoken = F.when(text.rlike(pattern) & day.between(1, 31), days * DAY_MS + DAY_MS // 2).otherwise(F.lit(0).cast("long"))
    iso = iso_ms(text)
    return F.when(iso > 0, iso).otherwise(spoken)


def dataset_iso(c: str | Column) -> Column:
    """``YYYY/MM/DD (Ddd) HH:MM`` as ISO."""
    return F.regexp_replace(column(c), r"^(\d{4})/(\d{2})/(\d{2}) \([A-Za-z]+\) (\d{2}:\d{2})$", "$1-$2-$3T$4:00")


_RFC = re.compile(r"(\d+)\s+([A-Za-z]{3})\S*\s+(\d+)\s+(\d+):(\d+)(?::(\d+))?")


def rfc2822_ms(text: str | None) -> int:
    """A mail header's date; two-digit years are from 1950 to 2049."""
    text = (text or "").split(",", 1)[-1].strip()
    found = _RFC.match(text)
    months = [m[:3] for m in MONTHS]
    if not found or found[2].lower() not in months:
        return 0
    day, year, hour, minute, second = (int(found[k] or 0) for k in (1, 3, 4, 5, 6))
    year += 0 if year >= 100 else 2000 if year < 50 else 1900
    zone = re.search(r"([+-])(\d{1,4})", text[found.end() :])
    shift = 0 if not zone else (int(zone[2]) // 100 * 3600 + int(zone[2]) % 100 * 60) * (-1 if zone[1] == "-" else 1)
    start = datetime(year, months.index(found[2].lower()) + 1, 1, tzinfo=timezone.utc)
    when = start + timedelta(days=day - 1, hours=hour, minutes=minute, seconds=second - shift)
    return int((when - _EPOCH).total_seconds()) * 1000


_MONTH = re.compile("|".join(rf"(?:{m}|{m[:3]})(?![A-Za-z])" for m in MONTHS), re.I)
_ISO_DAY = re.compile(r"\d{4}-\d{2}-\d{2}", re.A)
_SPOKEN = re.compile(r"[\s,]*(\d{1,9})(?:st|nd|rd|th)?[\s,]*(\d{1,9})?", re.A)


def _day_ms(year: int, month: int, day: int, hour: int = 0) -> int:
    if not 1 <= year <= 9999:
        return 0
    year, month = year + (month - 1) // 12, (month - 1) % 12 + 1
    return int((datetime(year, month, 1, tzinfo=timezone.utc) - _EPOCH).days + day - 1) * DAY_MS + hour * 3_600_000


def extract_events(text: str | None, context_year: int) -> list[tuple[str, int]]:
    """(sentence around it, date) of each date mentioned: ISO days, or a month's name and a day.

    After a mention the scan goes on at the next letter or line end, so a date that directly follows is part of the first.
    """
    out, at, text = [], 0, text or ""
    while at < len(text):
        iso, month = _ISO_DAY.match(text, at), None
        if iso:
            year, number, day = map(int, iso[0].split("-"))
            date, end = _day_ms(year, number, day), iso.end()
        elif month := _MONTH.match(text, at):
            end = month.end()
            rest = _SPOKEN.match(text, end)
            day, said = (int(rest[1]), int(rest[2] or 0)) if rest else (0, 0)
            year = said if 1900 <= said <= 2100 else context_year
            date = _day_ms(year, [m[:3] for m in MONTHS].index(month[0][:3].lower()) + 1, day, 12) if 1 <= day <= 31 else 0
        else:
            at += 1
            continue
        if date <= 0:
            at = end
            continue
        low, high = max(at - 80, 0), min(at + 80, len(text))
        while low > 0 and text[low] not in ".\n":
            low -= 1
        low += text[low] in ".\n"
        while high < len(text) and text[high] not in ".\n":
            high += 1
        said = text[low:high].lstrip(" \t\n\r\f\v")
        if 0 < len(said) < 500:
            out.append((said, date))
        at = end
        while at < len(text) and not (text[at].isascii() and text[at].isalpha()) and text[at] != "\n":
            at += 1
    return out
