"""Capture dates from file names, from the strings that cameras write, and from sidecar files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARLIEST = 1990

# fixed values: the shapes of dates in file names in the order in which they are tried. Groups are year, month, day and,
# where a shape has them, hour, minute and second; others are taken at noon.
SHAPES = (
    r"(?i)WhatsApp (?:Image|Video) ([0-9]{4})-([0-9]{2})-([0-9]{2}) at ([0-9]{1,2})[.:]([0-9]{2})[.:]([0-9]{2})",
    r"(?i)(?:IMG|VID|PXL|Screenshot|PHOTO|PIC|MOV|REC)?[-_ ]*([0-9]{4})([0-9]{2})([0-9]{2})[-_ ]+([0-9]{2})([0-9]{2})([0-9]{2})",
    r"([0-9]{4})[-_]([0-9]{2})[-_]([0-9]{2})[-_ T]+([0-9]{2})[-_:.]([0-9]{2})[-_:.]([0-9]{2})",
    r"(?i)(?:IMG|VID)[-_]([0-9]{4})([0-9]{2})([0-9]{2})[-_]WA",
    r"(?:^|[^0-9])([0-9]{4})[-_]([0-9]{2})[-_]([0-9]{2})(?:[^0-9]|$)",
    r"(?:^|[^0-9])(199[0-9]|20[0-9]{2})(0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01])(?:[^0-9]|$)",
)
WITH_TIME = (0, 1, 2)
# fixed values: names with milliseconds since 1970, and notes with day, month and year
EPOCH_SHAPE = r"(?:^|[^0-9])(1[2-7][0-9]{11})(?:[^0-9]|$)"
NOTE_SHAPE = r"Note_([0-9]{2})([0-9]{2})([0-9]{2})_([0-9]{2})([0-9]{2})([0-9]{2})"

# fixed values: the forms of camera dates, in order: with an offset, without one, and of a day alone (taken at noon)
WITH_OFFSET = ("yyyy:MM:dd HH:mm:ssXXX", "yyyy:MM:dd HH:mm:ss XXX", "yyyy-MM-dd HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ss XXX", "yyyy-MM-dd'T'HH:mm:ssXXX")
PLAIN = ("yyyy:MM:dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "yyyy:MM:dd HH.mm.ss", "yyyy-MM-dd HH.mm.ss")
DAYS = ("yyyy:MM:dd", "yyyy-MM-dd", "yyyy/MM/dd")


def _group(name: Column, shape: str, k: int) -> Column:
    return F.nullif(F.regexp_extract(name, shape, k), F.lit("")).try_cast("int")


def _instant(y: Column, mo: Column, d: Column, h: Column, mi: Column, s: Column, as_of_year: int) -> Column:
    """Milliseconds of a date in UTC; hours, minutes and seconds beyond the day's are cut to its last ones; null if there is no such day."""
    made = F.try_make_timestamp(y, mo, d, F.least(h, F.lit(23)), F.least(mi, F.lit(59)), F.least(s, F.lit(59)).cast("double"), F.lit("UTC"))
    return F.when(y.between(EARLIEST, as_of_year), F.unix_millis(made))


def from_name(name: Column, as_of_year: int) -> Column:
    """Milliseconds of the date in a file name: the first shape that matches and is a date; null if none is."""
    noon = (F.lit(12), F.lit(0), F.lit(0))
    found = []
    for k, shape in enumerate(SHAPES):
        parts = [_group(name, shape, g) for g in range(1, 7 if k in WITH_TIME else 4)]
        found.append(_instant(*parts, *(() if k in WITH_TIME else noon), as_of_year))
    ms = F.nullif(F.regexp_extract(name, EPOCH_SHAPE, 1), F.lit("")).try_cast("long")
    year = F.year(F.to_utc_timestamp(F.timestamp_seconds(F.floor(ms / 1000)), F.current_timezone()))
    found.append(F.when(year.between(2000, as_of_year), ms))
    d, mo, yy, h, mi, s = (_group(name, NOTE_SHAPE, g) for g in range(1, 7))
    found.append(_instant(2000 + yy, mo, d, h, mi, s, as_of_year))
    return F.coalesce(*found)


def from_camera(text: Column) -> Column:
    """Milliseconds of a camera's date string, after blanks and NULs around it are dropped; null if no form fits or the year is not from 1970 to 2100."""
    s = F.btrim(text, F.lit(" \t\r\n\x00"))
    whole = F.regexp_replace(s, r"\.[0-9]+", "")
    fraction = F.coalesce(F.floor(F.nullif(F.regexp_extract(s, r":[0-9]{2}(\.[0-9]+)", 1), F.lit("")).try_cast("double") * 1000 + 1e-6), F.lit(0))
    shape = lambda pattern: whole.rlike("^" + pattern + "$")
    time, offset = r"[0-9]{2}:[0-9]{2}:[0-9]{2}", r"(?:[+-][0-9]{2}:[0-9]{2}|Z)"
    ok = lambda t: F.when(F.year(F.to_utc_timestamp(t, F.current_timezone())).between(1970, 2100), F.unix_millis(t) + fraction)
    in_utc = lambda pattern, c=whole: F.try_to_timestamp(F.concat(c, F.lit(" Z")), F.lit(pattern + " X"))
    found = [F.when(shape(rf"[0-9]{{4}}[:-][0-9]{{2}}[:-][0-9]{{2}}[ T]{time} ?{offset}"), ok(F.try_to_timestamp(whole, F.lit(p)))) for p in WITH_OFFSET]
    found += [F.when(shape(r"[0-9]{4}[-:/][0-9]{2}[-:/][0-9]{2}[ T][0-9]{2}[:.]?.*"), ok(in_utc(p))) for p in PLAIN[:4]]
    dotted = F.btrim(text, F.lit(" \t\r\n\x00"))
    found += [ok(in_utc(p, dotted)) for p in PLAIN[4:]]
    found += [F.when(shape(r"[0-9]{4}[-:/][0-9]{2}[-:/][0-9]{2}"), ok(in_utc(p + " HH", F.concat(whole, F.lit(" 12"))))) for p in DAYS]
    return F.coalesce(*found)


def local_text(text: Column) -> Column:
    """The date and time that a camera's string shows; null where from_camera is.

    With an offset as yyyy-MM-ddTHH:mm:ss+HH:MM (Z is +00:00), without one as yyyy-MM-dd HH:mm:ss; a fraction of a second
    that is not 0 follows the seconds, in 3, 6 or 9 digits, whichever hold it; what comes after the ninth goes.
    """
    s = F.btrim(text, F.lit(" \t\r\n\x00"))
    signed = F.regexp_extract(s, r"[+-][0-9]{2}:[0-9]{2}$", 0)
    offset = F.when(signed != "", signed).when(s.rlike("[0-9]Z$"), "+00:00")
    minutes = F.substring(offset, 2, 2).try_cast("long") * 60 + F.substring(offset, 5, 2).try_cast("long")
    shift = F.when(offset.isNull(), 0).when(F.substring(offset, 1, 1) == "-", -minutes).otherwise(minutes)
    at = F.timestamp_seconds(F.floor(from_camera(text) / 1000) + shift * 60)
    digits = F.rpad(F.substring(F.regexp_extract(s, r":[0-9]{2}\.([0-9]+)", 1), 1, 9), 9, "0")
    shown = F.when(digits.endswith("000000"), F.substring(digits, 1, 3)).when(digits.endswith("000"), F.substring(digits, 1, 6)).otherwise(digits)
    fraction = F.when(digits == "000000000", "").otherwise(F.concat(F.lit("."), shown))
    plain = F.concat(F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd HH:mm:ss"), fraction)
    return F.when(offset.isNull(), plain).otherwise(F.concat(F.replace(plain, F.lit(" "), F.lit("T")), offset))


def from_sidecar(json: Column, as_of_year: int) -> Column:
    """Milliseconds of a sidecar's photoTakenTime, else of its creationTime; null if the year is not from 1990 to now."""
    seconds = F.coalesce(*[F.get_json_object(json, f"$.{k}.timestamp").try_cast("long") for k in ("photoTakenTime", "creationTime")])
    year = F.year(F.to_utc_timestamp(F.timestamp_seconds(seconds), F.current_timezone()))
    return F.when(year.between(EARLIEST, as_of_year), seconds * 1000)
