"""Column functions: sizes, file kinds, names, dates."""

from __future__ import annotations

import fnmatch
import re
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The suffixes searched by default.
IMAGE_SUFFIXES = ("jpg", "jpeg", "jpe", "png", "gif", "tif", "tiff", "webp", "bmp", "heic", "heif", "avif", "jp2", "dng", "cr2", "nef", "arw", "orf", "rw2", "raf", "psd", "ico")
VIDEO_SUFFIXES = ("mp4", "mov", "m4v", "webm", "mkv")
#: Units of a relative age; the forms of a date, with or without a time.
AGE_UNITS = {"s": "seconds", "m": "minutes", "h": "hours", "d": "days", "w": "weeks"}
DATE = re.compile(r"(\d{4})-(\d\d?)-(\d\d?)(?:[ T](\d\d?):(\d\d?)(?::(\d\d?))?)?")
AGE = re.compile(r"(\d+(?:\.\d+)?)\s*([smhdw])", re.IGNORECASE)


def human_size(size: Column) -> Column:
    """A size in B, KB, MB or GB; one decimal from KB on, ties to even."""

    def one(unit: int) -> Column:
        return F.format_string("%.1f", F.bround(size / F.lit(float(1024**unit)), 1))

    return F.when(size < 1024, F.concat(F.format_string("%d", size.cast("long")), F.lit(" B"))).when(size < 1024**2, F.concat(one(1), F.lit(" KB"))).when(size < 1024**3, F.concat(one(2), F.lit(" MB"))).otherwise(F.concat(one(3), F.lit(" GB")))


def suffix(path: Column) -> Column:
    """The suffix of a path in lower case, without its dot; empty for names that only start with one."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*\.([^./]*)$", 1))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def matches_glob(name: Column, pattern: str) -> Column:
    """Whether a name matches a shell pattern, whatever the case."""
    body = fnmatch.translate(pattern.lower()).replace(r"\z", "").replace(r"\Z", "")
    return F.lower(name).rlike("^" + re.sub(r"^\(\?s:(.*)\)$", r"(?s:\1)", body) + "$")


def parse_when(text: str, end_of_day: bool = False, now: datetime | None = None) -> datetime:
    """A date, a date and time, or an age such as 30m, 12h, 3d, 1.5w before now. A bare date as an end is the midnight after it."""
    if date := DATE.fullmatch(text.strip()):
        parts = [int(x) for x in date.groups() if x is not None]
        return datetime(*parts) + timedelta(days=int(end_of_day and len(parts) == 3))
    if age := AGE.fullmatch(text.strip()):
        return (now or datetime.now()) - timedelta(**{AGE_UNITS[age[2].lower()]: float(age[1])})
    raise ValueError(f"{text!r} is neither a date nor an age")


def _starts(head: Column, *values: bytes) -> Column:
    found = F.lit(False)
    for v in values:
        found = found | (F.substring(head, 1, len(v)) == F.lit(v))
    return found


#: What a file that can't be read seems to hold, by its first bytes, in the order they are tried.
SIGNATURES = ((b"\x89PNG\r\n\x1a\n", "PNG, damaged or cut short"), (b"\xff\xd8\xff", "JPEG, damaged or cut short"), (b"GIF8", "GIF, damaged or cut short"))
EMPTY, ZEROS, WEBP, CONTAINER = "empty file", "only zero bytes (never finished writing?)", "WebP, damaged or cut short", "HEIC / AVIF / video container"
MARKUP, JSON_TEXT, PLAIN, UNKNOWN = "HTML or XML text (an error page saved as an image?)", "JSON text", "plain text", "unrecognised content"


def describe_unreadable(head: Column, size: Column) -> Column:
    """``category; details; size`` from a file's first 64 bytes and its size."""
    digits = F.hex(head)
    bare = F.regexp_replace(digits, "^(?:09|0A|0B|0C|0D|20)+", "")
    category = F.when(size == 0, EMPTY).when(digits.rlike("^(?:00)*$"), ZEROS).when((F.substring(head, 1, 4) == F.lit(b"RIFF")) & (F.substring(head, 9, 4) == F.lit(b"WEBP")), WEBP).when(F.substring(head, 5, 4) == F.lit(b"ftyp"), CONTAINER)
    for magic, name in SIGNATURES:
        category = category.when(_starts(head, magic), name)
    category = category.when(bare.startswith("3C"), MARKUP).when(bare.startswith("7B") | bare.startswith("5B"), JSON_TEXT).when(digits.rlike("^(?:09|0A|0D|[2-6][0-9A-F]|7[0-9A-E])*$"), PLAIN).otherwise(UNKNOWN)
    shown = F.trim(F.regexp_replace(F.lower(F.hex(F.substring(head, 1, 8))), "(..)", "$1 "))
    details = F.when(category == CONTAINER, F.concat(F.lit("brand "), F.trim(F.decode(F.substring(head, 9, 4), "ISO-8859-1")))).when(category == UNKNOWN, F.concat(F.lit("starts "), shown))
    return F.concat_ws("; ", category, details, human_size(size))


def broken_reason(error: Column) -> Column:
    """The category in an error's brackets."""
    found = F.regexp_extract(error, r"\[([^\];]+)", 1)
    return F.when(found == "", "unreadable").otherwise(found)
