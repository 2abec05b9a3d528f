"""Parsers and formatters for the strings of a photo library. None of them fails: what does not parse is NULL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the formats in which libraries store rectangles and dates
RECT = r'^\s*<rect x="(\d+)" y="(\d+)" width="(\d+)" height="(\d+)"/>\s*\z'
FOLDER_DATE = r"^/(\d{4}-\d{2}-\d{2})"
FILENAME_DATES = (
    r"(\d{4})-(\d{2})-(\d{2})[ _T](\d{2})[.:](\d{2})[.:](\d{2})",
    r"(\d{4})(\d{2})(\d{2})_(\d{2})(\d{2})(\d{2})",
    r"(\d{4})-(\d{2})-(\d{2})",
)
#: A directive takes one or two digits; a blank stands for any run of white space.
LIBRARY_DATE = r"^(\d{4})-(\d{1,2})-(\d{1,2})(?:\s+(\d{1,2}):(\d{1,2}):(\d{1,2}))?\z"
EXIF_DATES = (r"^(\d{4}):(\d{1,2}):(\d{1,2})\s+(\d{1,2}):(\d{1,2}):(\d{1,2})\z", r"^(\d{4})-(\d{1,2})-(\d{1,2})\s+(\d{1,2}):(\d{1,2}):(\d{1,2})\z", r"^(\d{4}):(\d{1,2}):(\d{1,2})\z")


def _group(text: Column, pattern: str, k: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, k), F.lit(""))


def _with(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` computed once, however often ``then`` names it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _timestamp(text: Column, pattern: str, time: bool) -> Column:
    """The first match as a timestamp without zone; NULL unless every part is in range (a second of 60 is not).

    The pattern is matched once; its parts are the runs of digits in the match.
    """
    parts = F.transform(F.split(F.nullif(F.regexp_extract(text, pattern, 0), F.lit("")), "[^0-9]+"), lambda p: p.try_cast("int"))
    return _with(parts, _made if time else lambda p: _made(F.slice(p, 1, 3)))


def _made(p: Column) -> Column:
    h, mi, s = (F.coalesce(F.get(p, F.lit(k)), F.lit(0)) for k in (3, 4, 5))
    return F.when((F.get(p, F.lit(0)) >= 1) & (s < 60), F.try_make_timestamp_ntz(F.get(p, F.lit(0)), F.get(p, F.lit(1)), F.get(p, F.lit(2)), h, mi, s.cast("decimal(16,6)")))


def _run_of_digits(text: Column, pattern: str) -> Column:
    """The same for a pattern whose match is eight digits, a mark and six digits."""
    found = F.nullif(F.regexp_extract(text, pattern, 0), F.lit(""))
    parts = lambda m: F.array(*(F.substring(m, a, n).try_cast("int") for a, n in ((1, 4), (5, 2), (7, 2), (10, 2), (12, 2), (14, 2))))
    return _with(found, lambda m: F.when(m.isNotNull(), _with(parts(m), _made)))


def is_rect(xml: Column) -> Column:
    """Whether the whole string is a face rectangle."""
    return xml.rlike(RECT)


def rect(xml: Column) -> Column:
    """struct(x, y, width, height) of a face rectangle, NULL unless the whole string is one."""
    return F.when(is_rect(xml), _with(F.split(xml, '"'), _sides))


def sides(xml: Column) -> Column:
    """:func:`rect` of a string that :func:`is_rect` holds for."""
    return _sides(F.split(xml, '"'))


def _sides(p: Column) -> Column:
    return F.struct(*(F.get(p, F.lit(k)).try_cast("long").alias(n) for k, n in zip((1, 3, 5, 7), ("x", "y", "width", "height"), strict=True)))


def folder_date(album_path: Column) -> Column:
    """The date an album path begins with, behind its slash."""
    found = _group(album_path, FOLDER_DATE, 1)
    return F.when(F.substring(found, 1, 4) != "0000", F.try_to_date(found, "yyyy-MM-dd"))


def filename_date(name: Column) -> Column:
    """The first pattern whose leftmost match is a valid date decides."""
    return F.coalesce(_timestamp(name, FILENAME_DATES[0], True), _run_of_digits(name, FILENAME_DATES[1]), _timestamp(name, FILENAME_DATES[2], False))


def library_date(raw: Column) -> Column:
    """A date of the library's database: cut at the first dot, T for a blank, time optional."""
    return _timestamp(F.replace(F.substring_index(raw, ".", 1), F.lit("T"), F.lit(" ")), LIBRARY_DATE, True)


def exif_date(raw: Column) -> Column:
    """A date of an image's metadata, in any of three formats."""
    text = F.regexp_replace(raw, r"^\s+|\s+\z", "")
    return F.coalesce(_timestamp(text, EXIF_DATES[0], True), _timestamp(text, EXIF_DATES[1], True), _timestamp(text, EXIF_DATES[2], False))


def exif_tags_date(original: Column, digitized: Column, image: Column) -> Column:
    """The first of three tags that parses: an unparsable tag gives way as a missing one does."""
    return F.coalesce(exif_date(original), exif_date(digitized), exif_date(image))


def full_path(root: Column, album_path: Column, name: Column) -> Column:
    joined = F.concat_ws("/", F.when(root == "/", F.lit("")).otherwise(F.rtrim(root, F.lit("/"))), F.nullif(F.trim(album_path, F.lit("/")), F.lit("")), name)
    return F.regexp_replace(joined, "/{2,}", "/")


def html_escape(text: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def percent(share: Column) -> Column:
    """A whole percentage, halves to even."""
    return F.concat(F.bround(share * 100, 0).cast("long").cast("string"), F.lit("%"))


def display_date(library: Column, folder: Column) -> Column:
    """The date a gallery shows: the database's, else the folder's, else nothing."""
    return F.coalesce(F.date_format(library, "yyyy-MM-dd"), F.date_format(folder, "yyyy-MM-dd"), F.lit(""))


def tooltip(name: Column, confidence: Column, date: Column) -> Column:
    parts = F.array(F.coalesce(name, F.lit("")), F.concat(F.lit("conf "), percent(confidence)), F.coalesce(date, F.lit("")))
    return F.array_join(F.filter(parts, lambda p: p != ""), " | ")


def or_dash(text: Column) -> Column:
    return F.coalesce(text, F.lit("—"))


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def present(text: Column) -> Column:
    """Neither NULL nor empty."""
    return F.coalesce(text, F.lit("")) != ""
