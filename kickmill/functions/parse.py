"""Tolerant parsing of text cells; what can't be read becomes null, and NaN never survives."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_FIRST = ("dd/MM/yyyy", "dd/MM/yy", "yyyy-MM-dd", "dd-MM-yyyy", "dd.MM.yyyy", "d/M/yyyy", "d/M/yy")
MONTH_FIRST = ("MM/dd/yyyy", "MM/dd/yy", "yyyy-MM-dd", "MM-dd-yyyy", "M/d/yyyy", "M/d/yy")


def present(value: Column) -> Column:
    """The cell, or null if it is empty, blank or a spelled-out NaN."""
    text = F.trim(value.cast("string"))
    return F.when((text != "") & ~F.lower(text).isin("nan", "nat", "none", "null"), text)


def number(value: Column) -> Column:
    x = present(value).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def whole_number(value: Column) -> Column:
    """Non-negative integers, also as ``2.0``."""
    x = number(value)
    return F.when((x >= 0) & (x == F.floor(x)) & (x < 2**31), x.cast("int"))


MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
#: Behind a date: a time of day, perhaps with a zone; around its numbers: names of days, endings of ordinals.
TIME_BEHIND = r"(?:[t ,]+|\s+at\s+)\d{1,2}(?:[:.]\d{2}(?:[:.]\d{2}(?:[.,]\d+)?)?\s*(?:[ap]\.?m\.?)?|\s*[ap]\.?m\.?)\s*(?:z|utc|gmt|[+-]\d{2}:?\d{2})?$"
DAY_NAME = r"\b(?:mon|tue|tues|wed|wednes|thu|thur|thurs|fri|sat|satur|sun)(?:day)?\b\.?,?"
MONTH_NAME = r"(?<![a-z])(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)(?:uary|ruary|ch|il|e|y|ust|t|tember|ober|ember)?(?![a-z])\.?"

#: Whole numbers in the range of a day or month; a year with or without its century; what separates them.
DAYS, ABOVE_12, OF_YEAR, SEP = r"0*(?:[1-9]|[12]\d|3[01])", r"0*(?:1[3-9]|2\d|3[01])", r"0*(?:[1-9]|1[0-2])", r"[\s,./-]"
SHAPES = {"dd": r"(?P<d>0[1-9]|[12]\d|3[01])", "d": f"(?P<d>{DAYS})", "MM": r"(?P<m>0[1-9]|1[0-2])", "M": f"(?P<m>{OF_YEAR})", "yyyy": r"(?P<y>\d{4}|\+\d{5,6}|-\d{4,6})", "yy": r"(?P<y>\d{2})"}
#: Signed years and needless zeros, which only the known layouts read; all else that they accept, the free form reads alike.
ODD = re.compile(r"^[+-]\d{4,}-|[/.-][+-]\d{4,}$|^0\d{2,}/|/0\d{2,}/", re.ASCII)


def any_of(forms: list[str]) -> tuple[re.Pattern, dict[str, list[int]]]:
    """One pattern of several forms, and which of its groups are year, month and day."""
    kinds = [m[1] for m in re.finditer(r"\(\?P<(\w)>", " ".join(forms))]
    return re.compile("|".join(re.sub(r"\(\?P<\w>", "(", f) for f in forms), re.ASCII), {of: [i + 1 for i, k in enumerate(kinds) if k == of] for of in "ymd"}


def layout_forms(layouts: tuple[str, ...]) -> list[str]:
    return [re.sub(r"([a-zA-Z]+)|(.)", lambda m: SHAPES[m[1]] if m[1] else re.escape(m[2]), layout) for layout in layouts]


def free_forms(dayfirst: bool) -> list[str]:
    """Three numbers, two and a month's name, or eight digits."""
    to, few = f"{SEP}+", f"{SEP}*"
    four, short = r"(?P<y>\d{4})(?!\d)", r"(?!\d{4}(?!\d))%s(?P<y>\d{4}|\d{2})"
    day, month, above = (f"(?P<{k}>{x})(?!\\d)" for k, x in (("d", DAYS), ("m", OF_YEAR), ("d", ABOVE_12)))
    pairs = ((day, month), (month, above)) if dayfirst else ((month, day), (above, month))
    forms = [to.join((four, month, day)), to.join((four, above, month)), *[short % "".join(x + to for x in pair) for pair in pairs], r"(?P<y>\d{4})(?P<m>0[1-9]|1[0-2])(?P<d>0[1-9]|[12]\d|3[01])"]
    name = MONTH_NAME.replace("(jan", "(?P<m>jan", 1)
    for before, between, behind in ((name + few, to, ""), ("", few + name + few, ""), ("", to, few + name)):
        forms += [before + four + between + day + behind, before + short % (day + between) + behind]
    return [f"{few}(?:{f}){few}" for f in forms]


LAYOUTS = {True: any_of(layout_forms(DAY_FIRST)), False: any_of(layout_forms(MONTH_FIRST))}
FREE = {x: any_of(free_forms(x)) for x in (True, False)}
#: ``$`` of the JVM: also before a last line break of any kind.
BESIDE = [(re.compile(p.replace("$", r"(?=(?:\r\n|[\n\r\u0085\u2028\u2029])?\Z)"), re.ASCII), to) for p, to in ((TIME_BEHIND, ""), (DAY_NAME, " "), (r"(?<=\d)(?:st|nd|rd|th)\b", ""))]


def days_of(text: str, dayfirst: bool = True) -> int | None:
    """Days since 1970 of a date in one of the known layouts, else in free form."""
    text = text.strip(" ")
    found, groups = ODD.search(text) and LAYOUTS[dayfirst][0].fullmatch(text), LAYOUTS[dayfirst][1]
    if not found:
        plain = text.lower()
        for pattern, to in BESIDE:
            plain = pattern.sub(to, plain)
        found, groups = FREE[dayfirst][0].fullmatch(plain), FREE[dayfirst][1]
    if not found:
        return None
    y, m, d = (next(x for i in groups[of] if (x := found[i]) is not None) for of in "ymd")
    # years 70 to 99 without a century belong to the last one
    year = int(y) + (len(y) == 2) * (1900 if y >= "70" else 2000)
    month, day = MONTHS.index(m) + 1 if m in MONTHS else int(m), int(d)
    if day > (29 if month == 2 and year % 4 == 0 and (year % 100 or year % 400 == 0) else (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)[month - 1]):
        return None
    # counted from March, so that a leap day is a year's last
    year, month = (year - 1, month + 9) if month < 3 else (year, month - 3)
    return 365 * year + year // 4 - year // 100 + year // 400 + (153 * month + 2) // 5 + day - 719469


def day(value: Column, dayfirst: bool = True) -> Column:
    """A date in one of the known layouts, else in free form; two- and four-digit years can't be mistaken for each other.

    Free form: day, month and year as numbers or a month's name, in any order; a time, a zone or a day's name beside them is left out.
    A year has four digits, or is the last of the numbers.  Of two numbers that could both be the month, ``dayfirst`` tells which is
    the day; if only one can, that one is the month.  Eight digits alone are year, month, day.  Anything else beside is no date.

    Each text of a batch is read once, however often it is there; as column expressions, a dozen patterns a cell cost far more.
    """

    @F.arrow_udf("int")
    def days(texts: pa.Array) -> pa.Array:
        coded = texts.dictionary_encode()
        return pa.array([days_of(t, dayfirst) for t in coded.dictionary.to_pylist()], pa.int32()).take(coded.indices)

    return F.date_from_unix_date(days(value.cast("string")))


TIME = r"^(?:\d{4}-\d{2}-\d{2}[t ])?(\d{1,2})(?:[:.h](\d{2})(?:[:.]\d{2}(?:[.,]\d+)?)?)?\s*(?:([ap])\.?m\.?)?\s*(?:z|utc|gmt|[+-]\d{2}:?\d{2})?$"


def time_of_day(value: Column) -> Column:
    """``HH:mm`` of a time with or without seconds: 24 hours, or twelve with am or pm (``2pm``), also ``14.30`` and instants."""
    text = F.lower(present(value))
    part = lambda i: F.regexp_extract(text, TIME, i)
    hour, minute, half = part(1).try_cast("int"), F.when(part(2) == "", 0).otherwise(part(2).try_cast("int")), part(3)
    told = (part(2) != "") | (half != "")
    of_day = F.when(half == "", hour).when((hour >= 1) & (hour <= 12), hour % 12 + F.when(half == "p", 12).otherwise(0))
    return F.when(told & (of_day < 24) & (minute < 60), F.format_string("%02d:%02d", of_day, minute))


def kickoff_utc(date: Column, time: Column, timezone: str = "Europe/Berlin") -> Column:
    """Local date and time as a UTC instant without zone; null without a time, never midnight."""
    local = F.to_timestamp_ntz(F.concat_ws(" ", date.cast("string"), time), F.lit("yyyy-MM-dd HH:mm"))
    return F.when(date.isNotNull() & time.isNotNull(), F.convert_timezone(F.lit(timezone), F.lit("UTC"), local))


def dedupe_key(league: Column, home: Column, away: Column, date: Column, kickoff: Column) -> Column:
    """League, teams, local date and UTC time (``NA`` if unknown), joined by a pipe."""
    return F.concat_ws("|", league.cast("string"), home.cast("string"), away.cast("string"), date.cast("string"), F.coalesce(F.date_format(kickoff, "HH:mm"), F.lit("NA")))
