"""What a log file's name says: its database, its time, and the labels of time buckets."""

from __future__ import annotations

import datetime
import glob as globbing
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unit -> pattern of its label.
BUCKETS = {"minute": "yyyy-MM-dd'T'HH:mm:ss", "hour": "yyyy-MM-dd'T'HH", "day": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}
PARTS = ("year", "month", "day", "hour", "minute")
#: Default finer unit of each unit.
FINER = {"year": "month", "month": "day", "day": "hour"}


def expand_template(template: str, match: re.Match) -> str:
    """Replaces $name, ${name}, $1 and $$; the longest name counts and unknown ones give nothing."""

    def value(m: re.Match) -> str:
        name = m[1] or m[2]
        if m[0] == "$$":
            return "$"
        try:
            return match[int(name) if name.isdigit() else name] or ""
        except IndexError:
            return ""

    return re.sub(r"\$\$|\$\{(\w+)\}|\$([A-Za-z0-9_]+)", value, template)


def to_database(filename: str, regex: str, template: str) -> str:
    """The database of a file. Raises ValueError where the name doesn't match or gives nothing."""
    match = re.search(regex, filename)
    if not match:
        raise ValueError(f'filename_to_database_regex did not match "{filename}"')
    out = expand_template(template, match)
    if not out:
        raise ValueError(f'no database name for "{filename}"')
    return out


def _java(regex: str) -> str:
    """Named groups as Java writes them."""
    return regex.replace("(?P<", "(?<")


def database_column(filename: Column | str, regex: str, template: str) -> Column:
    """to_database as a column, null where the name doesn't match; named and numbered groups."""
    c = F.col(filename) if isinstance(filename, str) else filename
    own = re.compile(regex)
    pieces, at = [], 0
    for m in re.finditer(r"\$\$|\$\{(\w+)\}|\$([A-Za-z0-9_]+)", template):
        pieces.append(F.lit(template[at : m.start()]))
        name, at = m[1] or m[2], m.end()
        if m[0] == "$$":
            pieces.append(F.lit("$"))
            continue
        group = int(name) if name.isdigit() else own.groupindex.get(name)
        pieces.append(F.regexp_extract(c, _java(regex), group) if group is not None and group <= own.groups else F.lit(""))
    pieces.append(F.lit(template[at:]))
    return F.when(c.rlike(_java(regex)), F.concat(*pieces))


def to_time(filename: str, regex: str | None) -> datetime.datetime:
    """The time a name carries, UTC. Missing parts are 0 and parts beyond their range carry over."""
    match = re.search(regex, filename) if regex else None
    if not match:
        raise ValueError(f'filename_to_time_regex did not match "{filename}"' if regex else "filename_to_time_regex not defined")
    groups = match.groupdict()
    year, month, day, hour, minute = (int(groups.get(p) or 0) if (groups.get(p) or "0").isdigit() else 0 for p in PARTS)
    years, months = divmod(year * 12 + month - 1, 12)
    first = datetime.datetime(years, months + 1, 1, tzinfo=datetime.timezone.utc)
    return first + datetime.timedelta(days=day - 1, hours=hour, minutes=minute)


def time_column(filename: Column | str, regex: str) -> Column:
    """to_time as a column, null where the name doesn't match."""
    c = F.col(filename) if isinstance(filename, str) else filename
    index = re.compile(regex).groupindex

    def part(name: str) -> Column:
        if name not in index:
            return F.lit(0)
        return F.coalesce(F.regexp_extract(c, _java(regex), index[name]).try_cast("int"), F.lit(0))

    year, month, day, hour, minute = (part(p) for p in PARTS)
    date = F.date_add(F.add_months(F.make_date(year, F.lit(1), F.lit(1)), month - 1), day - 1)
    at = F.timestamp_seconds(F.unix_date(date).cast("long") * 86400 + hour.cast("long") * 3600 + minute.cast("long") * 60)
    return F.when(c.rlike(_java(regex)), at)


def bucket_pattern(unit: str) -> str:
    if unit not in BUCKETS:
        raise ValueError(f"Invalid truncation period: {unit}")
    return BUCKETS[unit]


def bucket(time: Column | str, unit: str) -> Column:
    """The label of a time's bucket."""
    return F.date_format(time, bucket_pattern(unit))


def parse_bucket(text: str) -> tuple[str, str]:
    """(unit of the buckets, unit that is counted in them) of a parameter such as "", "day" or "month/hour"."""
    parts = text.split("/")
    if len(parts) > 2:
        raise ValueError(f"Invalid bucket parameter: {text}")
    if len(parts) == 2:
        return parts[0], parts[1]
    return ("month", "day") if not text else (text, FINER.get(text, ""))


def expand_glob(pattern: str) -> list[str]:
    """Matching paths in lexical order."""
    return sorted(globbing.glob(pattern))


def recent_globs(pattern: str, now: datetime.datetime) -> list[str]:
    """Paths of yesterday's and today's names, in that order, each once."""
    days = (now - datetime.timedelta(days=1), now)
    return list(dict.fromkeys(path for day in days for path in expand_glob(day.strftime(pattern))))
