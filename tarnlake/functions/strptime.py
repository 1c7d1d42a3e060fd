"""strptime formats as regular expressions over fields, and civil time to UTC microseconds, without per-row datetime parsing."""

from __future__ import annotations

import re
from datetime import date, datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

# English names and the offsets of common zone abbreviations in minutes.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
DAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "Z": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "IST": 330, "JST": 540, "KST": 540, "AEST": 600, "AEDT": 660, "ACST": 570, "ACDT": 630, "AWST": 480,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
}

FIELDS = {
    "Y": r"(?P<Y>\d{4})", "y": r"(?P<y>\d{2})", "m": r"(?P<m>\d{1,2})", "d": r"(?P<d>\d{1,2})", "e": r"\s*(?P<d>\d{1,2})",
    "j": r"(?P<j>\d{1,3})", "H": r"(?P<H>\d{1,2})", "I": r"(?P<I>\d{1,2})", "M": r"(?P<M>\d{1,2})", "S": r"(?P<S>\d{1,2})",
    "f": r"(?P<f>\d{1,9})", "p": r"(?P<p>[AaPp][Mm])", "z": r"(?P<z>[Zz]|[+-]\d{2}:?\d{2})", "Z": r"(?P<Z>[A-Za-z]+)",
    "b": r"(?P<b>[A-Za-z]{3,9})", "B": r"(?P<b>[A-Za-z]{3,9})", "h": r"(?P<b>[A-Za-z]{3,9})", "a": r"(?P<a>[A-Za-z]{3,9})", "A": r"(?P<a>[A-Za-z]{3,9})",
    "s": r"(?P<s>[+-]?\d+)", "%": "%", "n": r"\s*", "t": r"\s*",
}
SHORTHAND = {"T": "%H:%M:%S", "R": "%H:%M", "D": "%m/%d/%y", "F": "%Y-%m-%d", "r": "%I:%M:%S %p", "c": "%a %b %e %H:%M:%S %Y"}

#: A full date and time with offset: the only form taken whatever the declared format.
ISO = re.compile(r"(?P<Y>\d{4})-(?P<m>\d{2})-(?P<d>\d{2})[Tt ](?P<H>\d{2}):(?P<M>\d{2})(?::(?P<S>\d{2})(?:[.,](?P<f>\d{1,9}))?)?\s?(?P<z>[Zz]|[+-]\d{2}:?\d{2})", re.ASCII)
EPOCH = re.compile(r"(?P<s>\d+)(?:\.(?P<f>\d{1,9}))?", re.ASCII)
LOW, HIGH = 946_684_800, 2_524_608_000  # 2000-01-01 and 2050-01-01 in seconds


@lru_cache(maxsize=4096)
def compile_format(fmt: str) -> re.Pattern | None:
    """The format as a pattern for fullmatch; None if it uses a directive that is not supported or none at all."""
    for _ in range(2):
        fmt = re.sub(r"%([TRDFrc])", lambda m: SHORTHAND[m[1]], fmt)
    out, seen, i = [], set(), 0
    while i < len(fmt):
        if fmt[i] == "%" and i + 1 < len(fmt):
            code = fmt[i + 1]
            if code not in FIELDS:
                return None
            piece = FIELDS[code]
            name = piece[piece.find("<") + 1 : piece.find(">")] if "<" in piece else ""
            if name in seen:
                piece = piece.replace(f"?P<{name}>", "?:")
            seen.add(name)
            out.append(piece)
            i += 2
        elif fmt[i].isspace():
            out.append(r"\s*" if fmt[i + 1 : i + 3] == "%e" else r"\s+")
            i += 1
        else:
            out.append(re.escape(fmt[i]))
            i += 1
    return re.compile("".join(out), re.ASCII) if seen - {""} else None


#: What ``java_pattern`` gives for a format that is an epoch number in seconds.
EPOCH_SECONDS = "%s"
# Spark datetime letters of strptime directives.
JAVA = {
    "Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "e": "d", "j": "DDD", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "f": "SSSSSS", "p": "a", "z": "xx", "Z": "z",
    "b": "MMM", "B": "MMMM", "h": "MMM", "a": "EEE", "A": "EEEE", "n": " ", "t": " ", "%": "'%'",
}


def java_pattern(fmt: str) -> str:
    """The format as a Spark datetime pattern, for JVM-side parsing of a format known in advance; EPOCH_SECONDS if it is %s alone. Other directives are refused."""
    for _ in range(2):
        fmt = re.sub(r"%([TRDFrc])", lambda m: SHORTHAND[m[1]], fmt)
    if fmt.strip() == EPOCH_SECONDS:
        return EPOCH_SECONDS
    unknown = [d for d in re.findall(r"%(.)", fmt) if d not in JAVA]
    if unknown:
        raise ValueError(f"directives {unknown} of {fmt!r} are not supported at ingest")
    return re.sub(r"%(.)|([A-Za-z]+)|(')", lambda m: JAVA[m[1]] if m[1] else (f"'{m[2]}'" if m[2] else "''"), fmt)


def number_to_us(number: int, fraction: str | None = None) -> int | None:
    """An epoch number in the unit (s, ms, us, ns) that puts it in 2000 to 2049, as microseconds; digits finer than that are cut off."""
    for scale in (1, 1_000, 1_000_000, 1_000_000_000):
        if LOW * scale <= number < HIGH * scale:
            digits = f"{number}{fraction or ''}"
            point = len(str(number)) - len(str(scale)) + 1 + 6
            return int(digits[:point].ljust(point, "0"))
    return None


@lru_cache(maxsize=1024)
def zone(name: str | None) -> ZoneInfo | None:
    try:
        return ZoneInfo(name or "UTC")
    except Exception:  # an unknown name gives no zone
        return None


@lru_cache(maxsize=65536)
def wall_offsets(name: str | None, year: int, month: int, day: int, hour: int, minute: int) -> tuple[int, ...]:
    """Seconds east of UTC of the instants with this wall time in the zone, the earlier first; none if the time did not occur."""
    z = zone(name)
    if z is None:
        return ()
    wall = datetime(year, month, day, hour, minute)
    found = []
    for fold in (0, 1):
        offset = wall.replace(tzinfo=z, fold=fold).utcoffset()
        utc = (wall - offset).replace(tzinfo=timezone.utc)
        if utc.astimezone(z).replace(tzinfo=None) == wall:
            found.append(int(offset.total_seconds()))
    return tuple(sorted(set(found), reverse=True))


@lru_cache(maxsize=65536)
def day_offset(name: str | None, year: int, month: int, day: int) -> int | None:
    """Seconds east of UTC all through a day of the zone; None if its clock is put forward or back on that day or next to it, or the zone is unknown."""
    z = zone(name)
    if z is None or year < 2 or year > 9998:
        return None
    noon = datetime(year, month, day, 12)
    found = {(noon + timedelta(hours=h)).replace(tzinfo=z, fold=fold).utcoffset() for h in (-24, -12, 0, 12, 24) for fold in (0, 1)}
    return int(found.pop().total_seconds()) if len(found) == 1 else None


@lru_cache(maxsize=65536)
def days_of(year: int, month: int, day: int) -> int | None:
    try:
        return date(year, month, day).toordinal() - 719_163
    except ValueError:
        return None


def _offset(text: str) -> int | None:
    if text in "Zz":
        return 0
    h, m = int(text[1:3]), int(text[-2:])
    if h > 18 or m > 59:
        return None
    return (h * 3600 + m * 60) * (-1 if text[0] == "-" else 1)


#: Nothing that the fields of a timestamp may stand for.
NO_READING = (None, None, ())


def instant(match: re.Match, zone_name: str | None, closed_us: int | None) -> int | None:
    """UTC microseconds of a matched timestamp, or None if its fields give none.

    A time without zone is in ``zone_name`` (None: UTC). Of two instants with the same wall time the earlier holds; a wall time
    that was skipped has none. Without a year it has the latest year that does not put it after ``closed_us``.
    """
    return readings(match, zone_name, closed_us)[0]


#: A date and time in some order of year, month and day, with or without zone; the order is told by the source, not by the text.
FREE = re.compile(
    r"(?:[A-Za-z]{3,9},?\s+)?(?P<a>\d{1,4}|[A-Za-z]{3,9})(?P<x>[-/.\s])\s*(?P<b2>\d{1,2}|[A-Za-z]{3,9}),?(?P=x)\s*(?P<c>\d{4}|\d{1,2})[T:\s]\s*"
    r"(?P<H>\d{1,2}):(?P<M>\d{2})(?::(?P<S>\d{2})(?:[.,](?P<f>\d{1,9}))?)?\s*(?P<p>[AaPp][Mm])?\s*(?P<z>[Zz]\b|[+-]\d{2}:?\d{2})?(?P<Z>[A-Za-z]{2,5})?",
    re.ASCII,
)
ORDERS = ("ymd", "dmy", "mdy")


def ordered_fields(match: re.Match, order: str) -> dict | None:
    """The fields of a FREE date read in an order of ORDERS; None if a part cannot stand where the order puts it."""
    g = match.groupdict()
    part = dict(zip(order, (g["a"], g["b2"], g["c"])))
    year, month, day = part["y"], part["m"], part["d"]
    if not year.isdigit() or len(year) not in (2, 4) or not day.isdigit() or len(day) > 2 or (month.isdigit() and len(month) > 2):
        return None
    fields = {k: g[k] for k in ("H", "M", "S", "f", "p", "z", "Z")}
    if g["p"] is not None:
        fields["I"] = g["H"]
    return fields | {"Y" if len(year) == 4 else "y": year, "m" if month.isdigit() else "b": month, "d": day}


def readings(match: re.Match, zone_name: str | None, closed_us: int | None) -> tuple[int | None, int | None, tuple[int, ...]]:
    """What ``instant`` gives, the later instant of the same wall time, and the instants in earlier years of a time without year."""
    return of_fields(match.groupdict(), zone_name, closed_us)


def of_fields(g: dict, zone_name: str | None, closed_us: int | None) -> tuple[int | None, int | None, tuple[int, ...]]:
    """``readings`` of the fields of a timestamp."""
    if g.get("s") is not None:
        return number_to_us(int(g["s"]), g.get("f")), None, ()
    if g.get("p") is not None:
        hour = int(g["I"] if g.get("I") is not None else g["H"])
        if g.get("I") is not None:
            if not 1 <= hour <= 12:
                return NO_READING
            hour = hour % 12 + (12 if g["p"][0] in "Pp" else 0)
    else:
        hour = int(g.get("H") or g.get("I") or 0)
    minute, second = int(g.get("M") or 0), int(g.get("S") or 0)
    if hour > 23 or minute > 59 or second > 59:
        return NO_READING
    micro = int((g.get("f") or "0")[:6].ljust(6, "0"))
    month, day = 1, 1
    if g.get("b"):
        if g["b"][:3].lower() not in MONTHS:
            return NO_READING
        month = MONTHS.index(g["b"][:3].lower()) + 1
    elif g.get("m"):
        month = int(g["m"])
    if g.get("d"):
        day = int(g["d"])
    if g.get("a") and g["a"][:3].lower() not in DAYS:
        return NO_READING

    def at(year: int) -> tuple[bool, list[int]]:
        """Whether the year has the day, and the instants in it."""
        if g.get("j"):
            n, first, nxt = int(g["j"]), days_of(year, 1, 1), days_of(year + 1, 1, 1)
            if first is None or nxt is None or not 1 <= n <= nxt - first:
                return False, []
            days = first + n - 1
        else:
            days = days_of(year, month, day)
            if days is None:
                return False, []
        if g.get("z") is not None:
            offsets = (_offset(g["z"]),)
        elif g.get("Z") is not None and g["Z"].upper() in ABBREVIATIONS:
            offsets = (ABBREVIATIONS[g["Z"].upper()] * 60,)
        else:
            d = date.fromordinal(days + 719_163)
            whole = day_offset(zone_name, d.year, d.month, d.day)
            offsets = (whole,) if whole is not None else wall_offsets(zone_name, d.year, d.month, d.day, hour, minute)
        return True, [(days * 86_400 + hour * 3_600 + minute * 60 + second - o) * 1_000_000 + micro for o in offsets if o is not None]

    if g.get("Y") or g.get("y"):
        y = int(g.get("Y") or g["y"])
        _, us = at(y if g.get("Y") else y + (1900 if y >= 69 else 2000))
        return (us[0], us[1] if len(us) > 1 else None, ()) if us else NO_READING
    if closed_us is None:
        return NO_READING
    latest, earlier = None, []
    last = (datetime(1970, 1, 1) + timedelta(microseconds=closed_us)).year + 1
    for year in range(last, last - 10, -1):
        has, us = at(year)
        if not has:
            continue
        if latest is not None:
            earlier += us
            continue
        if not us:
            # A skipped wall time: it belongs to this year if the clock had passed it by the time the file was closed.
            wall = (days_of(year, month, day) * 86_400 + hour * 3_600 + minute * 60) * 1_000_000
            if wall - 14 * 3_600_000_000 <= closed_us:
                return NO_READING
            continue
        if us[0] <= closed_us:
            latest = us
    if latest is None:
        return NO_READING
    return latest[0], latest[1] if len(latest) > 1 else None, tuple(earlier)
