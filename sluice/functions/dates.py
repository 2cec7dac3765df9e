"""Dates of rules: formats, offsets, parsing. strftime codes throughout."""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta, timezone
from email.utils import parsedate_to_datetime

#: The formats that are tried, in this order, after RFC 3339 and RFC 2822.
WITH_ZONE = (
    "%Y-%m-%dT%H:%M:%S%:z", "%Y-%m-%d %H:%M:%S%:z", "%Y-%m-%dT%H:%M:%S%.f%:z", "%Y-%m-%d %H:%M:%S%.f%:z",
    "%Y-%m-%dT%H:%M:%S%z", "%Y-%m-%d %H:%M:%S%z", "%Y/%m/%d %H:%M:%S%:z", "%Y/%m/%d %H:%M:%S%z",
)
WITHOUT_ZONE = (
    "%Y-%m-%d", "%Y/%m/%d", "%Y%m%d", "%Y-%m-%d %H:%M", "%Y/%m/%d %H:%M", "%Y-%m-%d %H:%M:%S", "%Y/%m/%d %H:%M:%S",
    "%Y-%m-%dT%H:%M", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%dT%H:%M:%S%.f", "%Y-%m-%d %H:%M:%S%.f", "%Y/%m/%d %H:%M:%S%.f",
)

#: The shapes of texts that WITHOUT_ZONE reads, also for Java.
_TIME = r"\d{1,2}:\d{1,2}(?::\d{1,2}(?:\.\d{1,9})?)?"
COMMON = rf"^(?:\d{{7,8}}|\d{{4}}-\d{{1,2}}-\d{{1,2}}(?:[ T]{_TIME})?|\d{{4}}/\d{{1,2}}/\d{{1,2}}(?: {_TIME})?)$"

_CODE = re.compile(r"%(\.?[0-9]?f|:?z|#z|-?[A-Za-z%+])")
_MONTHS = "January February March April May June July August September October November December".split()
_DAYS = "Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split()
#: Regular expression of each code, for reading.
_READ = {
    "Y": r"(?P<Y>\d{4}|[+-]\d{4,6})", "m": r"(?P<m>\d{1,2})", "d": r"(?P<d>\d{1,2})", "e": r"\s*(?P<d>\d{1,2})", "H": r"(?P<H>\d{1,2})", "I": r"(?P<I>\d{1,2})", "M": r"(?P<M>\d{1,2})", "S": r"(?P<S>\d{1,2})",
    "y": r"(?P<y>\d{2})", "j": r"(?P<j>\d{1,3})", "f": r"(?P<f>\d{1,9})", ".f": r"(?:\.(?P<f>\d{1,9}))?", ".3f": r"\.(?P<f>\d{3})", ".6f": r"\.(?P<f>\d{6})", ".9f": r"\.(?P<f>\d{9})",
    "z": r"(?P<z>[+-]\d{2}:?\d{2}|Z)", ":z": r"(?P<z>[+-]\d{2}:?\d{2}|Z)", "#z": r"(?P<z>[+-]\d{2}(?::?\d{2})?|Z)",
    "b": rf"(?P<b>{'|'.join(m[:3] for m in _MONTHS)})", "B": rf"(?P<b>{'|'.join(_MONTHS)})", "a": rf"(?:{'|'.join(d[:3] for d in _DAYS)})", "A": rf"(?:{'|'.join(_DAYS)})",
    "p": r"(?P<p>[AaPp][Mm])", "s": r"(?P<s>-?\d+)", "T": r"(?P<H>\d{1,2}):(?P<M>\d{1,2}):(?P<S>\d{1,2})", "F": r"(?P<Y>\d{4}|[+-]\d{4,6})-(?P<m>\d{1,2})-(?P<d>\d{1,2})", "R": r"(?P<H>\d{1,2}):(?P<M>\d{1,2})", "%": "%",
}
_READ["h"] = _READ["b"]


def offset(text: str) -> timezone | None:
    """UTC, Z, +HH, +HHMM and +HH:MM; no names of zones."""
    if text in ("UTC", "utc", "Z", "z"):
        return UTC
    m = re.fullmatch(r"([+-])(\d{2})(?::?(\d{2}))?", text, re.ASCII)
    if not m or int(m[2]) > 23 or int(m[3] or 0) > 59:
        return None
    d = timedelta(hours=int(m[2]), minutes=int(m[3] or 0))
    return timezone(-d if m[1] == "-" else d)


def is_zone(text: str) -> bool:
    """Whether an argument is meant as a zone."""
    return text.lower() == "utc" or text == "Z" or text[:1] in ("+", "-")


def _pattern(fmt: str) -> re.Pattern | None:
    out, pos = "", 0
    for m in _CODE.finditer(fmt):
        out += re.escape(fmt[pos : m.start()])
        code = m[1].lstrip("-")
        if code not in _READ:
            return None
        out += _READ[code]
        pos = m.end()
    try:
        return re.compile(out + re.escape(fmt[pos:]), re.ASCII | re.IGNORECASE)
    except re.error:  # a field twice
        return None


def shape(fmt: str) -> str | None:
    """A regular expression, also for Java, of the texts that a format reads."""
    p = _pattern(fmt)
    return None if p is None else "^" + re.sub(r"\(\?P<\w>", "(?:", p.pattern) + "$"


def read(text: str, fmt: str) -> datetime | None:
    """One format; the result has a zone if the text has one."""
    p = _pattern(fmt)
    m = p.fullmatch(text) if p else None
    if not m:
        return None
    g = {k: v for k, v in m.groupdict().items() if v is not None}
    try:
        if "s" in g:
            return datetime.fromtimestamp(int(g["s"]), UTC)
        year = int(g["Y"]) if "Y" in g else (2000 if int(g["y"]) < 70 else 1900) + int(g["y"])
        hour = int(g["H"]) if "H" in g else int(g["I"]) % 12 + 12 * (g.get("p", "am").lower() == "pm") if "I" in g else 0
        month = [x[:3].lower() for x in _MONTHS].index(g["b"][:3].lower()) + 1 if "b" in g else int(g.get("m", 1))
        day = int(g.get("d", 1))
        out = datetime(year, month, day, hour, int(g.get("M", 0)), int(g.get("S", 0)), int(g.get("f", "0")[:6].ljust(6, "0")))
        if "j" in g:
            out = out.replace(month=1, day=1) + timedelta(days=int(g["j"]) - 1)
        return out.replace(tzinfo=offset(g["z"])) if "z" in g else out
    except (ValueError, KeyError):
        return None


def parse(text: str, formats: list[str] | None) -> datetime | None:
    """The first format that fits, those with a zone first."""
    if formats is not None:
        return next((d for f in formats if (d := read(text, f))), None)
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})", text):
        if d := read(text.replace("z", "Z"), "%Y-%m-%d" + text[10] + "%H:%M:%S%.f%:z"):
            return d
    if re.match(r"(?:[A-Za-z]{3},\s*)?\d{1,2} [A-Za-z]{3} \d{4} ", text):
        try:
            return parsedate_to_datetime(text)
        except ValueError:
            pass
    return next((d for f in (*WITH_ZONE, *WITHOUT_ZONE) if (d := read(text, f))), None)


def write(d: datetime, fmt: str) -> str | None:
    """strftime; None for an unknown code."""
    z = d.strftime("%z") or "+0000"
    out, pos = "", 0
    for m in _CODE.finditer(fmt):
        out += fmt[pos : m.start()]
        pos = m.end()
        code = m[1]
        bare = code.lstrip("-")
        if code == "%":
            part = "%"
        elif bare in ("z", ":z", "#z"):
            part = z[:3] + (":" if bare == ":z" else "") + z[3:5]
        elif bare == "f":
            part = f"{d.microsecond * 1000:09d}"
        elif bare == ".f":
            part = f".{d.microsecond:06d}".rstrip("0") if d.microsecond else ""
            part = part if len(part) in (0, 4, 7) else "." + (f"{d.microsecond // 1000:03d}" if d.microsecond % 1000 == 0 else f"{d.microsecond:06d}")
        elif re.fullmatch(r"\.?[369]f", bare):
            part = "." * (bare[0] == ".") + f"{d.microsecond * 1000:09d}"[: int(bare[-2])]
        elif bare == "s":
            part = str(int(d.timestamp()))
        elif bare == "e":
            part = f"{d.day:2d}"
        elif bare == "b" or bare == "h":
            part = _MONTHS[d.month - 1][:3]
        elif bare == "B":
            part = _MONTHS[d.month - 1]
        elif bare == "a":
            part = _DAYS[d.weekday()][:3]
        elif bare == "A":
            part = _DAYS[d.weekday()]
        elif bare == "Y":
            part = f"{d.year:04d}"
        elif bare in ("m", "d", "H", "I", "M", "S", "y", "j", "p", "u", "w", "U", "W", "V", "G", "C"):
            part = d.strftime(f"%{bare}")
        elif bare in ("F", "T", "R", "D"):
            part = d.strftime({"F": "%Y-%m-%d", "T": "%H:%M:%S", "R": "%H:%M", "D": "%m/%d/%y"}[bare])
        else:
            return None
        out += part.lstrip("0") or "0" if code.startswith("-") and part.isdigit() else part
    return out + fmt[pos:]
