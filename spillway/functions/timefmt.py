"""Reference-time layouts and format names, as Spark columns that parse and print times."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

NAMES = {
    "ansic": "Mon Jan _2 15:04:05 2006", "unixdate": "Mon Jan _2 15:04:05 MST 2006", "rubydate": "Mon Jan 02 15:04:05 -0700 2006",
    "rfc822": "02 Jan 06 15:04 MST", "rfc822z": "02 Jan 06 15:04 -0700", "rfc850": "Monday, 02-Jan-06 15:04:05 MST", "rfc1123": "Mon, 02 Jan 2006 15:04:05 MST",
    "rfc1123z": "Mon, 02 Jan 2006 15:04:05 -0700", "rfc3339": "2006-01-02T15:04:05Z07:00", "rfc3339nano": "2006-01-02T15:04:05.999999999Z07:00", "kitchen": "3:04PM",
    "stamp": "Jan _2 15:04:05", "stampmilli": "Jan _2 15:04:05.000", "stampmicro": "Jan _2 15:04:05.000000", "stampnano": "Jan _2 15:04:05.000000000", "nginx_errorlog": "2006/01/02 15:04:05",
}
UNIX = {"unixtime": 1, "unixtimemilli": 1_000, "unixtimemicro": 1_000_000, "unixtimenano": 1_000_000_000}
_TOKENS = [
    ("January", "MMMM"), ("Monday", "EEEE"), ("2006", "yyyy"), ("Z07:00", "XXX"), ("Z0700", "XX"), ("-07:00", "xxx"), ("-0700", "xx"), ("-07", "x"), ("MST", "z"),
    ("Jan", "MMM"), ("Mon", "EEE"), ("01", "MM"), ("02", "dd"), ("03", "hh"), ("04", "mm"), ("05", "ss"), ("06", "yy"), ("15", "HH"), ("_2", "d"), ("PM", "a"), ("pm", "a"),
    ("1", "M"), ("2", "d"), ("3", "h"), ("4", "m"), ("5", "s"),
]


def known(name: str) -> str:
    """A format's layout: that of a known name, ``unix...`` as it is, or the layout itself."""
    key = name.strip().lower()
    key = {"timestamp": "unixtime", "timestampmilli": "unixtimemilli", "timestampmicro": "unixtimemicro", "timestampnano": "unixtimenano"}.get(key, key)
    return key if key in UNIX else NAMES.get(key, name)


def pattern(layout: str, parsing: bool) -> tuple[str, bool]:
    """(Spark pattern, whether the layout names a weekday); a parsed text loses the weekday."""
    out, i, weekday = "", 0, False
    while i < len(layout):
        if m := re.match(r"([.,])(0+|9+)(?![0-9])", layout[i:]):
            body = m[1] + "S" * len(m[2])
            out += f"[{body}]" if m[2][0] == "9" else body
            i += len(m[0])
            continue
        for text, p in _TOKENS:
            if layout.startswith(text, i):
                i += len(text)
                if p[0] == "E":
                    weekday = True
                    if parsing:
                        i += len(re.match(r",? *", layout[i:])[0])
                        break
                out += p
                break
        else:
            c = layout[i]
            out += f"'{c}'" if c.isalpha() else ("''" if c == "'" else c)
            i += 1
    return out, weekday


def _iso(text: Column) -> Column:
    """RFC 3339 with any fraction."""
    ok = text.rlike(r"(?d)^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})\z")
    short = F.regexp_replace(text, r"([.][0-9]{6})[0-9]+", "$1")
    return F.when(ok, short.try_cast("timestamp"))


def parse(text: Column, fmt: str) -> Column:
    """The time as a timestamp, null where the text hasn't this format. ``text`` is a string."""
    layout = known(fmt)
    if layout in UNIX:
        ok = text.rlike(r"(?d)^-?[0-9]+([.][0-9]*)?\z")
        if layout == "unixtime":
            return F.when(ok, F.timestamp_micros(F.round(text.try_cast("decimal(38,9)") * 1_000_000, 0).try_cast("bigint")))
        whole = F.regexp_extract(text, r"^(-?[0-9]+)", 1).try_cast("bigint")
        micros = {"unixtimemilli": whole * 1_000, "unixtimemicro": whole, "unixtimenano": F.floor(whole / F.lit(1000)).cast("bigint")}[layout]
        return F.when(ok, F.timestamp_micros(micros))
    if layout in (NAMES["rfc3339"], NAMES["rfc3339nano"]):
        return _iso(text)
    p, weekday = pattern(layout, True)
    if weekday:
        text = F.regexp_replace(text, r"^[A-Za-z]+,? +", "")
    if "_2" in layout:
        text = F.regexp_replace(text, " +", " ")
    if "yy" not in p:  # a layout without a year means year 0; Spark needs one
        text, p = F.concat(F.lit("2000 "), text), "yyyy " + p
    return F.try_to_timestamp(text, F.lit(p))


def to_format(ts: Column, fmt: str) -> Column:
    """The time as a whole number (unix formats) or as text."""
    layout = known(fmt)
    if layout in UNIX:
        micros = F.unix_micros(ts)
        return micros * 1000 if UNIX[layout] > 1_000_000 else F.floor(micros / F.lit(1_000_000 // UNIX[layout])).cast("bigint")
    if layout == NAMES["rfc3339nano"]:
        base = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        return F.concat(F.regexp_replace(F.regexp_replace(base, r"([.][0-9]*?)0+$", "$1"), r"[.]$", ""), F.date_format(ts, "XXX"))
    p, _ = pattern(layout, False)
    p = re.sub(r"\[([.,]S+)\]", r"\1", p)
    return F.date_format(ts, re.sub("S{7,}", "SSSSSS", p))
