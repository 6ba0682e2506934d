"""Scalar canonicalisation of listings as Column expressions: sizes, dates, magnets, hashes, text.

All stay inside generated code; a failed parse is null, never an error. ``now_ms`` is always given, so that
results are reproducible.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = r"[\s\x0B\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
_STEP = 1024
UNITS = ["B", "KB", "MB", "GB", "TB", "PB"]


def trim(c: Column) -> Column:
    """Without white space at both ends, Unicode's included."""
    return F.regexp_replace(c, f"^{_SPACE}+|{_SPACE}+$", "")


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def parse_size(text: Column, number: Column | None = None) -> Column:
    """'1.2 GB' to bytes, binary units; an already numeric size wins; unknown units give null."""
    shape = r"^([\d.]+)" + _SPACE + r"*([A-Za-z]+)?$"
    s = F.regexp_replace(trim(text), ",", "")
    digits = F.regexp_extract(F.regexp_extract(s, shape, 1), r"^(\d+\.?\d*|\.\d+)", 1)
    unit = F.upper(F.regexp_extract(s, shape, 2))
    power = F.when(unit.isin("", "B"), 0)
    for i, letter in enumerate("KMGTP", 1):
        power = power.when(unit.isin(letter, f"{letter}B", f"{letter}IB"), i)
    size = F.floor(F.expr("0.5D") + digits.try_cast("double") * F.pow(F.lit(float(_STEP)), power)).cast("long")
    return size if number is None else F.coalesce(number, size)


def _rounded(n: Column, unit: int) -> Column:
    """n / unit to the nearest integer, half up, in integers; nothing is added to n, which may be the largest long."""
    return F.call_function("div", n, F.lit(unit)) + F.when(n % unit >= unit // 2, 1).otherwise(0)


def format_size(size: Column) -> Column:
    """Bytes, a long or a decimal without places, to text: no decimals from 100 of a unit on and for bytes, else one; exact, half up."""
    out = F.when(size.isNull(), "—").when(size < _STEP, F.concat(size.cast("string"), F.lit(" B")))
    for i, unit in enumerate(UNITS[1:], 1):
        u = _STEP**i
        tenths = _rounded(size * 10, u)
        short = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))
        text = F.concat(F.when(size >= 100 * u, _rounded(size, u).cast("string")).otherwise(short), F.lit(f" {unit}"))
        out = out.when(size < u * _STEP, text) if unit != UNITS[-1] else out.otherwise(text)
    return out


# Milliseconds of the units of relative dates.
_AGO_MS = {"min": 60_000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000, "week": 604_800_000, "month": 2_629_800_000, "year": 31_536_000_000}


def _absolute_ms(s: Column) -> Column:
    """The absolute formats that sources use: ISO dates and date-times, year first with slashes, month first as number or name, RFC 1123, 'd MMM yy', the text of a JavaScript date, a month or a year alone;
    with a zone or without, times also of twelve hours."""
    bare = F.regexp_replace(s, r"^(?i:Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*,?\s+", "")
    tries = [F.try_to_timestamp(s, F.lit(p)) for p in ("yyyy-MM-dd'T'HH:mm[:ss][.SSS]XXX", "yyyy-MM-dd'T'HH:mm[:ss][.SSS]", "yyyy-MM-dd[ HH:mm[:ss][ z]]", "yyyy-MM-dd HH:mm[:ss][ ]XX", "yyyy/M/d[ HH:mm[:ss]]", "M/d/yyyy[ HH:mm[:ss]]", "M/d/yyyy[,] h:mm[:ss] a", "yyyy-MM", "yyyy")]
    tries += [F.try_to_timestamp(bare, F.lit(p)) for p in ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z", "d MMM yyyy[ HH:mm[:ss]]", "d MMM yy", "d MMMM yyyy[ HH:mm[:ss]]", "MMM d, yyyy[ HH:mm[:ss]]", "MMM d yyyy[ HH:mm[:ss]]", "MMMM d, yyyy[ HH:mm[:ss]]", "MMMM d yyyy[ HH:mm[:ss]]", "MMM d, yyyy[,] h:mm[:ss] a", "MMMM d, yyyy[,] h:mm[:ss] a", "MMM yyyy", "MMMM yyyy")]
    script = F.regexp_replace(bare, r"\s*\([^)]*\)$", "")  # such a text ends with the zone's name
    tries += [F.try_to_timestamp(script, F.lit("MMM d yyyy HH:mm:ss 'GMT'XX"))]
    return F.unix_millis(F.coalesce(*tries))


def parse_date(text: Column, now_ms: int, number: Column | None = None) -> Column:
    """Epoch milliseconds of a number (seconds or milliseconds), a relative age or an absolute date."""
    s = trim(text)
    one = F.lower(F.regexp_extract(s, r"(?i)^an?\s+(min|minute|hour)s?\s+ago$", 1))
    ago = r"(?i)^(\d+)\s*(min|minute|hour|day|week|month|year)s?\s*ago$"
    unit = F.lower(F.regexp_extract(s, ago, 2))
    span = reduce(lambda c, kv: c.when(unit == kv[0], F.lit(kv[1])), _AGO_MS.items(), F.when(F.lit(False), F.lit(0)))
    now = F.lit(now_ms)
    day = _AGO_MS["day"]
    word = F.lower(s)
    parsed = (
        F.when(s == "", None)
        .when(one != "", now - F.when(one == "hour", F.lit(_AGO_MS["hour"])).otherwise(F.lit(_AGO_MS["min"])))
        .when(unit != "", now - F.regexp_extract(s, ago, 1).try_cast("long") * span)
        .when(word == "yesterday", now - day)
        .when(word == "last month", now - _AGO_MS["month"])
        .when(word == "last year", now - _AGO_MS["year"])
        .when(word == "today", F.lit(now_ms - now_ms % day))
        .otherwise(_absolute_ms(s))
    ).cast("long")
    return parsed if number is None else F.coalesce(F.when(number > 100_000_000_000, number).otherwise(number * 1000), parsed)


def parse_date_as(text: Column, *patterns: str) -> Column:
    """Epoch milliseconds by a source's own patterns, e.g. d/M/yyyy."""
    return F.unix_millis(F.coalesce(*(F.try_to_timestamp(trim(text), F.lit(p)) for p in patterns)))


def format_date(ms: Column) -> Column:
    return F.coalesce(F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd"), F.lit("—"))


def encode_component(c: Column) -> Column:
    """Percent-encoding that leaves - _ . ! ~ * ' ( ) as they are and makes spaces %20."""
    out = F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    for code, char in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def build_magnet(info_hash: Column, name: Column) -> Column:
    label = F.coalesce(F.concat(F.lit("&dn="), encode_component(blank_to_null(name))), F.lit(""))
    return F.when(info_hash != "", F.concat(F.lit("magnet:?xt=urn:btih:"), info_hash, label))


def extract_info_hash(c: Column) -> Column:
    return blank_to_null(F.lower(F.regexp_extract(c, "(?i)btih:([a-f0-9]{32,40})", 1)))


def magnet_size(c: Column) -> Column:
    return F.regexp_extract(c, r"[?&]xl=(\d+)", 1).try_cast("long")


# Russian words of dates and their English forms.
_RU_FIRST = [("Сегодня", "Today"), ("Вчера", "Yesterday")]
_RU_MONTHS = [("Янв", "Jan"), ("Фев", "Feb"), ("Мар", "Mar"), ("Апр", "Apr"), ("Май", "May"), ("Июн", "Jun"), ("Июл", "Jul"), ("Авг", "Aug"), ("Сен", "Sep"), ("Окт", "Oct"), ("Ноя", "Nov"), ("Дек", "Dec")]


def ru_date(c: Column) -> Column:
    for ru, en in _RU_FIRST:
        c = F.regexp_replace(c, f"(?iu)^((?s).*?){ru}", f"$1{en}")
    c = F.regexp_replace(c, "(?iu)мая", "Май")
    for ru, en in _RU_MONTHS:
        c = F.regexp_replace(c, f"(?iu){ru}", en)
    return c


def to_int(c: Column) -> Column:
    """The leading integer of a text with thousands commas dropped, else null."""
    return F.regexp_extract(F.replace(c, F.lit(","), F.lit("")), rf"^{_SPACE}*([+-]?\d+)", 1).try_cast("long")


def escape_html(c: Column) -> Column:
    for char, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(char), F.lit(code))
    return c


def highlight(name: Column, query: str) -> Column:
    """Escaped name with every query word in a span; longer words first."""
    import re

    words = sorted(dict.fromkeys(w.lower() for w in query.split()), key=lambda w: -len(w))
    escaped = escape_html(name)
    if not words:
        return escaped
    html = [w.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;").replace("'", "&#39;") for w in words]
    return F.regexp_replace(escaped, "(?iu)(" + "|".join(re.escape(w) for w in html) + ")", '<span class="hl">$1</span>')


def shorten(c: Column, most: int) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("…"))).otherwise(c)


def health_percent(seeders: Column, leechers: Column) -> Column:
    s, n = F.coalesce(seeders, F.lit(0)), F.coalesce(seeders, F.lit(0)) + F.coalesce(leechers, F.lit(0))
    return F.when(n > 0, F.floor(s * 100 / n + 0.5).cast("int"))


def health_band(percent: Column) -> Column:
    return F.when(percent > 66, "good").when(percent > 33, "fair").when(percent.isNotNull(), "poor")


def safe_http_url(c: Column) -> Column:
    return F.when(F.lower(F.try_parse_url(c, F.lit("PROTOCOL"))).isin("http", "https"), c)


def slug(c: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(blank_to_null(s), F.lit("indexer"))


def mask_key(c: Column) -> Column:
    return F.when(c != "", F.concat(F.lit("••••"), F.right(c, F.lit(4)))).otherwise("")


def absolute_url(href: Column, base: str | Column) -> Column:
    return F.when(href.startswith("http"), href).otherwise(F.concat(F.lit(base), href))


def page_number(page) -> int:
    """A page as given by a caller; anything that isn't a positive integer is page 1."""
    try:
        return max(1, int(page))
    except (TypeError, ValueError):
        return 1
