"""Content buckets, quality tags and source groups as Column expressions.

The word boundaries are ASCII ones: a letter such as é or a CJK character beside a token doesn't hide it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_OPEN, _CLOSE = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"

# Buckets in order of display.
BUCKETS = ["movies", "series", "anime", "games", "apps", "books", "music", "porn", "other"]
# Patterns of a source's own category, first match wins (\b stands for an ASCII word boundary).
RAW_RULES = [
    ("movies", r"\b(movie|film|hd\s*movie)"),
    ("series", r"\b(tv|series|show|episode)"),
    ("anime", r"\b(anime|cartoon)"),
    ("games", r"\b(game|rom|nintendo|playstation|xbox|switch)"),
    ("apps", r"\b(app|software|program|pc\b|application)"),
    ("books", r"\b(book|audiobook|ebook|comic|magazine|manga|literature)"),
    ("music", r"\b(music|audio|album|flac|mp3|song)"),
    ("porn", r"\b(porn|xxx|adult|hentai|sex)"),
]
# Patterns of titles, first match wins.
TITLE_RULES = [
    ("series", r"\bs\d{1,2}(e\d{1,3}|\b)|\b\d{1,2}x\d{2}\b|\bseason\s?\d|\bcomplete series\b"),
    ("porn", r"\b(xxx|porn|hentai|jav|onlyfans|brazzers)\b"),
    ("games", r"\b(fitgirl|repack|codex|plaza|skidrow|reloaded|razor1911|empress|dodi|goldberg|nsw|\.nsp|\.xci)\b"),
    ("apps", r"\b(x64|x86|win(?:32|64)?|keygen|cracked|activator|portable|multilingual)\b|\bv\d+\.\d+"),
    ("books", r"\b(epub|mobi|azw3|pdf|retail|audiobook|m4b)\b"),
    ("music", r"\b(flac|mp3|320\s?kbps|discography|\bost\b|album)\b"),
    ("movies", r"\b(19|20)\d{2}\b.*\b(1080p|2160p|720p|bluray|blu-ray|web-?dl|webrip|bdrip|hdrip|x264|x265|hevc)\b"),
]
# Quality tags.
QUALITIES = {"2160p": r"\b(2160p|4k|uhd)\b", "1080p": r"\b1080p\b", "720p": r"\b720p\b", "hdr": r"\b(hdr|hdr10|dolby\s*vision|dovi|dv)\b"}
# Groups of sources.
SOURCE_GROUPS = {
    "anime": ["nyaa", "anilibria", "animetosho", "anirena", "bangumimoe", "dmhy", "mikan", "subsplease", "tokyotoshokan", "nekobt"],
    "video": ["eztv", "yts", "therarbg", "torrent9", "oxtorrent", "rutor", "megapeer"],
    "general": ["1337x", "tpb", "knaben", "torrentscsv", "bt4g", "btdigg", "limetorrents", "torrentdownload", "torrentdownloads", "torrentdatabase", "torrentkitty", "uindex", "zeromagnet", "bitsearch", "internetarchive", "filemood", "demo"],
    "adult": ["sukebei", "mypornclub", "xxxclub", "xxxtracker"],
    "other": ["audiobookbay", "blueroms", "linuxtracker"],
}


def java_pattern(rule: str) -> str:
    r"""A rule for Java's engine: \b before a word character opens, after one closes, as ASCII look-arounds."""
    either = f"(?:{_OPEN}(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_]){_CLOSE})"
    return rule.replace(r"\b", either)


def _first_rule(c: Column, rules: list[tuple[str, str]]) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for bucket, rule in rules:
        out = out.when(c.rlike(java_pattern(rule)), bucket)
    return out


def bucket_of_raw(category: Column) -> Column:
    """Bucket of a source's category; null if none applies."""
    s = F.lower(category)
    return F.when(s != "", _first_rule(s, RAW_RULES))


def bucket_of_title(name: Column) -> Column:
    """Bucket of a title, 'other' if no token tells; null for an empty one."""
    s = F.lower(name)
    return F.when(s != "", F.coalesce(_first_rule(s, TITLE_RULES), F.lit("other")))


def bucket(category: Column, name: Column) -> Column:
    return F.coalesce(bucket_of_raw(category), bucket_of_title(name))


def has_quality(name: Column, quality: str) -> Column:
    """Whether the title carries the tag; 'all' and unknown tags let everything pass."""
    rule = QUALITIES.get(quality)
    return F.coalesce(name, F.lit("")).rlike("(?i)" + java_pattern(rule)) if rule else F.lit(True)


def source_group(source: Column) -> Column:
    out = F.when(source.startswith("torznab:"), "custom")
    for group, ids in SOURCE_GROUPS.items():
        out = out.when(source.isin(*ids), group)
    return out.otherwise("general")


def bucket_by_table(label: Column, table: dict[str, str], default: str | None = None) -> Column:
    """A source's own label table as a map lookup."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), label)
    return found if default is None else F.coalesce(found, F.lit(default))


def bucket_by_range(number: Column, ranges: list[tuple[int, int, str]]) -> Column:
    """The bucket of the half-open range that holds the number."""
    out = F.when(F.lit(False), F.lit(""))
    for low, high, name in ranges:
        out = out.when((number >= low) & (number < high), name)
    return out
