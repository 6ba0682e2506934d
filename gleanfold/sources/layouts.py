"""Layouts of HTML sources: where a page has its rows and fields. Parsing a page is one small step inside a task;
all that is done with the fields afterwards are Column expressions.

A field is "selector | what": text (the default), own (text outside child elements), @attribute, or after:Label / parent:Label for text
that follows a label in a line or beside a <strong>. ".." stands for the row itself, "2:" before a selector for a pair's second row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import canon, classify
from .html import Node, parse

Fix = Callable[[Column], Column]


@dataclass(frozen=True)
class Layout:
    base: str
    rows: str
    fields: dict[str, str]
    need: tuple[str, ...] = ("name",)
    skip: int = 0
    pairs: bool = False
    least_cells: int = 0
    cells: str = ""
    inside: str = ""  # only rows of the last element of this kind
    first: str = ""  # only rows of the first element of this kind
    category: str | None = None
    table: dict[str, str] | None = None
    default: str | None = "Other"
    fix: dict[str, Fix] = field(default_factory=dict)
    where: Callable[[], Column] | None = None
    date: Callable[[Column], Column] | None = None  # a source's own dates, to milliseconds


def _sub(pattern: str, by: str = "") -> Fix:
    return lambda c: F.regexp_replace(c, pattern, by)


def _group(pattern: str, n: int = 1) -> Fix:
    return lambda c: canon.blank_to_null(F.regexp_extract(c, pattern, n))


def _lower_group(pattern: str) -> Fix:
    return lambda c: F.lower(_group(pattern)(c))


def _by_prefix(pairs: list[tuple[str, str]]) -> Fix:
    def fix(c: Column) -> Column:
        out = F.when(c == "", None)
        for prefix, bucket in pairs:
            out = out.when(c.startswith(prefix), bucket)
        return out.otherwise("Other")

    return fix


_RU_UNITS = [("(?iu)ГБ", "GB"), ("(?iu)МБ", "MB"), ("(?iu)КБ", "KB")]


def _ru_size(c: Column) -> Column:
    for ru, en in _RU_UNITS:
        c = F.regexp_replace(c, ru, en)
    return F.regexp_replace(c, "^([^,]*),", "$1.")


# Addresses, selectors and label tables of the sources.
LAYOUTS: dict[str, Layout] = {
    "1337x": Layout("https://1337x.to", "table tbody tr", {"name": "td.name a", "href": "td.name a | @href", "size": "td.size", "seeders": "td.seeds", "leechers": "td.leeches", "date": "td.date"}, where=lambda: F.contains(F.col("href"), F.lit("/torrent/"))),
    "nyaa": Layout("https://nyaa.si", "table.torrent-list tbody tr", {"name": "td:nth-child(2) a[href^=/view/]", "href": "td:nth-child(2) a[href^=/view/] | @href", "category": "td:nth-child(1) a[title] | @title", "size": "td:nth-child(3)", "date": "td:nth-child(4)", "seeders": "td:nth-child(5)", "leechers": "td:nth-child(6)", "magnet": "td:nth-child(2) a[href^=magnet:], td:nth-child(3) a[href^=magnet:] | @href"}, least_cells=6),
    "anirena": Layout("https://anirena.com", "table.tl-table > tbody > tr", {"name": "td.col-name > div.tl-name-wrap > a.tl-torrent-name", "href": "td.col-name > div.tl-name-wrap > a.tl-torrent-name | @href", "go": "td.col-actions > div.tl-actions > a:nth-child(1) | @href", "size": "td.col-size", "seeders": "td.col-se > span.tl-se", "leechers": "td.col-le > span.tl-le", "stamp": ".. | @data-created-ts", "category": "td.col-cat | @title"}, need=("name", "go"),
        table={"Anime": "Anime", "Manga": "Books", "Audio": "Music", "Literature": "Books", "Live Action": "Series", "Software": "Apps", "Hentai": "Porn", "Other": "Other"}, fix={"category": lambda c: canon.trim(F.substring_index(c, "/", 1))}),
    "animetosho": Layout("https://animetosho.org", "div.home_list_entry", {"name": "div.link > a", "href": "div.link > a | @href", "size": "div.size", "peers": "div.links span[title]", "date": "div.date | @title", "magnet": "div.links a[href^=magnet:] | @href"}, need=("name", "size", "date", "magnet"), category="Anime",
        fix={"date": _sub("Date/time submitted:")}, date=lambda c: canon.parse_date_as(F.regexp_extract(c, r"(\d+/\d+/\d+)", 1), "d/M/yyyy")),
    "dmhy": Layout("https://share.dmhy.org", "table#topic_list > tbody > tr", {"name": "td.title > a | own", "href": "td.title > a | @href", "magnet": "td:nth-child(4) > a:nth-child(1) | @href", "size": "td:nth-child(5) | own", "seeders": "td:nth-child(6)", "leechers": "td:nth-child(7)", "date": "td:nth-child(1) > span | own", "category": "td:nth-child(2) > a | @class"}, need=("name", "magnet"),
        table={"2": "Anime", "7": "Anime", "31": "Anime", "3": "Books", "41": "Series", "42": "Series", "6": "Series", "4": "Music", "43": "Music", "44": "Music", "15": "Music", "9": "Games", "17": "Games", "18": "Games", "19": "Games", "20": "Games", "21": "Games"}, fix={"category": lambda c: canon.trim(F.regexp_replace(c, "sort-", ""))}),
    "mikan": Layout("https://mikanani.me", "tr.js-search-results-row", {"name": "td:nth-child(2) > a:nth-child(1) | own", "href": "td:nth-child(2) > a:nth-child(1) | @href", "magnet": "td:nth-child(2) > a[data-clipboard-text] | @data-clipboard-text", "size": "td:nth-child(3) | own", "date": "td:nth-child(4) | own"}, need=("name", "magnet"), category="Anime"),
    "sukebei": Layout("https://sukebei.nyaa.si", "table.torrent-list > tbody > tr", {"name": "td:nth-child(2) > a:not(.comments)", "href": "td:nth-child(2) > a:not(.comments) | @href", "magnet": "td:nth-child(3) > a:nth-child(2) | @href", "size": "td:nth-child(4)", "date": "td:nth-child(5) | @data-timestamp", "seeders": "td:nth-child(6)", "leechers": "td:nth-child(7)", "category": "td:nth-child(1) a | @title"}, need=("name", "magnet"),
        table={"1": "Anime", "2": "Anime", "3": "Movies", "4": "Porn", "5": "Other", "6": "Other"}, default=None, fix={"category": lambda c: F.substring_index(canon.trim(c), "_", 1)}),
    "tokyotoshokan": Layout("https://tokyotosho.info", "table.listing > tbody > tr:nth-child(n+2)", {"name": "td.desc-top > a:nth-child(2)", "magnet": "td.desc-top > a:nth-child(1) | @href", "href": "td.web > a:last-child | @href", "category": "td:nth-child(1) > a | @href", "both": "2:td.desc-bot", "seeders": "2:td.stats > span:nth-child(1)", "leechers": "2:td.stats > span:nth-child(2)"}, need=("name", "magnet"), pairs=True,
        table={"1": "Anime", "7": "Anime", "8": "Anime", "10": "Anime", "11": "Anime", "3": "Books", "2": "Music", "9": "Music", "4": "Porn", "12": "Porn", "13": "Porn", "14": "Porn", "15": "Porn"}, fix={"category": lambda c: F.replace(c, F.lit("/?cat="), F.lit(""))}),
    "nekobt": Layout("https://nekobt.to", "table.table > tbody > tr", {"name": "td:nth-child(3) > div:nth-child(1) > div > a span > span:nth-child(1)", "href": "td:nth-child(3) > div:nth-child(1) > div > a | @href", "magnet": "td:nth-child(4) > div > a:nth-child(1) | @href", "size": "td:nth-child(5) > span", "date": "td:nth-child(6) > span", "seeders": "td:nth-child(7) > span", "leechers": "td:nth-child(8) > span"}, need=("name", "magnet"), category="Anime"),
    "bt4g": Layout("https://bt4gprx.com", "div.notion-list-item", {"name": "div.notion-list-item-title > a", "href": "div.notion-list-item-title > a | @href", "size": "div.notion-list-item-meta > span:nth-child(5) > b", "seeders": "div.notion-list-item-meta span#seeders", "leechers": "div.notion-list-item-meta span#leechers", "date": "div.notion-list-item-meta > span:nth-child(2)", "category": "div.notion-list-item-meta span.notion-tag"},
        table={"Video": "Movies", "Movie": "Movies", "Audio": "Music", "Doc": "Books", "App": "Apps", "Application": "Apps"}, fix={"date": _sub(r"^Creation Time:\s*")}),
    "btdigg": Layout("https://btdig.com", "div.one_result > div", {"name": "div.torrent_name > a", "href": "div.torrent_name > a | @href", "magnet": "div.torrent_magnet > div.fa-magnet > a | @href", "size": "span.torrent_size", "date": "span.torrent_age"}, need=("name", "magnet"), category="Other", fix={"date": _sub(r"^found\s+")}),
    "eztv": Layout("https://eztvx.to", "table:last-of-type > tbody > tr", {"name": "td:nth-child(2) > a.epinfo", "href": "td:nth-child(2) > a.epinfo | @href", "magnet": "td:nth-child(3) > a.magnet | @href", "size": "td:nth-child(4)", "seeders": "td:nth-child(6)"}, need=("name", "magnet"), skip=2, category="Series", fix={"leechers": lambda c: F.lit("0")}),
    "limetorrents": Layout("https://limetorrents.fun", ".table2 > tbody > tr", {"name": "td:nth-child(1) > div.tt-name > a:nth-child(2)", "href": "td:nth-child(1) > div.tt-name > a:nth-child(2) | @href", "hash": "td:nth-child(1) > div.tt-name > a:nth-child(1) | @href", "both": "td:nth-child(2)", "size": "td:nth-child(3)", "seeders": "td.tdseed", "leechers": "td.tdleech"}, need=("name", "hash"),
        table={"TV": "Series", "Movie": "Movies", "Music": "Music", "App": "Apps", "E-book": "Books", "Anime": "Anime", "Games": "Games"}, fix={"hash": _lower_group(r"itorrents\.net/torrent/([0-9A-Fa-f]+)\.")}),
    "therarbg": Layout("https://therarbg.com", "table > tbody > tr.list-entry", {"name": "td.cellName > div > a", "href": "td.cellName > div > a | @href", "size": "td.sizeCell | @data-order", "stamp": "td:nth-child(4) | @data-order", "seeders": "td:nth-child(7)", "leechers": "td:nth-child(8)", "category": "td:nth-child(3) > a"}, need=("name", "href"),
        table={"Anime": "Anime", "Apps": "Apps", "Books": "Books", "Games": "Games", "Movies": "Movies", "Music": "Music", "XXX": "Porn", "Tv": "Series"}),
    "rutor": Layout("https://rutor.info", "div#index > table > tbody > tr", {"name": "td:nth-child(2) > a:nth-child(3)", "href": "td:nth-child(2) > a:nth-child(3) | @href", "magnet": "td:nth-child(2) > a:nth-child(2) | @href", "date": "td:nth-child(1)", "seeders": "td span:first-child", "leechers": "td span:nth-child(n+2)"}, need=("name", "magnet"), skip=1, cells="td", fix={"date": canon.ru_date, "size": _ru_size}),
    "torrent9": Layout("https://www6.torrent9.to", "table > tbody > tr", {"name": "td:nth-child(1) > a", "href": "td:nth-child(1) > a | @href"}, need=("href",)),
    "torrentdownload": Layout("https://torrentdownload.info", "div.wrapper > table.table2:last-of-type > tbody > tr", {"name": "td:nth-child(1) > div.tt-name > a", "href": "td:nth-child(1) > div.tt-name > a | @href", "hash": "td:nth-child(1) > div.tt-name > a | @href", "size": "td:nth-child(3)", "seeders": "td:nth-child(4)", "leechers": "td:nth-child(5)", "date": "td:nth-child(2)", "category": "td:nth-child(1) > div.tt-name > span"}, need=("name", "href", "hash"),
        table={"XXX": "Porn", "XXXVideo": "Porn", "XXXHDVideo": "Porn", "XXXPictures": "Porn", "Adult": "Porn", "AdultPornHDVideo": "Porn", "AdultPornPictures": "Porn", "AdultPornVideo": "Porn", "Anime": "Anime", "AnimeEnglishtranslated": "Anime", "AnimeAnimeOther": "Anime", "Applications": "Apps", "ApplicationsAndroid": "Apps", "ApplicationsWindows": "Apps", "Software": "Apps", "BooksAcademic": "Books", "BooksComics": "Books", "BooksEbooks": "Books", "BooksEducational": "Books", "BooksMagazines": "Books", "BooksFiction": "Books", "BooksNonfiction": "Books", "BooksTextbooks": "Books", "Ebooks": "Books", "OtherEbooks": "Books", "OtherComics": "Books", "AudioBooks": "Books", "AudioAudiobooks": "Books", "Games": "Games", "GamesWindows": "Games", "Movies": "Movies", "MoviesAction": "Movies", "MoviesConcerts": "Movies", "MoviesCrime": "Movies", "MoviesDocumentary": "Movies", "MoviesDubbedMovies": "Movies", "MoviesHighresMovies": "Movies", "MoviesMusicvideos": "Movies", "MoviesThriller": "Movies", "VideoMovies": "Movies", "Music": "Music", "MusicHardrock": "Music", "MusicMp": "Music", "MusicFLAC": "Music", "MusicLossless": "Music", "MusicRB": "Music", "MusicTranceHouseDance": "Music", "VideoMusic": "Music", "AudioMusic": "Music", "TV": "Series", "TVBBC": "Series", "TVshows": "Series", "Television": "Series"}, fix={"category": _sub("[^A-Za-z]+"), "hash": lambda c: F.lower(F.try_element_at(F.filter(F.split(c, "/"), lambda x: x != ""), F.lit(-2)))}),
    "torrentdownloads": Layout("https://torrentdownloads.pro", "div.grey_bar3", {"name": "p:nth-child(1) > a:nth-child(2)", "href": "p:nth-child(1) > a:nth-child(2) | @href", "size": "span:nth-child(5)", "seeders": "span:nth-child(4)", "leechers": "span:nth-child(3)", "category": "p:nth-child(1) > img:nth-child(1) | @src"}, need=("name", "href"), skip=2, inside="div.inner_container",
        table={"menu_icon0.png": "All", "menu_icon1.png": "Anime", "menu_icon2.png": "Books", "menu_icon3.png": "Games", "menu_icon4.png": "Movies", "menu_icon5.png": "Music", "menu_icon7.png": "Apps", "menu_icon8.png": "Series", "menu_icon9.png": "Other"}, fix={"category": _sub("^.*/templates/new/images/icons/")}),
    "torrentdatabase": Layout("https://developify.ca", "table.torrent-table > tbody > tr", {"name": "td:nth-child(1) > a:nth-child(2)", "hash": "td:nth-child(1) > a:nth-child(2) | @href", "href": "td:nth-child(1) > a:nth-child(1) | @href", "category": "td:nth-child(2) > span.category-bubble", "size": "td.size-cell", "date": "td.date-cell", "seeders": "td:nth-child(5) > div > span:nth-child(1)", "leechers": "td:nth-child(5) > div > span:nth-child(2)"}, need=("name", "hash"),
        table={"Software": "Apps", "E-Books": "Books", "AudioBooks": "Books", "Games": "Games", "Movies": "Movies", "Music": "Music", "Porn": "Porn", "TV": "Series"}, fix={"hash": lambda c: canon.blank_to_null(canon.trim(F.substring_index(F.regexp_replace(c, "^/track/magnet/", ""), "?", 1)))}),
    "torrentkitty": Layout("https://torrentkitty.tv", "table#archiveResult > tbody > tr", {"name": "td.name", "magnet": "td.action > a:nth-child(2) | @href", "href": "td.action > a:nth-child(1) | @href", "size": "td.size", "date": "td.date"}, skip=1, fix={"size": F.upper}),
    "uindex": Layout("https://uindex.org", "tbody > tr", first="table.sr-table, table.top-table", fields={"name": "td.sr-col-name > a.sr-torrent-link", "href": "td.sr-col-name > a.sr-torrent-link | @href", "magnet": "td.sr-col-name > a.sr-magnet | @href", "size": "td.sr-col-size", "seeders": "td.sr-col-seeders > span.sr-seed", "leechers": "td.sr-col-leechers > span.sr-leech", "date": "td.sr-col-uploaded", "category": "td.sr-col-cat > a.sr-cat-badge"},
        table={"Anime": "Anime", "Apps": "Apps", "Games": "Games", "Movies": "Movies", "Music": "Music", "XXX": "Porn", "TV": "Series", "Other": "Other"}),
    "zeromagnet": Layout("https://9mag.net", "table.file-list > tbody > tr", {"name": "td:nth-child(1) > a", "href": "td:nth-child(1) > a | @href"}, need=("name", "href"), category="Porn"),
    "bitsearch": Layout("https://bitsearch.to", "div.space-y-4 > div > div:nth-child(1)", {"name": "h3", "href": "h3 > a | @href", "magnet": "a[href^=magnet:] | @href", "category": "[class*=category], [class*=tag], [class*=badge]"}, cells="div", fix={"category": _by_prefix([("TV", "Series"), ("XXX", "Porn"), ("Movies", "Movies"), ("Anime", "Anime"), ("Softwares", "Apps"), ("Games", "Games"), ("Music", "Music"), ("AudioBook", "Books"), ("Ebook", "Books")])}),
    "oxtorrent": Layout("https://oxtorrent.co", "table > tbody > tr", {"name": "td:nth-child(1) > a", "href": "td:nth-child(1) > a | @href"}, need=("name", "href")),
    "audiobookbay": Layout("https://audiobookbay.lu", "div.post", {"name": "div.postTitle > h2 > a", "href": "div.postTitle > h2 > a | @href", "size": "div.postContent > p:nth-child(3) | after:File Size:", "date": "div.postContent > p:nth-child(3) | after:Posted:"}, need=("name", "href"), category="Books", fix={"size": _sub("s$")}),
    "blueroms": Layout("https://www.blueroms.ws", "div.row > div.col-xs-12 > div.card", {"name": "h4.card-title > a", "href": "div.card-footer > a | @href", "platform": ".. | parent:Platform:", "size": ".. | parent:Size:"}, need=("name", "href"), category="Games"),
    "filemood": Layout("https://filemood.com", "table > tbody > tr", {"name": "td.dn-title", "href": "td.dn-btn > div > a | @href", "hash": "td.dn-btn > div > a | @href", "button": "a.btn-success | @class", "size": "td.dn-size", "both": "td.dn-status"}, need=("name", "button", "hash"), category="Other", fix={"hash": _lower_group(r"(?i)-([a-f0-9]{40})(?:\.html)?$")}),
    "linuxtracker": Layout("https://linuxtracker.org", "tr", {"name": "td.lista a[href*=torrent-details]", "href": "td.lista a[href*=torrent-details] | @href", "hash": "td.lista a[href*=torrent-details] | @href", "date": "td:nth-child(4)", "size": "td:nth-child(5)", "seeders": "td:nth-child(7)", "leechers": "td:nth-child(8)"}, least_cells=6, category="Apps", fix={"hash": _lower_group("(?i)[?&]id=([a-f0-9]{40})")}, date=lambda c: canon.parse_date_as(c, "d/M/yyyy")),
    "megapeer": Layout("https://megapeer.vip", "div#index > table > tbody > tr.table_fon", {"name": "td:nth-child(2) > a:nth-child(2)", "href": "td:nth-child(2) > a:nth-child(2) | @href", "size": "td:nth-child(3)", "seeders": "td:nth-child(4) > font:nth-child(2)", "leechers": "td:nth-child(4) > font:nth-child(4)", "date": "td:nth-child(1)"}, need=("name", "href"), fix={"date": canon.ru_date}),
    "mypornclub": Layout("https://myporn.club", "div.torrents_list > div.torrent_element", {"name": "div.torrent_element_text_div > a:nth-child(2) > span.torrent_element_text_span", "href": "div.torrent_element_text_div > a:nth-child(2) | @href", "size": "div.torrent_element_info > span.teiv:nth-child(4)", "seeders": "div.torrent_element_info > span.teiv.teiv_seeders", "leechers": "div.torrent_element_info > span.teiv.teiv_leechers", "date": "div.torrent_element_info > span.teiv:nth-child(2)"}, need=("name", "href"), category="Porn"),
    "xxxclub": Layout("https://xxxclub.to", "ul > li", first="div.browsetableinside, div.divtableinside", fields={"name": "span:nth-child(2) > a[href^=/torrents/details]", "href": "span:nth-child(2) > a[href^=/torrents/details] | @href", "size": "span.siz", "seeders": "span.see", "leechers": "span.lee", "date": "span.adde"}, need=("name", "href"), category="Porn"),
    "xxxtracker": Layout("https://xxxtor.com", "table > tbody > tr", {"name": "td:nth-child(2) > a:nth-child(3)", "href": "td:nth-child(2) > a:nth-child(3) | @href", "magnet": "td:nth-child(2) > a[href^=magnet:]:nth-child(1) | @href", "size": "td:nth-child(3)", "seeders": "td:nth-child(4) > span:nth-child(1)", "leechers": "td:nth-child(4) > span:nth-child(2)", "date": "td:nth-child(1)"}, need=("name", "magnet"), skip=1, category="Porn", fix={"date": canon.ru_date}),
}
# Further addresses of sources with mirrors, in order of preference.
MIRRORS: dict[str, list[str]] = {
    "1337x": ["https://1337x.to", "https://1337x.st", "https://1377x.to", "https://x1337x.ws"], "eztv": ["https://eztvx.to", "https://eztv.re", "https://eztv.tf", "https://eztv.wtf"],
    "limetorrents": ["https://limetorrents.fun", "https://limetorrents.lol", "https://limetorrents.pro"], "therarbg": ["https://therarbg.com", "https://therarbg.to", "https://therarbg.org"], "rutor": ["https://rutor.info", "https://rutor.is", "https://rutor.ru"],
    "torrent9": ["https://www6.torrent9.to", "https://www.torrent9.to", "https://torrent9.so", "https://ww1.torrent9.to"], "torrentdownload": ["https://torrentdownload.info", "https://torrentdownload.me"], "torrentdownloads": ["https://torrentdownloads.pro", "https://torrentdownloads.me", "https://torrentdownloads.org"],
    "torrentkitty": ["https://torrentkitty.tv", "https://torrentkitty.to", "https://torrentkitty.is"], "uindex": ["https://uindex.org", "https://uindex.to"], "bitsearch": ["https://bitsearch.to", "https://bitsearch.am"], "oxtorrent": ["https://oxtorrent.co", "https://oxtorrent.so"], "anilibria": ["https://anilibria.top", "https://www.anilibria.top"],
}
# What sources say of a page without rows; without their container; whose rows hold no listing; and of an answer without a page.
NO_ROWS = {
    "1337x": "no_results_parsed", "audiobookbay": "no_results_parsed", "bitsearch": "no_results", "blueroms": "no_results_parsed", "eztv": "no_results_parsed", "filemood": "no_results_parsed", "limetorrents": "no_results_parsed", "linuxtracker": "no_results_parsed",
    "megapeer": "no_results_parsed", "mypornclub": "no_results_parsed", "oxtorrent": "no_results", "rutor": "no_results_parsed", "therarbg": "no_results_parsed", "torrent9": "no_results_parsed", "torrentdatabase": "no_results", "torrentdownload": "no_results_parsed",
    "torrentdownloads": "no_results", "torrentkitty": "no_results", "uindex": "no_results", "xxxclub": "no_results_parsed", "xxxtracker": "no_results_parsed", "zeromagnet": "no_results",
}
NO_CONTAINER = {"torrentdownloads": "no_container", "uindex": "no_container", "xxxclub": "no_results_parsed"}
NO_LISTING = {"audiobookbay": "no_results_parsed", "blueroms": "no_results_parsed", "mypornclub": "no_results_parsed", "torrent9": "no_results_parsed", "xxxclub": "no_results_parsed"}
NO_PAGE = {"anirena": "no_html", "animetosho": "no_html", "dmhy": "no_html", "mikan": "no_html", "nyaa": "null", "internetarchive": "no_data", "subsplease": "no_data"}
# Where a detail page has its magnet or hash.
DETAILS: dict[str, tuple[str, str]] = {
    "1337x": ("a[href^=magnet:] | @href", "magnet"), "anirena": ("div.td-actions > a:nth-child(1) | @href", "redirect"), "bt4g": ("a[href^=//downloadtorrentfile.com/hash/] | @href", "hash_link"), "therarbg": ("a[href^=magnet:?] | @href", "magnet"), "torrent9": ("a[href^=magnet:?] | @href", "magnet"),
    "torrentdownloads": ("a[href^=magnet:?] | @href", "magnet"), "zeromagnet": ("input#input-magnet | @value", "magnet"), "oxtorrent": ("div.btn-magnet > a | @href", "magnet"), "audiobookbay": ("td | next:Info Hash:", "hash"), "blueroms": ("#magnet-button | @data-link", "base64"), "megapeer": ("a[href^=magnet:?xt=] | @href", "magnet"),
    "mypornclub": ("a.md_btn | @href", "magnet"), "xxxclub": ("a[href^=magnet:?] | @href", "magnet"),
}


def _value(row: Node, second: Node | None, spec: str) -> str | None:
    where, _, what = (x.strip() for x in spec.partition("|"))
    if where.startswith("2:"):
        row, where = second, where[2:]
    if row is None:
        return None
    if what.startswith("next:"):
        for n in row.select(where):
            if n.text().strip() == what[5:]:
                family = n.parent.elements()
                at = next(i for i, x in enumerate(family) if x is n)
                return family[at + 1].text() if at + 1 < len(family) else None
        return None
    if what.startswith("parent:"):
        found = next((n for n in row.select("strong") if n.text().strip().startswith(what[7:])), None)
        return found.parent.text().replace(what[7:], "") if found else None
    node = row if where == ".." else row.first(where)
    if node is None:
        return None
    if what.startswith("@"):
        return node.attrs.get(what[1:])
    if what.startswith("after:"):
        return next((line.strip()[len(what) - 6 :] for line in node.text().split("\n") if line.strip().startswith(what[6:])), None)
    return node.own_text() if what == "own" else node.text()


def extract(html: str | None, layout: Layout) -> tuple[list[tuple[dict[str, str], list[str]]], bool]:
    """(fields, cells) of each row of one page, and whether the page has what its rows stand in."""
    page = parse(html)
    if layout.inside or layout.first:
        boxes = page.select(layout.inside) if layout.inside else [page.first(layout.first)]
        if not boxes or boxes[-1] is None:
            return [], False
        page = boxes[-1]
    rows, out = page.select(layout.rows)[layout.skip :], []
    steps = zip(rows[::2], rows[1::2]) if layout.pairs else ((r, None) for r in rows)
    for row, second in steps:
        if layout.least_cells and len(row.select("td")) < layout.least_cells:
            continue
        found = {k: v for k, spec in layout.fields.items() if (v := _value(row, second, spec)) is not None}
        out.append((found, [c.text().strip() for c in row.select(layout.cells)] if layout.cells else []))
    return out, True


def page_rows(pages: DataFrame, source_col: str = "source", html_col: str = "html", *keep: str) -> DataFrame:
    """Pages of any sources to rows (source, place, f map of fields, cells), each by its own layout, in one pass.

    A page without rows gives one with place -1, whose field "none" is what its source says of such a page.
    """
    kinds = dict(pages.dtypes)
    plain = {s: Layout(x.base, x.rows, x.fields, skip=x.skip, pairs=x.pairs, least_cells=x.least_cells, cells=x.cells, inside=x.inside, first=x.first) for s, x in LAYOUTS.items()}
    n = len(keep)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keep), "source string, place int, f map<string,string>, cells array<string>"])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            kind = pa.schema([*(batch.schema.field(i).with_name(k) for i, k in enumerate(keep)), ("source", pa.string()), ("place", pa.int32()), ("f", pa.map_(pa.string(), pa.string())), ("cells", pa.list_(pa.string()))])
            which, place, fields, cells = [], [], [], []

            def made():
                kept = batch.take(pa.array(which, pa.int64()))
                out = [*kept.columns[:n], kept.column(n), pa.array(place, pa.int32()), pa.array(fields, kind.field("f").type), pa.array(cells, kind.field("cells").type)]
                return pa.RecordBatch.from_arrays(out, schema=kind)

            for i, (source, html) in enumerate(zip(batch.column(n), batch.column(n + 1))):
                name = source.as_py()
                found, whole = extract(html.as_py(), plain[name])
                if not found:
                    none = NO_ROWS.get(name, "") if whole else NO_CONTAINER.get(name, NO_ROWS.get(name, ""))
                    which.append(i)
                    place.append(-1)
                    fields.append([("none", none)])
                    cells.append([])
                for at, (f, c) in enumerate(found):
                    which.append(i)
                    place.append(at)
                    fields.append(list(f.items()))
                    cells.append(c)
                if len(which) >= 5000:  # so that the rows of many pages aren't held at once
                    yield made()
                    which, place, fields, cells = [], [], [], []
            yield made()

    known = pages.where(F.col(source_col).isin(*LAYOUTS))
    return known.select(*keep, F.col(source_col).alias("_source"), F.col(html_col).alias("_html")).mapInArrow(run, schema)


def html_listings(pages: DataFrame, source: str, html_col: str = "html", *keep: str) -> DataFrame:
    """Raw listings of one source's pages; rows without a needed field are dropped."""
    return row_listings(page_rows(pages.withColumn("_own", F.lit(source)), "_own", html_col, *keep), source, *keep)


def row_listings(rows: DataFrame, source: str, *keep: str) -> DataFrame:
    """Raw listings of one source's rows (place, f, cells), as expressions."""
    layout, rows = LAYOUTS[source], rows.where("place >= 0")
    names = dict.fromkeys([*layout.fields, "size", "seeders", "leechers", "date", "stamp", "magnet", "hash", "category", "href", *layout.fix])
    cols = {n: canon.blank_to_null(canon.trim(F.try_element_at("f", F.lit(n)))) for n in names}
    if source in ("rutor", "bitsearch"):
        pattern = r"(?iu)\d.*(GB|MB|KB|TB|ГБ|МБ|КБ|ТБ)" if source == "rutor" else r"(?i)\d[\d,.]+\s*(TB|GB|MB|KB)"
        cols["size"] = F.get(F.filter("cells", lambda c: c.rlike(pattern)), F.lit(0))
    if source == "bitsearch":  # in order: two bare numbers, then what holds a month
        numbers = F.filter("cells", lambda c: c.rlike(r"^[\d,]+$"))
        cols |= {"seeders": F.get(numbers, F.lit(0)), "leechers": F.get(numbers, F.lit(1)), "date": F.get(F.filter("cells", lambda c: c.rlike("Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec") & ~c.rlike(pattern)), F.lit(0))}
    if source == "tokyotoshokan":  # '... | Size: 1MB | Date: ...'
        parts = F.split(cols["both"], r"\|")
        cols |= {n: canon.blank_to_null(canon.trim(F.regexp_replace(canon.trim(F.get(parts, F.lit(i))), r"^\S*\s*", ""))) for i, n in ((1, "size"), (2, "date"))}
    if source == "limetorrents":  # 'date - in Category.'
        both = cols["both"]
        cols |= {"date": canon.trim(F.when(F.contains(both, F.lit("- in")), F.substring_index(both, "-", 1)).otherwise(both)), "category": F.when(F.contains(both, F.lit("- in")), canon.trim(F.regexp_replace(both, r"^[^-]*-\s*(in )?|\.$", "")))}
    if source == "filemood":
        parts = F.split(cols["both"], "/")
        cols |= {"seeders": canon.trim(F.get(parts, F.lit(0))), "leechers": canon.trim(F.get(parts, F.lit(1)))}
    if source == "animetosho":
        pair = r"(\d+)\D+(\d+)"
        cols |= {"seeders": F.regexp_extract(cols["peers"], pair, 1), "leechers": F.regexp_extract(cols["peers"], pair, 2)}
    if source == "blueroms":
        cols["name"] = F.concat_ws(" - ", cols["name"], cols["platform"])
    for n, fix in layout.fix.items():
        cols[n] = fix(cols[n])
    rows = rows.select(*keep, "place", *(c.alias(n) for n, c in cols.items()))
    for n in layout.need:
        rows = rows.where(F.col(n) != "")
    if layout.where:
        rows = rows.where(layout.where())
    category = F.lit(layout.category) if layout.category or not (layout.table or "category" in layout.fields) else F.col("category")
    if layout.table:
        category = F.when(F.col("category").isNotNull(), classify.bucket_by_table(F.col("category"), layout.table, layout.default))
    info_hash = F.coalesce("hash", canon.extract_info_hash(F.col("magnet")))
    magnet = F.col("magnet")
    if source == "torrentdatabase":
        magnet = F.concat(F.lit("magnet:?xt=urn:btih:"), "hash", F.lit("&tr=https%3A%2F%2Fdevelopify.ca%2Fannounce"))
    stamp, base = F.col("stamp").try_cast("bigint"), layout.base
    if "mirror_rank" in keep and source in MIRRORS:  # addresses lead to the mirror that answered
        base = F.coalesce(F.get(F.array(*map(F.lit, MIRRORS[source])), F.col("mirror_rank").cast("int")), F.lit(layout.base))
    return rows.select(
        *keep, "place", F.lit(source).alias("provider"), "name", info_hash.alias("info_hash"), F.col("size").alias("size_raw"), F.col("date").alias("date_raw"),
        F.coalesce(stamp, layout.date(F.col("date")) if layout.date else F.lit(None).cast("bigint")).alias("date_num"), "seeders", "leechers", magnet.alias("magnet"),
        category.alias("category"), canon.absolute_url(F.col("href"), base).alias("detail_url"),
    )


def detail_magnets(pages: DataFrame, source_col: str = "source", url_col: str = "detail_url", html_col: str = "html") -> DataFrame:
    """Detail pages to (detail_url, resolved, resolved_hash): by the source's own rule, else the page's first magnet link."""

    def run(batches):
        import base64

        import pandas as pd

        for pdf in batches:
            rows = []
            for source, url, html in zip(pdf[source_col], pdf[url_col], pdf[html_col]):
                spec, kind = DETAILS.get(source, ("a[href^=magnet:] | @href", "magnet"))
                value, hashed = (_value(parse(html), None, spec) or "").strip(), None
                if kind == "base64" and value:
                    try:
                        value = base64.b64decode(value).decode()
                    except ValueError:
                        value = ""
                elif kind in ("hash", "hash_link"):
                    hashed, value = value.rpartition("/")[2].split("?")[0] or None, ""
                rows.append((url, value if value.startswith("magnet:") else None, hashed))
            yield pd.DataFrame(rows, columns=["detail_url", "resolved", "resolved_hash"])

    return pages.select(source_col, url_col, html_col).mapInPandas(run, "detail_url string, resolved string, resolved_hash string")
