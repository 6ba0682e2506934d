"""What to ask each source for a query and page: one request per mirror."""

from __future__ import annotations

from urllib.parse import quote

from . import feeds
from .layouts import LAYOUTS, MIRRORS

# Paths of the sources' searches; {q} is the encoded query, {page} the page number.
PATHS = {
    "1337x": "/search/{q}/{page}/", "nyaa": "/?f=0&c=0_0&q={q}&page={page}", "anirena": "/?q={q}&page=1", "animetosho": "/search?q={q}", "dmhy": "/topics/list?keyword={q}&sort_id=0&team_id=0&order=date-desc&page={page}", "mikan": "/Home/Search?searchstr={q}",
    "sukebei": "/?f=0&c=0_0&q={q}", "tokyotoshokan": "/search.php?terms={q}&type=0&searchName=true", "nekobt": "/search?query={q}", "bt4g": "/search?q={q}&category=all&orderby=seeders&p={page}", "btdigg": "/search?q={q}", "eztv": "/search/{q}",
    "limetorrents": "/search/all/{q}/date/{page}/", "therarbg": "/get-posts/keywords:{q}", "rutor": "/search/{page0}/0/010/2/{q}", "torrent9": "/search_torrent/{q}.html", "torrentdownload": "/search?q={q}", "torrentdownloads": "/search/?s_cat=0&search={q}", "torrentdatabase": "/newest?q={q}",
    "torrentkitty": "/search/{q}", "uindex": "/search.php?search={q}&c=0", "zeromagnet": "/search?q={q}", "bitsearch": "/search?q={q}&page={page}&sortBy=seeders", "oxtorrent": "/recherche/{q}", "audiobookbay": "/?s={q}", "blueroms": "/search?g=0&p=0&q={q}", "filemood": "/result?q={q}+in%3Atitle",
    "linuxtracker": "/index.php?page=torrents&search={q}&category=0&active=0", "megapeer": "/browse.php?search={q}&age=&cat=0&stype=0&sort=0&ascdesc=0", "mypornclub": "/s/{dashed}/seeders", "xxxclub": "/torrents/search/all/{q}", "xxxtracker": "/b.php?search={q}",
}
# As the sources demand them.
APIS = {
    "tpb": "https://apibay.org/q.php?q={q}", "yts": "https://movies-api.accel.li/api/v2/list_movies.json?query_term={q}&limit=50", "torrentscsv": "https://torrents-csv.com/service/search?q={q}", "subsplease": "https://subsplease.org/api?f=search&tz=$&s={q}",
    "internetarchive": "https://archive.org/advancedsearch.php?q=title:{q}&fl[]=title,item_size,publicdate,mediatype,identifier,btih&rows=100&page=1&output=json",
}
# As the sources demand them.
POSTS = {
    "knaben": ("https://api.knaben.org/v1", {"size": 300, "order_by": "seeders", "order_direction": "desc", "hide_unsafe": True, "hide_xxx": False}),
    "bangumimoe": ("https://bangumi.moe/api/v2/torrent/search", {}),
}
# As the sources demand them.
COOKIES = {"eztv": {"Cookie": "layout=def_wlinks"}}
# As the sources demand them.
ENCODINGS = {"megapeer": "windows-1251"}


def requests_for(source: str, query: str, page: int = 1, indexer: dict | None = None) -> list[dict]:
    """The requests of one source, in order of preference of its mirrors; none for the generated source."""
    q = quote(query, safe="-_.!~*'()")
    if indexer:
        return [{"source": source, "mirror_rank": 0, "url": feeds.indexer_query(indexer["url"], indexer.get("apiKey", ""), query)}]
    if source in POSTS:
        url, body = POSTS[source]
        return [{"source": source, "mirror_rank": 0, "url": url, "json": {"query": query} | body}]
    if source in APIS:
        return [{"source": source, "mirror_rank": 0, "url": APIS[source].format(q=q)}]
    if source not in PATHS:
        return []
    path = PATHS[source].format(q=q, page=page, page0=page - 1, dashed=quote("-".join(query.split()), safe="-_.!~*'()"))
    extra = {k: v for k, v in (("headers", COOKIES.get(source)), ("encoding", ENCODINGS.get(source))) if v}
    return [{"source": source, "mirror_rank": i, "url": base + path} | extra for i, base in enumerate(MIRRORS.get(source, [LAYOUTS[source].base]))]


def release_requests(query: str) -> list[dict]:
    """First step of the source with dependent requests: the search for releases, at each mirror."""
    return [{"source": "anilibria", "mirror_rank": i, "url": f"{base}/api/v1/app/search/releases?query={quote(query)}"} for i, base in enumerate(MIRRORS["anilibria"])]


def release_details(ids: list[int], mirror_rank: int = 0, most: int = 15) -> list[dict]:
    """Second step: one request per release, capped."""
    base = MIRRORS["anilibria"][mirror_rank]
    return [{"source": "anilibria", "mirror_rank": mirror_rank, "id": i, "url": f"{base}/api/v1/anime/torrents/release/{i}"} for i in ids[:most]]
