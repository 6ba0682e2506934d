"""Sources' pages made from the supplier table, one listing a supplier, read back by each source's own adapter.

A site has the HTML of one row, in which names in braces stand for values of the supplier, and of the page around its rows.
What its listings must be is said in SQL on the same values, so an adapter is compared with a rule that shares no code with it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.classify import SOURCE_GROUPS
from ..operators import listings
from ..shared import work_dir
from ..sources import feeds, layouts
from .catalogs import NOW_MS, encode_sql, read

OUT = ["id", "name", "size", "seeders", "leechers", "date_ms", "magnet", "info_hash", "provider", "category", "detail_url", "needs_magnet"]
ROWS_A_PAGE = 20


def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier's values as text, by the names that rows use."""
    k = F.col("s_suppkey")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (k % 300).cast("int"))
    hashed = F.concat(F.md5(k.cast("string")), F.substring(F.md5(k.cast("string")), 1, 8))
    text = lambda c: c.cast("string")
    return read(spark, sf_dir, "supplier").select(
        k.alias("key"), text(k).alias("k"), F.concat("s_name", F.lit(" "), text(k)).alias("name"), hashed.alias("hash"), F.upper(hashed).alias("upper"),
        F.concat(F.lit("magnet:?xt=urn:btih:"), hashed).alias("magnet"), text(k % 900 + 1).alias("n"), F.concat(text(k % 900 + 1), F.lit(" "), F.get(F.array(*map(F.lit, ("KB", "MB", "GB"))), (k % 3).cast("int"))).alias("size"),
        text(k % 97).alias("seeders"), text(k % 31).alias("leechers"), F.concat(text(k % 700), F.lit(" hours ago")).alias("ago"), text(k % 28 + 1).alias("d"),
        F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" 10:11")).alias("iso"), F.date_format(day, "d/M/yyyy").alias("dmy"), text(F.lit(1_700_000_000) + k * 3600).alias("stamp"), text(k * 1000 + 7).alias("bytes"),
    )


_DAY = "('2024-01-01'::DATE + (s_suppkey % 300)::INTEGER)"
VALUES_SQL = f"""
  SELECT *, 'magnet:?xt=urn:btih:' || hash AS in_magnet, 'magnet:?xt=urn:btih:' || hash || '&dn=' || {encode_sql("name")} AS made_magnet FROM (
    SELECT s_suppkey AS k, s_name || ' ' || s_suppkey AS name, md5(s_suppkey::VARCHAR) || substr(md5(s_suppkey::VARCHAR), 1, 8) AS hash, s_suppkey % 900 + 1 AS n,
      (s_suppkey % 900 + 1) * [1024, 1048576, 1073741824][s_suppkey % 3 + 1] AS bytes, s_suppkey % 97 AS seeders, s_suppkey % 31 AS leechers,
      {NOW_MS} - (s_suppkey % 700) * 3600000 AS ago, epoch_ms({_DAY}::TIMESTAMP) AS day, (1700000000 + s_suppkey * 3600) * 1000 AS stamp, s_suppkey % 28 + 1 AS d
    FROM supplier)
"""


def _filled(template: str, labels: list[tuple[str, str | None]]) -> Column:
    """A row's HTML as an expression."""
    label = F.get(F.array(*(F.lit(x[0]) for x in labels)), (F.col("key") % max(len(labels), 1)).cast("int")) if labels else F.lit("")
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*(F.lit(p) if i % 2 == 0 else label if p == "label" else F.col(p) for i, p in enumerate(parts)))


@dataclass(frozen=True)
class Site:
    row: str
    around: str = "<table><tbody>{rows}</tbody></table>"
    labels: list = field(default_factory=list)  # a source's label and the bucket it means
    category: str | None = None  # for all rows
    magnet: str = "NULL"  # in_magnet: on the page; made_magnet: built from the hash
    url: str = "'/t/' || k"
    size: str = "bytes"
    date: str = "ago"
    seeders: str = "seeders"
    leechers: str = "leechers"
    name: str = "name"

    def pages(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = values(spark, sf_dir).select(F.floor(F.col("key") / ROWS_A_PAGE).alias("page"), "key", _filled(self.row, self.labels).alias("row"))
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", "row"))), lambda x: x["row"]), "\n")
        head, _, tail = self.around.partition("{rows}")
        return rows.groupBy("page").agg(F.concat(F.lit("<html><body>" + head), joined, F.lit(tail + "</body></html>")).alias("html"))

    def sql(self, source: str, base: str) -> str:
        hashed = "NULL" if self.magnet == "NULL" else "hash"
        if self.labels:
            cases = ", ".join("NULL" if b is None else f"'{b}'" for _, b in self.labels)
            category = f"[{cases}][k % {len(self.labels)} + 1]"
        else:
            category = f"'{self.category}'" if self.category else "NULL"
        return f"""SELECT '{source}:' || coalesce({hashed}, {self.name}) AS id, {self.name} AS name, ({self.size})::BIGINT AS size, ({self.seeders})::BIGINT AS seeders, ({self.leechers})::BIGINT AS leechers, ({self.date})::BIGINT AS date_ms,
          ({self.magnet})::VARCHAR AS magnet, ({hashed})::VARCHAR AS info_hash, '{source}' AS provider, ({category})::VARCHAR AS category, '{base}' || {self.url} AS detail_url, {self.magnet} IS NULL AS needs_magnet FROM v"""


_ADVERT = "<tr><td>advert</td></tr>"
_RU_MS = "epoch_ms(make_date(2021, 5, d::INTEGER)::TIMESTAMP)"
_MARCH_MS = "epoch_ms(make_date(2024, 3, d::INTEGER)::TIMESTAMP)"
_ISO_MS = "day + 36660000"
_PEERS = "<td><span>{seeders}</span></td><td><span>{leechers}</span></td>"
# Rows and pages in the shape that each source's adapter reads.
SITES: dict[str, Site] = {
    "1337x": Site("<tr><td class=name><a href=/torrent/{k}/x>{name}</a></td><td class=size>{size}</td><td class=seeds>{seeders}</td><td class=leeches>{leechers}</td><td class=date>{ago}</td></tr><tr><td class=name><a href=/user/{k}>u</a></td></tr>", url="'/torrent/' || k || '/x'"),
    "nyaa": Site("<tr><td><a title='{label}' href='/?c=1'></a></td><td><a href=/view/{k}>{name}</a></td><td><a href='{magnet}'></a>{size}</td><td>{iso}</td><td>{seeders}</td><td>{leechers}</td></tr><tr><td>short</td></tr>", "<table class=torrent-list><tbody>{rows}</tbody></table>", [("Anime - Raw", "Anime - Raw"), ("Audio", "Audio")], magnet="in_magnet", url="'/view/' || k", date=_ISO_MS),
    "anirena": Site("<tr data-created-ts={stamp}><td class=col-cat title='{label} / x'></td><td class=col-name><div class=tl-name-wrap><a class=tl-torrent-name href=/t/{k}>{name}</a></div></td><td class=col-actions><div class=tl-actions><a href=/go/{k}>go</a></div></td><td class=col-size>{size}</td><td class=col-se><span class=tl-se>{seeders}</span></td><td class=col-le><span class=tl-le>{leechers}</span></td></tr>" + _ADVERT, "<table class=tl-table><tbody>{rows}</tbody></table>", [("Anime", "Anime"), ("Literature", "Books"), ("Unheard", "Other")], date="stamp"),
    "animetosho": Site("<div class=home_list_entry><div class=link><a href=/t/{k}>{name}</a></div><div class=size>{size}</div><div class=date title='Date/time submitted: {dmy} 10:11'></div><div class=links><span title=s>[{seeders}↑/{leechers}↓]</span><a href='{magnet}'>m</a></div></div><div class=home_list_entry><div class=link><a href=/n>no magnet</a></div></div>", "{rows}", category="Anime", magnet="in_magnet", date="day"),
    "dmhy": Site("<tr><td>x<span>{iso}</span></td><td><a class='sort-{label}' href=/c>c</a></td><td class=title><a href=/t/{k}>{name}<span>tag</span></a></td><td><a href='{magnet}'></a></td><td>{size}</td><td>{seeders}</td><td>{leechers}</td></tr>" + _ADVERT, "<table id=topic_list><tbody>{rows}</tbody></table>", [("2", "Anime"), ("3", "Books"), ("42", "Series"), ("43", "Music"), ("21", "Games"), ("99", "Other")], magnet="in_magnet", date=_ISO_MS),
    "mikan": Site("<tr class=js-search-results-row><td>x</td><td><a href=/t/{k}>{name}</a><a data-clipboard-text='{magnet}'>c</a></td><td>{size}</td><td>{iso}</td></tr>", category="Anime", magnet="in_magnet", date=_ISO_MS, seeders="NULL", leechers="NULL"),
    "sukebei": Site("<tr><td><a title='Art - Anime'></a></td><td><a class=comments href=/c>1</a><a href=/view/{k}>{name}</a></td><td><a href=/dl></a><a href='{magnet}'></a></td><td>{size}</td><td data-timestamp={stamp}>d</td><td>{seeders}</td><td>{leechers}</td></tr>" + _ADVERT, "<table class=torrent-list><tbody>{rows}</tbody></table>", magnet="in_magnet", url="'/view/' || k", date="NULL"),
    "tokyotoshokan": Site("<tr><td><a href='/?cat={label}'>c</a></td><td class=desc-top><a href='{magnet}'></a><a href=/x>{name}</a></td><td class=web><a href=/a>a</a><a href=/t/{k}>w</a></td></tr><tr><td class=desc-bot>By: me | Size: {size} | Date: {iso} UTC</td><td class=stats>S: <span>{seeders}</span> L: <span>{leechers}</span></td></tr>", "<table class=listing><tbody><tr><td>head</td></tr>{rows}</tbody></table>", [("1", "Anime"), ("3", "Books"), ("9", "Music"), ("15", "Porn"), ("77", "Other")], magnet="in_magnet", date=_ISO_MS),
    "nekobt": Site("<tr><td>1</td><td>2</td><td><div><div><a href=/t/{k}><span><span>{name}</span></span></a></div></div></td><td><div><a href='{magnet}'></a></div></td><td><span>{size}</span></td><td><span>{ago}</span></td>" + _PEERS + "</tr>" + _ADVERT, "<table class=table><tbody>{rows}</tbody></table>", category="Anime", magnet="in_magnet"),
    "bt4g": Site("<div class=notion-list-item><div class=notion-list-item-title><a href=/t/{k}>{name}</a></div><div class=notion-list-item-meta><span class=notion-tag>{label}</span><span>Creation Time: {iso}</span><span>3</span><span>4</span><span>Size <b>{size}</b></span><span id=seeders>{seeders}</span><span id=leechers>{leechers}</span></div></div>", "{rows}", [("Video", "Movies"), ("Audio", "Music"), ("Doc", "Books"), ("App", "Apps"), ("Archive", "Other")], date=_ISO_MS),
    "btdigg": Site("<div class=one_result><div><div class=torrent_name><a href=/t/{k}>{name}</a></div><span class=torrent_size>{size}</span><span class=torrent_age>found {ago}</span><div class=torrent_magnet><div class=fa-magnet><a href='{magnet}'></a></div></div></div></div>", "{rows}", category="Other", magnet="in_magnet", seeders="NULL", leechers="NULL"),
    "eztv": Site("<tr><td>s</td><td><a class=epinfo href=/ep/{k}>{name}</a></td><td><a class=magnet href='{magnet}'></a></td><td>{size}</td><td>d</td><td>{seeders}</td></tr>" + _ADVERT, "<table><tbody><tr><td>menu</td></tr></tbody></table><table><tbody><tr><td>1</td></tr><tr><td>2</td></tr>{rows}</tbody></table>", category="Series", magnet="in_magnet", url="'/ep/' || k", date="NULL", leechers="0"),
    "limetorrents": Site("<tr><td><div class=tt-name><a href='http://itorrents.net/torrent/{upper}.torrent?t'></a><a href=/t/{k}>{name}</a></div></td><td>{ago} - in {label}.</td><td>{size}</td><td class=tdseed>{seeders}</td><td class=tdleech>{leechers}</td></tr>" + _ADVERT, "<table class=table2><tbody>{rows}</tbody></table>", [("TV", "Series"), ("E-book", "Books"), ("Misc", "Other")], magnet="made_magnet"),
    "therarbg": Site("<tr class=list-entry><td>1</td><td class=cellName><div><a href=/t/{k}>{name}</a></div></td><td><a>{label}</a></td><td data-order={stamp}>d</td><td>x</td><td class=sizeCell data-order={bytes}>y</td><td>{seeders}</td><td>{leechers}</td></tr>" + _ADVERT, labels=[("Tv", "Series"), ("XXX", "Porn"), ("Zzz", "Other")], size="k * 1000 + 7", date="stamp"),
    "rutor": Site("<tr><td>{d} Мая 21</td><td><a>d</a><a href='{magnet}'></a><a href=/t/{k}>{name}</a></td><td>{n},5 ГБ</td><td><span>{seeders}</span><span>{leechers}</span></td></tr>" + _ADVERT, "<div id=index><table><tbody><tr><th>head</th></tr>{rows}</tbody></table></div>", magnet="in_magnet", size="n * 1073741824 + 536870912", date=_RU_MS),
    "torrent9": Site("<tr><td><a href=/t/{k}>{name}</a></td></tr>" + _ADVERT, size="NULL", date="NULL", seeders="NULL", leechers="NULL"),
    "torrentdownload": Site("<tr><td><div class=tt-name><a href='/{upper}/n{k}'>{name}</a><span>{label}</span></div></td><td>{ago}</td><td>{size}</td><td>{seeders}</td><td>{leechers}</td></tr>" + _ADVERT, "<div class=wrapper><table class=table2><tbody><tr><td>top</td></tr></tbody></table><table class=table2><tbody>{rows}</tbody></table></div>", [("» Movies - Thriller", "Movies"), ("» Audio Books", "Books"), ("» TV shows", "Series"), ("» Zzz", "Other")], magnet="made_magnet", url="'/' || upper(hash) || '/n' || k"),
    "torrentdownloads": Site("<div class=grey_bar3><p><img src=/templates/new/images/icons/{label}><a href=/t/{k}>{name}</a></p><span>x</span><span>{leechers}</span><span>{seeders}</span><span>{size}</span></div>", "<div class=inner_container><div class=grey_bar3><p>other</p></div></div><div class=inner_container><div class=grey_bar3><p>1</p></div><div class=grey_bar3><p>2</p></div>{rows}</div>", [("menu_icon8.png", "Series"), ("menu_icon2.png", "Books"), ("menu_icon6.png", "Other")], date="NULL"),
    "torrentdatabase": Site("<tr><td><a href=/t/{k}>i</a><a href='/track/magnet/{hash}?x'>{name}</a></td><td><span class=category-bubble>{label}</span></td><td class=size-cell>{size}</td><td class=date-cell>{ago}</td><td><div><span>{seeders}</span><span>{leechers}</span></div></td></tr>" + _ADVERT, "<table class=torrent-table><tbody>{rows}</tbody></table>", [("E-Books", "Books"), ("TV", "Series"), ("Qq", "Other")], magnet="in_magnet || '&tr=https%3A%2F%2Fdevelopify.ca%2Fannounce'"),
    "torrentkitty": Site("<tr><td class=name>{name}</td><td class=size>{n} gb</td><td class=date>{iso}</td><td class=action><a href=/t/{k}>o</a><a href='{magnet}'></a></td></tr>", "<table id=archiveResult><tbody><tr><td class=name>head</td></tr>{rows}</tbody></table>", magnet="in_magnet", size="n * 1073741824", date=_ISO_MS, seeders="NULL", leechers="NULL"),
    "uindex": Site("<tr><td class=sr-col-cat><a class=sr-cat-badge>{label}</a></td><td class=sr-col-name><a class=sr-magnet href='{magnet}'></a><a class=sr-torrent-link href=/t/{k}>{name}</a></td><td class=sr-col-size>{size}</td><td class=sr-col-seeders><span class=sr-seed>7,0{n}</span></td><td class=sr-col-leechers><span class=sr-leech>{leechers}</span></td><td class=sr-col-uploaded>{ago}</td></tr>" + _ADVERT, "<table class=sr-table><tbody>{rows}</tbody></table>", [("XXX", "Porn"), ("TV", "Series"), ("Nope", "Other")], magnet="in_magnet", seeders="('70' || n)"),
    "zeromagnet": Site("<tr><td><a href=/t/{k}>{name}</a></td></tr>" + _ADVERT, "<table class=file-list><tbody>{rows}</tbody></table>", category="Porn", size="NULL", date="NULL", seeders="NULL", leechers="NULL"),
    "bitsearch": Site("<div><div><h3><a href=/t/{k}>{name}</a></h3><div>{n}.5 GB</div><div>{seeders}</div><div>{leechers}</div><div>{d} Mar 2024</div><span class=badge>{label}</span><a href='{magnet}'></a></div></div>", "<div class=space-y-4>{rows}</div>", [("Movies/HD", "Movies"), ("TV-x", "Series"), ("Ebook", "Books"), ("Zip", "Other")], magnet="in_magnet", size="n * 1073741824 + 536870912", date=_MARCH_MS),
    "oxtorrent": Site("<tr><td><a href=/t/{k}>{name}</a></td></tr>" + _ADVERT, size="NULL", date="NULL", seeders="NULL", leechers="NULL"),
    "audiobookbay": Site("<div class=post><div class=postTitle><h2><a href=/t/{k}>{name}</a></h2></div><div class=postContent><p>a</p><p>b</p><p>Posted: {d} Mar 2024\n File Size: {n} MBs</p></div></div>", "{rows}", category="Books", size="n * 1048576", date=_MARCH_MS, seeders="NULL", leechers="NULL"),
    "blueroms": Site("<div class=card><h4 class=card-title><a href=/g>{name}</a></h4><p><strong>Platform:</strong> NES</p><p><strong>Size:</strong> {size}</p><div class=card-footer><a href=/t/{k}>d</a></div></div>", "<div class=row><div class=col-xs-12>{rows}</div></div>", category="Games", date="NULL", seeders="NULL", leechers="NULL", name="name || ' - NES'"),
    "filemood": Site("<tr><td class=dn-title>{name}</td><td class=dn-btn><div><a class=btn-success href='/n-{hash}.html'>g</a></div></td><td class=dn-size>{size}</td><td class=dn-status>{seeders} / {leechers}</td></tr><tr><td class=dn-title>none</td></tr>", category="Other", magnet="made_magnet", url="'/n-' || hash || '.html'", date="NULL"),
    "linuxtracker": Site("<tr><td class=lista>i</td><td class=lista><a href='/index.php?page=torrent-details&amp;id={upper}'>{name}</a></td><td>d</td><td>{dmy}</td><td>{size}</td><td>u</td><td>{seeders}</td><td>{leechers}</td></tr><tr><td class=lista><a href='/index.php?page=torrent-details&amp;id=1'>side</a></td></tr>", category="Apps", magnet="made_magnet", url="'/index.php?page=torrent-details&id=' || upper(hash)", date="day"),
    "megapeer": Site("<tr class=table_fon><td>{d} Мая 21</td><td><a>d</a><a href=/t/{k}>{name}</a></td><td>{size}</td><td><img><font>{seeders}</font><img><font>{leechers}</font></td></tr><tr class=table_fon><td>x</td></tr>", "<div id=index><table><tbody>{rows}</tbody></table></div>", date=_RU_MS),
    "mypornclub": Site("<div class=torrent_element><div class=torrent_element_text_div><a>t</a><a href=/t/{k}><span class=torrent_element_text_span>{name}</span></a></div><div class=torrent_element_info><span>a</span><span class=teiv>{ago}</span><span>b</span><span class=teiv>{size}</span><span class='teiv teiv_seeders'>{seeders}</span><span class='teiv teiv_leechers'>{leechers}</span></div></div>", "<div class=torrents_list>{rows}</div>", category="Porn"),
    "xxxclub": Site("<li><span>c</span><span><a href=/torrents/details/{k}>{name}</a></span><span class=siz>{size}</span><span class=adde>{d} Mar 2024</span><span class=see>{seeders}</span><span class=lee>{leechers}</span></li><li><span>c</span><span>head</span></li>", "<div class=browsetableinside><ul>{rows}</ul></div>", category="Porn", url="'/torrents/details/' || k", date=_MARCH_MS),
    "xxxtracker": Site("<tr><td>{d} Мая 21</td><td><a href='{magnet}'></a><a>x</a><a href=/t/{k}>{name}</a></td><td>{size}</td><td><span>{seeders}</span><span>{leechers}</span></td></tr>" + _ADVERT, "<table><tbody><tr><th>head</th></tr>{rows}</tbody></table>", category="Porn", magnet="in_magnet", date=_RU_MS),
}


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


SITE_GROUPS = {group: [s for s in members if s in SITES] for group, members in SOURCE_GROUPS.items()}


def html_sites(spark: SparkSession, sf_dir: str, sources: list[str]) -> DataFrame:
    """Listings of the sources' pages: made, read in one pass each by its layout, normalised together."""
    made = _union([SITES[s].pages(spark, sf_dir).select(F.lit(s).alias("source"), "html") for s in sources])
    parsed = work_dir(spark, "sites")
    layouts.page_rows(made).write.partitionBy("source").parquet(parsed)
    rows = spark.read.parquet(parsed)
    return listings.normalize_all([layouts.row_listings(rows.where(F.col("source") == s), s) for s in sources], NOW_MS).select(*OUT)


def html_sites_sql(sources: list[str]) -> str:
    return f"WITH v AS ({VALUES_SQL}) " + " UNION ALL ".join(SITES[s].sql(s, layouts.LAYOUTS[s].base) for s in sources)


# Detail pages with a magnet or a hash, one for each source with a second fetch.
DETAIL_PAGES = {
    "1337x": "<ul><li><a href='{magnet}'>m</a></li></ul>", "anirena": "<div class=td-actions><a href='{magnet}'>go</a></div>", "bt4g": "<a href='//downloadtorrentfile.com/hash/{hash}?name=x'>f</a>", "therarbg": "<p><a href='{magnet}'>m</a></p>", "torrent9": "<a href=/x>x</a><a href='{magnet}'>m</a>",
    "torrentdownloads": "<a href='{magnet}'>m</a>", "zeromagnet": "<input id=input-magnet value='{magnet}'>", "oxtorrent": "<div class=btn-magnet><a href='{magnet}'>m</a></div>", "audiobookbay": "<table><tr><td>Info Hash:</td><td> {hash} </td></tr></table>", "blueroms": "<a id=magnet-button data-link='{b64}'>m</a>",
    "megapeer": "<a href='{magnet}'>m</a>", "mypornclub": "<a class=md_btn href='{magnet}'>m</a>", "xxxclub": "<a href='{magnet}'>m</a>", "any-other": "<a href=/y>y</a><a href='{magnet}'>first</a><a href='magnet:?xt=urn:btih:0'>second</a>",
}


def detail_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier's detail page at every source with a second fetch, resolved."""
    v = values(spark, sf_dir).withColumn("b64", F.base64(F.encode("magnet", "UTF-8")))
    made = [v.select(F.lit(s).alias("source"), F.concat(F.lit(f"{s}/"), "k").alias("detail_url"), _filled(html, []).alias("html")) for s, html in DETAIL_PAGES.items()]
    return layouts.detail_magnets(_union(made))


DETAIL_PAGES_SQL = f"""
  WITH v AS ({VALUES_SQL}), s AS (SELECT unnest([{', '.join(f"'{s}'" for s in DETAIL_PAGES)}]) AS source)
  SELECT source || '/' || k AS detail_url, CASE WHEN source NOT IN ('bt4g', 'audiobookbay') THEN in_magnet END AS resolved, CASE WHEN source IN ('bt4g', 'audiobookbay') THEN hash END AS resolved_hash FROM v, s
"""


def _bodies(v: DataFrame, item: Column, shape: str, most: int = ROWS_A_PAGE) -> DataFrame:
    """One JSON text for each ``most`` suppliers: their items as an array, put into ``shape``."""
    rows = v.select(F.floor(F.col("key") / most).alias("page"), "key", item.alias("item"))
    items = F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("key", "item"))), lambda x: x["item"]))
    head, _, tail = shape.partition("{items}")
    return rows.groupBy("page").agg(F.concat(F.lit(head), items, F.lit(tail)).alias("body"))


def _num(c: str) -> Column:
    return F.col(c).cast("long")


def _pick(options: list, key: Column) -> Column:
    return F.get(F.array(*map(F.lit, options)), (key % len(options)).cast("int"))


# Category codes of two sources, and what they mean.
TPB_CODES = [("101", "Music"), ("102", "Books"), ("201", "Movies"), ("205", "Series"), ("301", "Apps"), ("401", "Games"), ("501", "Porn"), ("601", "Books"), ("699", "Other"), ("999", None)]
KNABEN_CODES = [(1_000_001, "Music"), (2_500_000, "Series"), (3_000_000, "Movies"), (8_500_000, None), (9_999_999, "Books"), (10_000_000, "Other")]
MEDIA = [("software", "Apps"), ("texts", "Books"), ("movies", "Movies"), ("audio", "Other")]


def json_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings of the sources that answer in JSON: bodies made from the suppliers, read by each adapter, normalised."""
    v = values(spark, sf_dir)
    key, size = F.col("key"), F.col("key") * 1000 + 7
    alias = lambda **c: F.struct(*(x.alias(n) for n, x in c.items()))
    col = F.col
    made = {
        "tpb": _bodies(v, alias(id=col("k"), name=col("name"), info_hash=col("hash"), size=col("bytes"), seeders=col("seeders"), leechers=col("leechers"), num_files=F.lit("3"), added=col("stamp"), category=_pick([c for c, _ in TPB_CODES], key)), "{items}").unionByName(spark.createDataFrame([(-1, '[{"error": "No results returned"}]'), (-2, "429 Too Many Requests")], "page long, body string")),
        "yts": _bodies(v, alias(id=key, title=col("name"), title_long=F.when(key % 2 == 0, F.concat("name", F.lit(" (2020)"))), url=F.concat(F.lit("https://y/"), "k"), torrents=F.array(alias(hash=col("upper"), quality=F.lit("1080p"), type=F.lit("web"), video_codec=F.lit("x264"), size_bytes=size, seeds=col("seeders"), peers=col("leechers"), date_uploaded_unix=_num("stamp")), alias(hash=F.lit(""), quality=F.lit("no hash"), type=F.lit(""), video_codec=F.lit(""), size_bytes=size, seeds=col("seeders"), peers=col("leechers"), date_uploaded_unix=_num("stamp")))), '{"data": {"movies": {items}}}'),
        "knaben": _bodies(v, alias(title=col("name"), hash=F.when(key % 2 == 0, col("hash")), magnetUrl=col("magnet"), bytes=size, seeders=col("seeders"), peers=col("leechers"), date=F.replace(F.concat("iso", F.lit(":00Z")), F.lit(" "), F.lit("T")), categoryId=F.array(F.lit(99_000_000), _pick([c for c, _ in KNABEN_CODES], key)), details=F.concat(F.lit("https://k/"), "k")), '{"hits": {items}}'),
        "torrentscsv": _bodies(v, alias(name=col("name"), infohash=col("hash"), size_bytes=size, seeders=col("seeders"), leechers=col("leechers"), created_unix=_num("stamp")), '{"torrents": {items}}'),
        "subsplease": v.groupBy(F.floor(key / ROWS_A_PAGE).alias("page")).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", alias(release_date=F.lit("yesterday"), episode=F.lit("07"), page=F.concat(F.lit("show-"), "k"), downloads=F.array(alias(res=F.lit("720"), magnet=F.concat("magnet", F.lit("&xl="), "bytes")), alias(res=F.lit("480"), magnet=F.lit("")))).alias("a")))))).alias("body")),
        "bangumimoe": _bodies(v, alias(_id=col("k"), title=col("name"), infohash=F.when(key % 2 == 0, col("hash")).otherwise(""), magnet=col("magnet"), size=F.concat(F.lit(" "), "size"), seeders=col("seeders"), leechers=col("leechers"), publish_time=F.replace(F.concat("iso", F.lit(":00.000Z")), F.lit(" "), F.lit("T"))), '{"torrents": {items}}'),
        "internetarchive": _bodies(v, alias(identifier=F.concat(F.lit("id-"), "k"), title=col("name"), mediatype=_pick([m for m, _ in MEDIA], key), item_size=size, publicdate=F.replace(F.concat("iso", F.lit(":00Z")), F.lit(" "), F.lit("T")), btih=F.when(key % 3 != 0, col("upper"))), '{"response": {"docs": {items}}}'),
    }
    return listings.normalize_all([feeds.JSON_SOURCES[s](bodies) for s, bodies in made.items()], NOW_MS).select(*OUT)


def _listing_sql(source: str, where: str = "true", **given: str) -> str:
    c = {"name": "name", "size": "k * 1000 + 7", "seeders": "seeders", "leechers": "leechers", "date": "stamp", "magnet": "made_magnet", "category": "NULL", "url": "NULL"} | given
    return f"""SELECT '{source}:' || hash AS id, {c['name']} AS name, ({c['size']})::BIGINT AS size, ({c['seeders']})::BIGINT AS seeders, ({c['leechers']})::BIGINT AS leechers, ({c['date']})::BIGINT AS date_ms, {c['magnet']} AS magnet, hash AS info_hash, '{source}' AS provider,
      ({c['category']})::VARCHAR AS category, ({c['url']})::VARCHAR AS detail_url, false AS needs_magnet FROM v WHERE {where}"""


def _codes_sql(codes: list) -> str:
    return "[" + ", ".join("NULL" if b is None else f"'{b}'" for _, b in codes) + f"][k % {len(codes)} + 1]"


_MOVIE = "name || CASE WHEN k % 2 = 0 THEN ' (2020)' ELSE '' END || ' [1080p] [web] [x264]'"
JSON_SITES_SQL = f"WITH v AS ({VALUES_SQL}) " + " UNION ALL ".join([
    _listing_sql("tpb", category=_codes_sql(TPB_CODES), url="'https://thepiratebay.org/description.php?id=' || k"),
    _listing_sql("yts", name=_MOVIE, magnet=f"'magnet:?xt=urn:btih:' || hash || '&dn=' || {encode_sql('(' + _MOVIE + ')')}", category="'Movies'", url="'https://y/' || k || '?movieid=' || k || '&infohash=' || hash"),
    _listing_sql("knaben", date=_ISO_MS, magnet="in_magnet", category=_codes_sql(KNABEN_CODES), url="'https://k/' || k"),
    _listing_sql("torrentscsv", category="'Other'"),
    _listing_sql("subsplease", name="name || ' [720p]'", date=f"{NOW_MS - 86_400_000}", magnet="in_magnet || '&xl=' || (k * 1000 + 7)", seeders="NULL", leechers="NULL", category="'Anime'", url="'https://subsplease.org/show-' || k || '?ep=07&res=720'"),
    _listing_sql("bangumimoe", size="bytes", date=_ISO_MS, magnet="in_magnet", category="'Anime'", url="'https://bangumi.moe/torrent/' || k"),
    _listing_sql("internetarchive", "k % 3 <> 0", date=_ISO_MS, seeders="NULL", leechers="NULL", category=_codes_sql(MEDIA), url="'https://archive.org/details/id-' || k"),
])


def dependent_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source with a second step: each mirror's search names 20 releases, of which the first 15 are taken; each release has two listings."""
    v = values(spark, sf_dir)
    host = lambda page: F.concat(F.lit("https://m"), page.cast("string"), F.lit(".test"))
    page = F.floor(F.col("key") / ROWS_A_PAGE)
    searches = _bodies(v, F.struct(F.col("key").alias("id")), "{items}").select(F.col("page").alias("mirror_rank"), F.concat(host(F.col("page")), F.lit("/api/v1/app/search/releases?query=x")).alias("url"), "body")
    item = lambda label, hashed: F.struct(hashed.alias("hash"), F.col("magnet"), (F.col("key") * 1000 + 7).alias("size"), F.col("seeders"), F.col("leechers"), label.alias("label"), F.replace(F.concat("iso", F.lit(":00Z")), F.lit(" "), F.lit("T")).alias("created_at"), F.struct(F.concat(F.lit("a-"), "k").alias("alias"), F.struct(F.lit("").alias("main"), F.col("name").alias("english")).alias("name")).alias("release"))
    bodies = F.to_json(F.array(item(F.concat("name", F.lit(" HD")), F.col("hash")), item(F.lit(""), F.col("hash")), item(F.lit("no hash"), F.lit(""))))
    details = v.select(page.alias("mirror_rank"), F.concat(host(page), F.lit("/api/v1/anime/torrents/release/"), "k").alias("url"), bodies.alias("body"))
    asked = feeds.release_ids(searches).select("mirror_rank", F.concat(host(F.col("mirror_rank")), F.lit("/api/v1/anime/torrents/release/"), F.col("id").cast("string")).alias("url"))
    pages = searches.unionByName(details.join(asked, ["mirror_rank", "url"], "left_semi"))
    return listings.normalize(feeds.anilibria_pages(pages, "mirror_rank"), NOW_MS, "mirror_rank").select("mirror_rank", *OUT)


DEPENDENT_RELEASES_SQL = f"""
  WITH v AS ({VALUES_SQL}), r AS (SELECT *, row_number() OVER (PARTITION BY k // 20 ORDER BY k) AS place FROM v)
  SELECT k // 20 AS mirror_rank, 'anilibria:' || hash AS id, name || ending AS name, k * 1000 + 7 AS size, seeders, leechers, {_ISO_MS} AS date_ms, in_magnet AS magnet, hash AS info_hash, 'anilibria' AS provider, 'Anime' AS category,
    'https://m' || (k // 20) || '.test/anime/releases/release/a-' || k AS detail_url, false AS needs_magnet
  FROM r, (VALUES (' HD'), ('')) e(ending) WHERE place <= 15
"""


# A page that is no search result, and one whose table holds no listing.
ANTI_BOT, NO_LISTINGS = "<html><body><p>Checking your browser</p></body></html>", "<table><tbody><tr><td>menu</td></tr></tbody></table>"


def mirror_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of sources with mirrors: (source, mirror_rank, body, error), the first mirror of some without listings."""
    none = F.lit(None).cast("string")

    def filled(source: str, rank: int) -> DataFrame:
        site = SITES[source]
        if source in ("uindex", "xxxclub"):  # a second container, whose rows don't count
            head, tail = site.around.split("{rows}")
            site = replace(site, around=site.around + head + site.row.replace("{name}", "second {name}") + tail)
            site = replace(site, around=re.sub(r"\{(?!rows)\w+\}", "1", site.around))
        return site.pages(spark, sf_dir).select(F.lit(source).alias("source"), F.lit(rank).alias("mirror_rank"), F.col("html").alias("body"), none.alias("error"))

    told = spark.createDataFrame([
        ("1337x", 0, ANTI_BOT, None), ("limetorrents", 0, None, "ETIMEDOUT"), ("limetorrents", 1, "", None), ("eztv", 0, NO_LISTINGS, None), ("eztv", 1, NO_LISTINGS, None), ("torrentdownloads", 0, ANTI_BOT, None), ("torrentdownloads", 1, None, "ECONNRESET"),
        ("bt4g", 0, ANTI_BOT, None), ("anirena", 0, "", None), ("nyaa", 0, ANTI_BOT, None), ("tpb", 0, None, "ECONNRESET"), ("yts", 0, "{}", None), ("bangumimoe", 0, "{}", None), ("torrent9", 0, NO_LISTINGS, None),
    ], "source string, mirror_rank int, body string, error string")
    return _union([told, filled("1337x", 1), filled("1337x", 3), filled("limetorrents", 2), filled("uindex", 1), filled("xxxclub", 0)])


MIRRORED = ["1337x", "limetorrents", "eztv", "torrentdownloads", "bt4g", "anirena", "nyaa", "tpb", "yts", "bangumimoe", "torrent9", "uindex", "xxxclub", "knaben"]


def mirror_search(spark: SparkSession, sf_dir: str):
    from ..engine import Engine

    return Engine(spark, NOW_MS).search("anything", mirror_pages(spark, sf_dir), providers=MIRRORED, match=False)


MIRROR_LISTINGS_SQL = f"WITH v AS ({VALUES_SQL}) " + " UNION ALL ".join(f"SELECT id, name, provider, detail_url FROM ({SITES[s].sql(s, base)})" for s, base in (("1337x", "https://1337x.st"), ("limetorrents", "https://limetorrents.pro"), ("uindex", "https://uindex.to"), ("xxxclub", "https://xxxclub.to")))
# What the sources' errors must read.
MIRROR_STATUS_SQL = """
  WITH n AS (SELECT count(*) AS n FROM supplier), s(id, name, error) AS (VALUES
    ('1337x', '1337x', NULL), ('limetorrents', 'LimeTorrents', NULL), ('eztv', 'EZTV', 'EZTV unreachable (no_results_parsed; no_results_parsed)'), ('torrentdownloads', 'TorrentDownloads', 'TorrentDownloads unreachable (no_container; ECONNRESET)'),
    ('bt4g', 'Bt4g', 'Bt4g unreachable ()'), ('anirena', 'AniRena', 'anirena unreachable (no_html)'), ('nyaa', 'NYAA', NULL), ('tpb', 'The Pirate Bay', 'TPB unreachable (ECONNRESET)'), ('yts', 'YTS', NULL), ('bangumimoe', 'Bangumi.Moe', 'bangumimoe unreachable (bad_response)'),
    ('torrent9', 'Torrent9', 'Torrent9 unreachable (no_results_parsed)'), ('uindex', 'UIndex', NULL), ('xxxclub', 'XXXClub', NULL), ('knaben', 'Knaben', NULL))
  SELECT id, name, CASE WHEN error IS NULL THEN 'ok' ELSE 'error' END AS status, CASE WHEN id IN ('1337x', 'limetorrents', 'uindex', 'xxxclub') THEN n ELSE 0 END AS count, error FROM s, n
"""
