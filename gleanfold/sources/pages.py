"""HTML pages to rows: parsing is the one step that isn't an expression; everything after it is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html import parse


def page_facts(pages: DataFrame, *keep: str, html_col: str = "html", unclosed: bool = True) -> DataFrame:
    """title, heading, first link, numbers of links and paragraphs of each page; null html counts as empty. unclosed: see parse."""
    kinds = dict(pages.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in keep), "title string, heading string, first_href string, n_links long, n_paragraphs long"])

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for html in pdf[html_col]:
                d = parse(html, unclosed)
                title, heading, links = d.first("title"), d.first("h1"), d.select("a[href]")
                rows.append((title and title.text().strip(), heading and heading.text().strip(), links[0].attrs["href"] if links else None, len(links), len(d.select("p"))))
            facts = pd.DataFrame(rows, columns=["title", "heading", "first_href", "n_links", "n_paragraphs"], index=pdf.index)
            yield pd.concat([pdf[list(keep)], facts], axis=1)

    return pages.select(*keep, html_col).mapInPandas(run, schema)


def row_pairs(cells: F.Column) -> F.Column:
    """Records that take two rows each: [a, b, c, d] to [(a, b), (c, d)]; an odd last row is left out."""
    n = F.size(cells)
    return F.when(n >= 2, F.transform(F.sequence(F.lit(0), n - 2, F.lit(2)), lambda i: F.struct(F.get(cells, i).alias("first"), F.get(cells, i + 1).alias("second")))).otherwise(F.array())


def sniff(cells: F.Column, pattern: str, nth: int = 0) -> F.Column:
    """The nth cell that looks like the pattern, wherever it stands."""
    return F.get(F.filter(cells, lambda c: c.rlike(pattern)), F.lit(nth))
