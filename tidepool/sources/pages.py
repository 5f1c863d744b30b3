"""Pages: HTML to text, links and images; listings; records and catalogues."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepool.functions import text as T

BLOCK_TAGS = {"p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "table", "ul", "ol"}


class PageReader(HTMLParser):
    """Visible text with a line for each block, links with their text, and images."""

    def __init__(self, base: str):
        super().__init__(convert_charrefs=True)
        self.base, self.hidden, self.link = base, 0, None
        self.out: list[str] = []
        self.links: list[dict] = []
        self.images: list[dict] = []

    def handle_starttag(self, tag, attrs):
        at = dict(attrs)
        if tag in ("script", "style"):
            self.hidden += 1
        elif tag == "a" and at.get("href"):
            self.link = {"href": urljoin(self.base, at["href"]), "text": ""}
        elif tag == "img" and (source := at.get("src") or at.get("data-src")):
            self.images.append({"src": urljoin(self.base, source), "alt": at.get("alt") or ""})
        if tag in BLOCK_TAGS:
            self.out.append("\n")

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif tag == "a" and self.link:
            self.links.append(self.link | {"text": self.link["text"].strip()})
            self.link = None
        if tag in BLOCK_TAGS:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)
            if self.link:
                self.link["text"] += data

    def text(self) -> str:
        return "\n".join(x for line in "".join(self.out).splitlines() if (x := " ".join(line.split())))


def parse_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, text, links, images) of raw pages; null HTML is an empty page."""
    links = pa.list_(pa.struct([("href", pa.string()), ("text", pa.string())]))
    images = pa.list_(pa.struct([("src", pa.string()), ("alt", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for url, html in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                reader = PageReader(url or "")
                reader.feed(html or "")
                reader.close()
                rows.append((reader.text(), reader.links, reader.images))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate([pa.string(), links, images]))], [id_col, "text", "links", "images"])

    kind = dict(pages.dtypes)[id_col]
    return pages.select(id_col, url_col, html_col).mapInArrow(run, f"`{id_col}` {kind}, text string, links array<struct<href:string,text:string>>, images array<struct<src:string,alt:string>>")


def read_records(spark: SparkSession, path: str, unsorted_track: str) -> DataFrame:
    """Page records of JSON files; those of the unsorted track are marked to be skipped as notices."""
    raw = spark.read.json(path, multiLine=True)
    return raw.withColumn("skip_reason", F.when(F.col("track") == unsorted_track, "notice")).withColumn("ord", F.col("_metadata.file_path"))


def listing(html: Column, pattern: str = r'<a[^>]+href="([^"]*/(\d+)\.html)"[^>]*>([^<]+)</a>') -> Column:
    """Entries (url, id, title) of a listing page, by a pattern of three groups."""
    columns = [T.found(html, pattern, g) for g in (1, 2, 3)]
    return F.transform(F.arrays_zip(*[c.alias(n) for c, n in zip(columns, ("url", "id", "title"), strict=True)]), lambda e: F.struct(e["url"].alias("url"), e["id"].cast("long").alias("id"), T.squeezed(T.unescape(e["title"])).alias("title")))


def union_categories(listed: DataFrame) -> DataFrame:
    """One row an id: its categories from all listings. listed: id, categories."""
    return listed.groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("categories")))).alias("categories"))


def asset_links(pages: DataFrame) -> DataFrame:
    """(page_id, url): distinct asset links of a page, links before media. pages: page_id, links, media (both with an address)."""
    both = F.concat(F.transform("links", lambda x: x["href"]), F.transform("media", lambda x: x["url"]))
    return pages.select("page_id", F.posexplode(F.array_distinct(F.filter(both, lambda u: T.is_asset(u)))).alias("ord", "url"))


def reach(start: DataFrame, links: DataFrame, steps: int = 3) -> DataFrame:
    """(url, depth): pages within `steps` links of the start. links: source, target. Each step is one join and an anti-join."""
    seen = start.select("url", F.lit(0).alias("depth"))
    edge = seen
    for d in range(1, steps + 1):
        new = edge.join(links, edge["url"] == links["source"]).select(F.col("target").alias("url")).distinct().join(seen, "url", "left_anti")
        edge = new.select("url", F.lit(d).alias("depth"))
        seen = seen.unionByName(edge)
    return seen


def better_duplicates(records: DataFrame, keys: list[str], rank: Column, marked: Column, size: Column, place: str = "ord") -> DataFrame:
    """Of records with equal keys the best: by rank, then whether marked, then size, then the first."""
    best = Window.partitionBy(*keys).orderBy(rank.desc(), marked.desc(), size.desc(), F.col(place))
    return records.withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n")


def first_category(categories: Column, names: dict[int, str], fallback: tuple[int, str], otherwise: str) -> Column:
    """The label of the first category, by the order of names; a fallback category; else `otherwise`."""
    label = F.when(F.array_contains(categories, fallback[0]), fallback[1]).otherwise(otherwise)
    for key, name in reversed(names.items()):
        label = F.when(F.array_contains(categories, key), name).otherwise(label)
    return F.coalesce(label, F.lit(otherwise))


def in_year(listed: Column, date: Column, categories: Column, title: Column, year: int, nav: list[int], track: list[int]) -> Column:
    """Whether a page belongs to a year: listed for it; else not dated before it, and of a category (and date or title) that tells."""
    start = f"{year}-01-01"
    day = F.substring(F.coalesce(date, F.lit("")), 1, 10)
    some = lambda ids: F.arrays_overlap(F.coalesce(categories, F.array().cast("array<int>")), F.array(*map(F.lit, ids)))
    early = (day != "") & (day < start)
    return F.coalesce(listed, F.lit(False)) | (~early & ((some(nav + track) & (day >= start)) | (some(track) & F.contains(title, F.lit(str(year))))))


def page_markdown(title: Column, url: Column, date: Column, text: Column) -> Column:
    return F.concat_ws("\n", F.concat(F.lit("# "), title), F.lit(""), F.concat(F.lit("- "), url), F.concat(F.lit("- "), date), F.lit(""), text)
