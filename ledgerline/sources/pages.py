"""Text, titles and links of landed web pages, and the link frontier."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import text as T
from ledgerline.session import checkpointed

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class _Page(HTMLParser):
    """Collects text lines, the title, the first heading and the links of a page."""

    hidden = ("script", "style", "noscript")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.skip = 0
        self.lines: list[str] = []
        self.parts: dict[str, list[str]] = {}
        self.open: list[str] = []
        self.links: list[list[str]] = []
        self.in_link = False

    def handle_starttag(self, tag, attrs):
        if tag in self.hidden:
            self.skip += 1
        elif tag in ("title", "h1"):
            if tag not in self.parts:
                self.parts[tag] = []
                self.open.append(tag)
        elif tag == "a":
            href = dict(attrs).get("href")
            self.in_link = href is not None
            if self.in_link:
                self.links.append([href, ""])

    def handle_endtag(self, tag):
        if tag in self.hidden:
            self.skip = max(0, self.skip - 1)
        elif tag in self.open:
            self.open.remove(tag)
        elif tag == "a":
            self.in_link = False

    def handle_data(self, data):
        if self.skip:
            return
        lines = [line.strip() for line in data.splitlines()]
        self.lines += [line for line in lines if line]
        word = " ".join(data.split())
        if not word:
            return
        for tag in self.open:
            self.parts[tag].append(word)
        if self.in_link:
            self.links[-1][1] = (self.links[-1][1] + " " + word).strip()


PAGE = "page_id long, url string, title string, text string, links array<struct<href:string,anchor:string>>"


#: Pages whose text and links a task holds at once.
PAGES_AT_ONCE = 64
#: Pages reach a task few at a time.
FEW = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(PAGES_AT_ONCE)}


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in (whole.iloc[start:start + PAGES_AT_ONCE] for whole in batches for start in range(0, max(len(whole), 1), PAGES_AT_ONCE)):
        rows = []
        for page_id, url, html in zip(batch["page_id"], batch["url"], batch["html"]):
            page = _Page()
            page.feed(html or "")
            page.close()
            title = " ".join(page.parts.get("h1", [])) or " ".join(page.parts.get("title", [])) or url
            links = []
            for href, anchor in page.links:
                try:
                    links.append({"href": urljoin(url or "", href), "anchor": anchor})
                except ValueError:
                    continue
            rows.append((page_id, url, title, "\n".join(page.lines), links))
        yield pd.DataFrame(rows, columns=["page_id", "url", "title", "text", "links"])


def page_texts(pages: DataFrame) -> DataFrame:
    """Title, visible text and resolved links of each page; pages stay in their task."""
    return pages.select("page_id", "url", "html").mapInPandas(_read, PAGE)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))


def allowed(url: Column, domains: list[str]) -> Column:
    """True for the listed hosts and the hosts below them."""
    name = host(url)
    hit = F.lit(False)
    for domain in domains:
        hit = hit | (name == domain.lower()) | name.endswith("." + domain.lower())
    return hit


def relevant(anchor: Column, url: Column, keywords: list[str]) -> Column:
    value = T.folded(F.concat_ws(" ", anchor, url))
    hit = F.lit(False)
    for word in keywords:
        hit = hit | F.contains(value, F.lit(word.lower()))
    return hit


def candidate_links(pages: DataFrame, domains: list[str], keywords: list[str]) -> DataFrame:
    """Links of pages that may be followed, each target once with its first anchor."""
    links = pages.select("page_id", F.posexplode("links").alias("pos", "l")).select(
        "page_id", "pos", F.col("l.href").alias("href"), F.col("l.anchor").alias("anchor")
    )
    usable = links.filter(allowed(F.col("href"), domains) & relevant(F.col("anchor"), F.col("href"), keywords))
    return usable.groupBy("href").agg(
        F.min_by(F.struct("page_id", "anchor"), F.struct("page_id", "pos")).alias("from")
    ).select("href", F.col("from.page_id").alias("page_id"), F.col("from.anchor").alias("anchor"))


def frontier(
    pages: DataFrame, roots: DataFrame, domains: list[str], keywords: list[str],
    depth: int = 2, limit: int | None = None,
) -> DataFrame:
    """Landed pages reachable from the roots within `depth` links, with their depth.

    One join per depth; addresses seen before are left out. Pages are read once,
    few at a time, and their links written; no step holds their texts.
    """
    pages = checkpointed(pages.select("page_id", "url", "links"), **FEW)
    reached = checkpointed(roots.select("url").distinct().withColumn("depth", F.lit(0)))
    last = reached
    for step in range(1, depth + 1):
        source = pages.join(last.select("url"), "url", "left_semi")
        found = candidate_links(source, domains, keywords).select(F.col("href").alias("url"))
        fresh = found.distinct().join(reached.select("url"), "url", "left_anti").withColumn("depth", F.lit(step))
        last = checkpointed(fresh)
        reached = reached.unionByName(last)
    if limit:
        reached = reached.orderBy("depth", "url").limit(limit)
    return reached.join(pages.select("url", "page_id"), "url", "left")
