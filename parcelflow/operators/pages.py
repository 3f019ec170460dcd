"""Extraction from captured pages: links, labelled items, table rows, blocks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelflow.functions import dates
from parcelflow.functions.text import group
from parcelflow.operators import markup

def page_links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'(?i)href="([^"]*)"'), F.lit(1))


def pdf_only(links: Column) -> Column:
    return F.filter(links, lambda x: F.lower(x).endswith(".pdf"))


def absolute(base: Column, link: Column) -> Column:
    root = F.concat(F.try_parse_url(base, F.lit("PROTOCOL")), F.lit("://"), F.try_parse_url(base, F.lit("AUTHORITY")))
    return F.when(link.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), link).when(link.startswith("/"), F.concat(root, link)).otherwise(F.concat(root, F.lit("/"), link))


def label_values(html: Column, longest: int = 120) -> Column:
    """'label: value' list items and paragraphs under a length, tags left out, in page order."""
    items = F.regexp_extract_all(html, F.lit(r"(?is)<(?:li|p)\b[^>]*>(.*?)</(?:li|p)>"), F.lit(1))
    plain = F.transform(items, lambda x: F.trim(F.regexp_replace(x, "<[^>]*>", "")))
    return F.filter(plain, lambda x: (F.length(x) < longest) & x.rlike(r"^[^:]+:\s*\S"))


def plain(c: Column) -> Column:
    """Text without tags, runs of white space as one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", ""), r"\s+", " "))


#: What a paragraph may hold: anything but another paragraph's tags.
INSIDE = "((?:[^<]|<[^/p]|</[^p])*)"


def paragraph_pairs(html: Column, column: str | None = None) -> Column:
    """array<struct<label, value>>: each label paragraph with the value paragraph after it, in page order.

    column: the class of the elements whose first two paragraphs are a label and its value; without it a label is a
    paragraph that ends with a colon. Pairs without a label are left out.
    """
    head = rf'class="(?:[^"]* )?{column}(?: [^"]*)?"[^>]*>\s*<p\b[^>]*>{INSIDE}</p>' if column else r"<p\b[^>]*>([^<]*:\s*)</p>"
    pattern = F.lit(rf"(?is){head}\s*<p\b[^>]*>{INSIDE}</p>")
    label = F.transform(F.regexp_extract_all(html, pattern, F.lit(1)), lambda x: F.trim(F.regexp_replace(plain(x), r":+$", "")))
    value = F.transform(F.regexp_extract_all(html, pattern, F.lit(2)), plain)
    return F.filter(F.arrays_zip(label.alias("label"), value.alias("value")), lambda x: x["label"] != "")


def documents(html: Column, base: Column) -> Column:
    """The page's links to PDF files, absolute, in page order."""
    return F.transform(pdf_only(page_links(html)), lambda x: absolute(base, x))


def list_items(html: Column) -> Column:
    items = F.regexp_extract_all(html, F.lit(r"(?is)<li\b[^>]*>(.*?)</li>"), F.lit(1))
    return F.transform(items, lambda x: F.trim(F.regexp_replace(x, "<[^>]*>", "")))


class _Table(HTMLParser):
    def __init__(self):
        super().__init__()
        self.rows, self.row, self.cell, self.depth = [], None, None, 0

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.row = []
        elif tag in ("td", "th") and self.row is not None:
            self.cell = []

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell is not None:
            self.row.append(" ".join("".join(self.cell).split()))
            self.cell = None
        elif tag == "tr" and self.row is not None:
            self.rows.append(self.row)
            self.row = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)


class _Blocks(HTMLParser):
    """Text of each article, section or card, headings apart."""

    def __init__(self, tags: tuple[str, ...]):
        super().__init__()
        self.tags, self.blocks, self.open, self.title = tags, [], [], False

    def handle_starttag(self, tag, attrs):
        if tag in self.tags or any(k == "class" and v and "card" in v.split() for k, v in attrs):
            self.open.append((tag, {"title": "", "text": "", "links": ""}))
        for _, block in self.open:
            block["links"] += " ".join(f" {v}" for k, v in attrs if k == "href" and v)
        self.title = tag in ("h1", "h2", "h3", "h4")

    def handle_endtag(self, tag):
        if self.open and self.open[-1][0] == tag:
            block = self.open.pop()[1]
            self.blocks.append({k: " ".join(v.split()) for k, v in block.items()})
        if tag in ("h1", "h2", "h3", "h4"):
            self.title = False

    def handle_data(self, data):
        if self.open:
            self.open[-1][1]["title" if self.title else "text"] += " " + data


def table_rows(pages: DataFrame, least: int = 2) -> DataFrame:
    """(page_id, row, cells): table rows after the header, short ones dropped.

    From the stream of tags in built-in expressions; pages that it cannot decide go through a parser.
    """
    plain = markup.decidable(F.col("html"))
    found = pages.where(plain).select("page_id", F.posexplode(F.slice(markup.rows_of(F.col("html")), 2, 1 << 30)).alias("row", "cells"))
    return found.where(F.size("cells") >= least).unionByName(parsed_rows(pages.where(~plain), least))


def parsed_rows(pages: DataFrame, least: int = 2) -> DataFrame:
    """table_rows() by a parser, page by page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for pid, html in zip(b["page_id"], b["html"], strict=True):
                t = _Table()
                t.feed(html or "")
                out += [(pid, i, r) for i, r in enumerate(t.rows[1:]) if len(r) >= least]
            yield pd.DataFrame(out, columns=["page_id", "row", "cells"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, row int, cells array<string>")


def parsed_blocks(pages: DataFrame, tags: tuple[str, ...], id_pattern: str | None) -> DataFrame:
    """(page_id, ord, title, text, block_id) of blocks() by a parser, page by page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for pid, html in zip(b["page_id"], b["html"], strict=True):
                p = _Blocks(tags)
                p.feed(html or "")
                seen = set()
                for x in p.blocks:
                    found = re.search(id_pattern, x["links"]) if id_pattern else None
                    key = found[1] if found else None if id_pattern else x["title"]
                    if x["title"] and key and key not in seen:
                        seen.add(key)
                        out.append((pid, len(seen) - 1, x["title"], x["text"], found[1] if found else None))
            yield pd.DataFrame(out, columns=["page_id", "ord", "title", "text", "block_id"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, ord int, title string, text string, block_id string")


def blocks(pages: DataFrame, tags: tuple[str, ...] = ("article", "section"), id_pattern: str | None = None, as_of: str = "2024-01-31") -> DataFrame:
    """(page_id, ord, title, text, block_id, date_time, block_status) of repeated blocks.

    A block without a title is skipped, and so is one without an id where id_pattern (over its links) is given; a repeated id,
    or without a pattern a repeated title, counts once. The date is the labelled or else the first one of the text, the status
    that of block_status() with the text's status word. From the stream of tags in built-in expressions; pages that it cannot
    decide go through a parser.
    """

    plain = markup.decidable(F.col("html"))
    every = markup.blocks_of(F.col("html"), tags)
    named = F.transform(every, lambda x: F.struct(x["title"].alias("title"), x["text"].alias("text"), (F.nullif(F.regexp_extract(x["links"], id_pattern, 1), F.lit("")) if id_pattern else F.lit(None).cast("string")).alias("block_id")))
    kept = F.filter(named, lambda x: (x["title"] != "") & (x["block_id"].isNotNull() if id_pattern else F.lit(True)))
    rows = pages.where(plain).select("page_id", kept.alias("_all"))
    key = "block_id" if id_pattern else "title"
    once = F.filter("_all", lambda x, i: F.array_position(F.transform("_all", lambda y: y[key]), x[key]) == i + 1)
    found = rows.select("page_id", F.posexplode(once).alias("ord", "b")).select("page_id", "ord", "b.*").unionByName(parsed_blocks(pages.where(~plain), tags, id_pattern))
    word = F.lower(F.regexp_extract("text", r"(?i)\b(sold back to mortgagee|3rd party purchase|sold|cancell?ed|postponed|active|withdrawn)\b", 1))
    said = dates.block_status(F.col("text"), word)
    first = F.coalesce(group(F.col("text"), rf"({dates.NUMERIC})"), group(F.col("text"), dates.CHUNK))
    return found.select("page_id", "ord", "title", "text", "block_id", F.coalesce(F.nullif(said["date_time"], F.lit("")), F.when(said["block_status"] != "postponed", first), F.lit("")).alias("date_time"), said["block_status"].alias("block_status"))


def expand_portfolio(pages: DataFrame, parcels: Column) -> DataFrame:
    """Index pages replaced by a row for each parcel link; pages without any stay."""
    rows = pages.withColumn("_parcels", parcels)
    many = rows.select(*pages.columns, F.explode("_parcels").alias("parcel"))
    return many.unionByName(rows.where(F.coalesce(F.size("_parcels"), F.lit(0)) == 0).select(*pages.columns, F.lit(None).cast("string").alias("parcel")))


def merge_detail(listings: DataFrame, details: DataFrame, key: str, fields: list[str]) -> DataFrame:
    d = details.select(key, *(F.col(f).alias(f"_d_{f}") for f in fields))
    out = listings.join(d, key, "left")
    for f in fields:
        out = out.withColumn(f, F.coalesce(F.nullif(F.col(f"_d_{f}"), F.lit("")), F.col(f)))
    return out.drop(*(f"_d_{f}" for f in fields))

