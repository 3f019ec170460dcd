"""Tables and blocks of pages from a stream of tags, in built-in expressions; a page that these cannot decide is told apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A script or style with its content, a comment, a document type, a tag, or text.
TOKEN = r"(?is)<(?:script|style)\b[^<>]*>.*?</(?:script|style)\s*>|<!--[^<>]*-->|<!doctype[^<>]*>|</?[a-z][^<>]*>|[^<]+"
#: The character references that are resolved here, the ampersand last.
REFERENCES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", "\u00a0"), ("&copy;", "\u00a9"), ("&middot;", "\u00b7"), ("&amp;", "&"))
HEADINGS = ("h1", "h2", "h3", "h4")
_KNOWN = "|".join(r[1:-1] for r, _ in REFERENCES)


def decidable(html: Column) -> Column:
    """Whether the token stream has all that a parser would see.

    Not so: text that is no token, character references other than REFERENCES, tags with odd or single quotes, unquoted links or
    classes, closed-at-once tags that are not void, scripts left open or with a tag's sign after the head, elements that hold raw text.
    """
    x = F.coalesce(html, F.lit(""))
    tags = F.regexp_extract_all(x, F.lit(r"(?i)</?[a-z][^<>]*>"), F.lit(0))
    quotes = lambda t: (F.length(t) - F.length(F.replace(t, F.lit('"'), F.lit("")))) % 2 == 1
    outside = F.regexp_replace(x, r"(?is)<(script|style)\b[^<>]*>.*?</\1\s*>", "")
    body = F.regexp_replace(x, r"(?is)<head\b.*?</head\s*>", "")
    odd = (
        (F.regexp_replace(x, TOKEN, "") != "") | x.rlike("[\x1c-\x1f]") | outside.rlike(rf"&(?!(?:{_KNOWN});)[#a-zA-Z]") | outside.rlike(r"(?i)<(script|style|textarea|xmp|iframe|noembed|noframes|plaintext)\b")
        | x.rlike(r"(?i)<title\b[^<>]*>[^<]*<(?!/title)") | x.rlike(r"(?i)<(?!(?:br|hr|img|input|meta|link)\b)[a-z][^<>]*/>") | x.rlike(r"(?is)<(script|style)\b[^<>]*>(?:(?!</(script|style)).)*</(?!\1)(script|style)")
        | body.rlike(r"(?is)<(script|style)\b[^<>]*>[^<]*<(?!/\1)") | F.exists(tags, lambda t: quotes(t) | F.contains(t, F.lit("'")) | t.rlike(r'(?i)\s(href|class)\s*=\s*[^"\s]'))
    )
    return ~odd


def resolved(text: Column) -> Column:
    for name, value in REFERENCES:
        text = F.replace(text, F.lit(name), F.lit(value))
    return text


def squeezed(text: Column) -> Column:
    """Runs of any white space as one space, none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", "")


def stream(html: Column) -> Column:
    """array<struct<kind, name, text, card, links>>: starts (s), ends (e), texts (t) and scripts or styles (r) in order; comments are left out."""
    tokens = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(TOKEN), F.lit(0))
    tokens = F.filter(tokens, lambda t: ~t.startswith("<!"))

    def read(t: Column) -> Column:
        tag = t.startswith("<")
        name = F.lower(F.regexp_extract(t, r"^</?([a-zA-Z][^\s/>]*)", 1))
        raw = tag & name.isin("script", "style") & t.rlike(r"(?is)^<[^<>]*>.*</[^<>]*>$")
        kind = F.when(raw, "r").when(~tag, "t").when(t.startswith("</"), "e").otherwise("s")
        text = F.when(raw, F.regexp_replace(t, r"(?is)^<[^<>]*>|</[^<>]*>$", "")).when(~tag, resolved(t)).otherwise("")
        value = lambda a: F.regexp_extract_all(t, F.lit(rf'(?i)\s{a}="([^"]*)"'), F.lit(1))
        card = F.exists(value("class"), lambda c: F.array_contains(F.split(c, r"\s+"), "card"))
        links = F.array_join(F.transform(F.filter(value("href"), lambda v: v != ""), lambda v: F.concat(F.lit(" "), resolved(v))), " ")
        start = tag & ~raw & ~t.startswith("</")
        return F.struct(kind.alias("kind"), name.alias("name"), text.alias("text"), F.when(start, card).otherwise(False).alias("card"), F.when(start, links).otherwise("").alias("links"))

    return F.transform(tokens, read)


def rows_of(html: Column) -> Column:
    """array<array<string>>: the cells of each table row that is closed, by one fold over the tags."""
    own = F.filter(stream(html), lambda t: t["kind"].isin("t", "r") | t["name"].isin("tr", "td", "th"))
    first = F.struct(F.array().cast("array<array<string>>").alias("rows"), F.lit(None).cast("array<string>").alias("row"), F.lit(None).cast("string").alias("cell"))

    def step(acc: Column, t: Column) -> Column:
        start, end, line = t["kind"] == "s", t["kind"] == "e", t["name"] == "tr"
        full = end & ~line & acc["cell"].isNotNull() & acc["row"].isNotNull()
        rows = F.when(end & line & acc["row"].isNotNull(), F.array_append(acc["rows"], acc["row"])).otherwise(acc["rows"])
        row = F.when(start & line, F.array().cast("array<string>")).when(end & line, F.lit(None)).when(full, F.array_append(acc["row"], squeezed(acc["cell"]))).otherwise(acc["row"])
        cell = F.when(start & ~line & acc["row"].isNotNull(), F.lit("")).when(end & ~line, F.lit(None)).when(t["kind"].isin("t", "r") & acc["cell"].isNotNull(), F.concat(acc["cell"], t["text"])).otherwise(acc["cell"])
        return F.struct(rows.alias("rows"), row.alias("row"), cell.alias("cell"))

    found = F.aggregate(own, first, step, lambda acc: acc["rows"])
    return F.when(html.rlike("(?i)<tr"), found).otherwise(F.array().cast("array<array<string>>"))


def blocks_of(html: Column, tags: tuple[str, ...]) -> Column:
    """array<struct<title, text, links>>: the closed elements of some tags, and of class card, in order of their ends.

    Headings' text is the title, of the innermost block; links count for all blocks around them.
    """
    block = "struct<tag:string,title:string,text:string,links:string>"
    first = F.struct(F.array().cast(f"array<{block}>").alias("open"), F.lit(False).alias("heading"), F.array().cast("array<struct<title:string,text:string,links:string>>").alias("done"))

    def step(acc: Column, t: Column) -> Column:
        start, end = t["kind"] == "s", t["kind"] == "e"
        pushed = F.when(t["name"].isin(*tags) | t["card"], F.array_append(acc["open"], F.struct(t["name"].alias("tag"), F.lit("").alias("title"), F.lit("").alias("text"), F.lit("").alias("links")))).otherwise(acc["open"])
        linked = F.when(t["links"] == "", pushed).otherwise(F.transform(pushed, lambda b: F.struct(b["tag"].alias("tag"), b["title"].alias("title"), b["text"].alias("text"), F.concat(b["links"], t["links"]).alias("links"))))
        n = F.size(acc["open"])
        last = F.get(acc["open"], n - 1)
        inner = F.slice(acc["open"], 1, F.greatest(n - 1, F.lit(0)))
        closes = end & (n > 0) & (last["tag"] == t["name"])
        more = lambda c, on: F.when(on, F.concat(last[c], F.lit(" "), t["text"])).otherwise(last[c]).alias(c)
        titled = acc["heading"] & (t["kind"] == "t")
        grown = F.array_append(inner, F.struct(last["tag"].alias("tag"), more("title", titled), more("text", ~titled), last["links"].alias("links")))
        opened = F.when(start, linked).when(closes, inner).when(t["kind"].isin("t", "r") & (n > 0), grown).otherwise(acc["open"])
        heading = F.when(start, t["name"].isin(*HEADINGS)).when(t["kind"] == "r", False).when(end & t["name"].isin(*HEADINGS), False).otherwise(acc["heading"])
        done = F.when(closes, F.array_append(acc["done"], F.struct(*(squeezed(last[c]).alias(c) for c in ("title", "text", "links"))))).otherwise(acc["done"])
        return F.struct(opened.alias("open"), heading.alias("heading"), done.alias("done"))

    return F.aggregate(stream(html), first, step, lambda acc: acc["done"])
