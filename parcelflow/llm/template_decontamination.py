"""Benchmark decontamination by template windows and slot consistency; DataFrame operations only.

Numbers, units and names become typed placeholders, so a question asked again with other values has the same template.
Windows of template tokens are hash-joined with the benchmark's; windows that are half placeholders or more say too little
by their template, so these are joined with their values and, twice as long, by template. For each alignment that has a hit
the tokens are compared one by one and the values in the slots must map one to one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelflow.llm.common import written

WINDOW, LEAST_COVER, LEAST_RUN = 8, 0.5, 13
#: Windows of one document and item at shifts that differ by this many tokens at most count together.
DRIFT = 8
#: Benchmark windows and items up to this many are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: Placeholders of names, numbers and units, and the sign that ends a kept value (of numbers and names until runs are joined).
NAME, NUMBER, UNIT, END = "\ue001", "\ue002", "\ue003", "\ue004"
NUMBER_END, NAME_END = "\ue005", "\ue006"
UNITS = "km|cm|mm|m|kg|mg|g|lb|lbs|oz|l|ml|miles?|met(?:er|re)s?|feet|foot|inch(?:es)?|hours?|minutes?|seconds?|days?|weeks?|months?|years?|dollars?|euros?|cents?|percent|degrees?"
UNIT_AT = rf"(?<=[0-9]\x20?)(?:{UNITS})(?![\p{{L}}])"
NUMBER_AT = r"[0-9]+(?:[.,:/][0-9]+)*"
NAME_AT = r"(?<=[\p{Ll}\p{Nd},;] )\p{Lu}[\p{L}'’]*"


#: Letters of scripts without spaces between words; each is a token.
ALONE = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"


def valued(text: Column) -> Column:
    """Lower-cased tokens, placeholders followed by their values. Adjacent names are one value, and so are adjacent numbers."""
    x = F.coalesce(text, F.lit(""))
    for pattern, mark, end in ((UNIT_AT, UNIT, END), (NUMBER_AT, NUMBER, NUMBER_END), (NAME_AT, NAME, NAME_END)):
        x = F.regexp_replace(x, pattern, f" {mark}$0{end} ")
    for mark, end in ((NUMBER, NUMBER_END), (NAME, NAME_END)):
        x = F.translate(F.regexp_replace(x, rf"{end}[^\p{{L}}\p{{N}}{NAME}-{NAME_END}]+{mark}", " "), end, END)
    return F.regexp_extract_all(F.lower(x), F.lit(rf"[{NAME}-{UNIT}][^{END}]*{END}|[{ALONE}]|[\p{{L}}\p{{N}}&&[^{ALONE}]]+"), F.lit(0))


def slot(token: Column) -> Column:
    return F.substring(token, 1, 1).between(NAME, UNIT)


def bare(token: Column) -> Column:
    """The token without its value."""
    return F.when(slot(token), F.substring(token, 1, 1)).otherwise(token)


def template(text: Column) -> Column:
    """The same tokens, placeholders without their values."""
    return F.transform(valued(text), bare)


def key(kind: str, width: int | Column, tokens: Column) -> Column:
    return F.xxhash64(F.lit(kind), F.lit(width) if isinstance(width, int) else width, tokens)


def heavy(t: Column, at: Column, width: int) -> Column:
    """Whether the window at a place is half placeholders or more."""
    return 2 * F.size(F.filter(F.slice(t, at + 1, width), slot)) >= width


def places(tokens: Column, width: int) -> Column:
    """The places at which a window of width tokens begins."""
    last = F.size(tokens) - width
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def keys_at(kind: str, tokens: Column, width: int, at: Column) -> Column:
    return F.transform(at, lambda i: F.struct(i.alias("i"), key(kind, width, F.slice(tokens, i + 1, width)).alias("h")))


def item_keys(items: DataFrame, width: int) -> DataFrame:
    """(item, kind, width, j, h) of each window of the items (item, t, v) that is looked up.

    t: windows of template tokens; those with fewer placeholders than half, the long ones that begin with more and hold a
    word, and whole items that are shorter than a window, or shorter than a long one with placeholders throughout.
    v: windows with values; those with placeholders for half, and whole items of placeholders only.
    """
    all_at, word = places(F.col("t"), width), lambda x: F.exists(x, lambda y: ~slot(y))
    parts = items.select("item", "t", "v", F.filter(all_at, lambda i: ~heavy(F.col("t"), i, width)).alias("light"), F.filter(all_at, lambda i: heavy(F.col("t"), i, width)).alias("dense"))
    long_at = F.filter("dense", lambda i: (i + 2 * width <= F.size("t")) & word(F.slice("t", i + 1, 2 * width)))
    found = [parts.select("item", F.lit(k).alias("kind"), F.lit(w).alias("width"), F.inline(keys_at(k, F.col(k), w, at))) for k, w, at in (("t", width, F.col("light")), ("v", width, F.col("dense")), ("t", 2 * width, long_at))]
    whole = parts.where((F.size("t") > 0) & ((F.size("t") < width) | ((F.size("t") < 2 * width) & (F.size("light") == 0))))
    found += [
        whole.where(word(F.col("t")) if k == "t" else ~word(F.col("t"))).select("item", F.lit(k).alias("kind"), F.size("t").alias("width"), F.lit(0).alias("i"), key(k, F.size("t"), F.col(k)).alias("h"))
        for k in ("t", "v")
    ]
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.withColumnRenamed("i", "j").distinct()


def document_keys(docs: DataFrame, text_col: str, kinds: list[tuple[str, int]], width: int) -> DataFrame:
    """(doc, i, h) of the windows of docs (doc, text) of the kinds and widths that the benchmark has."""
    tokens = docs.select("doc", valued(F.col(text_col)).alias("v"))
    tokens = tokens.select("doc", *(["v"] if any(k == "v" for k, _ in kinds) else []), F.transform("v", bare).alias("t"))
    parts = []
    for k, w in kinds:
        at = places(F.col("t"), w)
        if w >= width and (k, w) != ("t", width):
            at = F.filter(at, lambda i: heavy(F.col("t"), i, width))
        parts.append(keys_at(k, F.col(k), w, at))
    return tokens.select("doc", F.inline(F.concat(*parts) if len(parts) > 1 else parts[0])) if parts else docs.select("doc", F.lit(0).alias("i"), F.lit(0).cast("long").alias("h")).limit(0)


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = WINDOW, least_cover: float = LEAST_COVER, least_run: int = LEAST_RUN
) -> DataFrame:
    """(id, item, n_windows, cover, n_slots, changed): documents that hold a benchmark item, perhaps with other values in its slots.

    An alignment of an item with a document counts if the share of the item's template tokens that agree is least_cover or
    more, or its agreeing windows cover least_run tokens, and the values of the agreeing slots map one to one. An alignment is
    judged by itself and together with the windows at shifts up to DRIFT tokens away, so that words that are put in or taken
    out, or values of another length, do not part an item. The row of
    a pair is its best alignment (most cover, then most windows); changed: some value differs. Items of fewer tokens than a
    window are matched whole; items without a word besides their values are found with these values only. Null and empty texts
    hold nothing; rows with a null id are not reported; repeated rows give one row a pair; other columns are dropped.
    """
    items = written(benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item"), template(F.col(item_text)).alias("t"), valued(F.col(item_text)).alias("v")).dropDuplicates(["item", "t"]), "items")
    lookup = written(item_keys(items, width), "item-windows")
    small = lookup.count() <= BROADCAST_ROWS
    kinds = sorted((r["kind"], r["width"]) for r in lookup.select("kind", "width").distinct().collect())  # under two long windows' widths of rows
    held = (lambda df: F.broadcast(df)) if small else (lambda df: df)
    own = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).where(F.col("doc").isNotNull())
    found = document_keys(own, "text", kinds, width)
    hits = found.join(held(lookup.select("item", "j", "h")), "h").groupBy("doc", "item", (F.col("i") - F.col("j")).alias("shift")).agg(F.array_sort(F.collect_set("j")).alias("js"))
    # each shift goes to the buckets that hold a shift near it, so no list of shifts is longer than a bucket and its edges
    near = F.array_distinct(F.array(*(F.floor((F.col("shift") + F.lit(x)) / (2 * DRIFT)) for x in (-DRIFT, 0, DRIFT))))
    hits = (
        hits.withColumn("own", F.floor(F.col("shift") / (2 * DRIFT))).withColumn("bucket", F.explode(near))
        .groupBy("doc", "item", "bucket").agg(F.collect_list(F.struct("shift", "js", "own")).alias("all"))
        .where(F.exists("all", lambda x: x["own"] == F.col("bucket")))
    )
    hits = written(hits, "window-hits")
    asked = hits.groupBy("doc").agg(F.collect_list(F.struct("item", "bucket", "all")).alias("asked"))
    texts = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    aligned = (
        texts.join(asked.hint("merge"), "doc")  # by shuffle at every size: hits grow with the corpus
        .select("doc", valued(F.col("text")).alias("d"), "asked")
        .select("doc", "d", F.inline("asked"))
        .select("doc", "d", "item", "all", F.inline(F.filter("all", lambda x: x["own"] == F.col("bucket"))))
        .join(held(items.select("item", "v")), "item")
    )
    around = F.filter("all", lambda x: (x["shift"] != F.col("shift")) & (F.abs(x["shift"] - F.col("shift")) <= DRIFT))
    nearest = F.transform(F.array_sort(F.transform("around", lambda x: F.struct(F.abs(x["shift"] - F.col("shift")).alias("far"), x["shift"].alias("shift"), x["js"].alias("js")))), lambda x: F.struct(x["shift"], x["js"]))
    none = F.array_except("around", "around")
    tried = (
        aligned.withColumn("around", around)
        .select("doc", "d", "item", "v", "shift", "js", F.explode(F.when(F.size("around") > 0, F.array(none, "around")).otherwise(F.array(none))).alias("around"))
        .withColumn("around", nearest)
    )
    token = lambda at: F.get("d", at.cast("int"))

    def other(k: Column) -> Column:
        """The document's token for the item's k-th in the nearest alignment with a window over it."""
        over = F.filter("around", lambda x: F.exists(x["js"], lambda j: (j <= k) & (k < j + width)))
        return token(F.get(over, F.lit(0))["shift"] + k)

    agree = lambda a, b: b.isNotNull() & (bare(a) == bare(b))
    pair = F.transform("v", lambda x, k: F.struct(x.alias("a"), F.when(agree(x, token(F.col("shift") + k)) | (F.size("around") == 0), token(F.col("shift") + k)).otherwise(other(k)).alias("b")))
    same = F.filter("pairs", lambda p: bare(p["a"]) == bare(p["b"]))
    value = lambda name: F.size(F.array_distinct(F.transform("slots", lambda p: p[name])))
    n_windows = F.size(F.array_distinct(F.concat("js", F.flatten(F.transform("around", lambda x: x["js"])))))
    judged = (
        tried.select("doc", "item", n_windows.cast("long").alias("n_windows"), F.size("v").alias("n"), pair.alias("pairs"))
        .select("doc", "item", "n_windows", "n", same.alias("same"))
        .select("doc", "item", "n_windows", (F.size("same") / F.col("n")).alias("cover"), F.filter("same", lambda p: slot(p["a"])).alias("slots"))
        .select("doc", "item", "n_windows", "cover", F.size("slots").alias("n_slots"), F.exists("slots", lambda p: p["a"] != p["b"]).alias("changed"), ((F.size(F.array_distinct("slots")) == value("a")) & (value("a") == value("b"))).alias("whole"))
        .where(F.col("whole") & ((F.col("cover") >= least_cover) | (F.col("n_windows") + (width - 1) >= least_run)))
    )
    best = judged.groupBy("doc", "item").agg(F.max_by(F.struct("n_windows", "cover", "n_slots", "changed"), F.struct("cover", "n_windows", "n_slots", "changed")).alias("b"))
    return best.select(F.col("doc").alias(id_col), F.col("item").alias(item_col), "b.n_windows", "b.cover", "b.n_slots", "b.changed")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """docs without the rows that contaminated() reports; rows with a null id stay."""
    return docs.join(contaminated(docs, benchmark, id_col, **options).select(id_col).distinct().hint("merge"), id_col, "left_anti")
