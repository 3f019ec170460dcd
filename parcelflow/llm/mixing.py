"""Mixing sources to target weights: raking (iterative proportional fitting) of token weights, then calibrated sampling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelflow.llm.common import cut, written

MARGINS = ("source", "lang", "topic")
#: Where no target is given: a margin's observed share to this power, made to sum to one.
TEMPER = {"source": 0.5, "lang": 0.7, "topic": 0.7}
#: Raking rounds, rounds of the budget's scale, share of all tokens that is sampled.
ROUNDS, SCALINGS, SHARE = 20, 20, 0.5
#: Cells (combinations of the margins' values) up to this many are raked on the driver, more on the executors.
CELLS = 50_000


def topic(text: Column) -> Column:
    """The text's form, which stands for its topic where no topic column is given."""
    x = F.coalesce(text, F.lit(""))
    return F.when(x.contains(" | "), "table").when(x.contains("!!"), "shout").when(x.contains("###") | x.contains("%%%"), "markup").when(F.length(x) < 600, "note").otherwise("prose")


def token_count(text: Column) -> Column:
    """Tokens of a text, as runs of characters that are not spaces."""
    x = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return F.when(x == "", 0).otherwise(F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).cast("long")


def draw(id_col: str) -> Column:
    """A number in [0, 1) that follows from the id alone."""
    return F.conv(F.substring(F.md5(F.col(id_col).cast("string").cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def goals(shares: Mapping, power: float, given: Mapping | None) -> dict:
    raw = {k: (given.get(k, 0.0) if given else v**power) for k, v in shares.items()}
    total = sum(raw.values())
    return {k: v / total for k, v in raw.items()} if total else dict(shares)


def rake(cells: list[tuple], targets: Mapping[str, Mapping | None], temper: Mapping[str, float], margins: Sequence[str] = MARGINS, rounds: int = ROUNDS, share: float = SHARE, scalings: int = SCALINGS) -> np.ndarray:
    """The sampling probability of each cell (values of the margins, tokens)."""
    tokens = np.array([c[-1] for c in cells], float)
    weight = tokens / tokens.sum()
    plan = []
    for m, name in enumerate(margins):
        names, code = np.unique([str(c[m]) for c in cells], return_inverse=True)
        shares = np.bincount(code, tokens) / tokens.sum()
        goal = goals(dict(zip(names.tolist(), shares.tolist(), strict=True)), temper.get(name, 1.0), targets.get(name))
        plan.append((code, np.array([goal[x] for x in names.tolist()])))
    for _ in range(rounds):
        for code, goal in plan:
            now = np.bincount(code, weight)
            weight = weight * np.divide(goal, now, out=np.zeros_like(goal), where=now > 0)[code]
    ratio = weight / (tokens / tokens.sum())
    scale, budget = share, share * tokens.sum()
    for _ in range(scalings):
        full = scale * ratio >= 1
        rest = (tokens * ratio)[~full].sum()
        if not rest:
            break
        scale = (budget - tokens[full].sum()) / rest
    return np.clip(scale * ratio, 0, 1)


def rake_table(cells: DataFrame, targets: Mapping[str, Mapping | None], temper: Mapping[str, float], margins: Sequence[str] = MARGINS, rounds: int = ROUNDS, share: float = SHARE, scalings: int = SCALINGS) -> DataFrame:
    """rake() for more cells than the driver should hold: the same rounds as aggregations and joins, checkpointed each."""
    spark = cells.sparkSession
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    at = cells.withColumn("weight", F.col("tokens") / F.lit(float(total or 1)))
    plan = []
    for name in margins:
        shares = cells.groupBy(name).agg((F.sum("tokens") / F.lit(float(total or 1))).alias("goal"))
        if targets.get(name):
            pairs = spark.createDataFrame([(str(k), float(v)) for k, v in targets[name].items()], f"{name} string, given double")
            shares = shares.join(pairs, name, "left").select(name, F.coalesce("given", F.lit(0.0)).alias("goal"))
        else:
            shares = shares.select(name, F.pow("goal", F.lit(temper.get(name, 1.0))).alias("goal"))
        whole = shares.agg(F.sum("goal")).first()[0] or 1.0
        plan.append((name, cut(shares.withColumn("goal", F.col("goal") / F.lit(whole)))))
    for _ in range(rounds):
        for name, goal in plan:
            factor = at.groupBy(name).agg(F.sum("weight").alias("now")).join(goal, name).select(name, F.when(F.col("now") > 0, F.col("goal") / F.col("now")).otherwise(0.0).alias("factor"))
            at = at.join(factor, name).withColumn("weight", F.col("weight") * F.col("factor")).drop("factor")
        at = cut(at)
    at = cut(at.withColumn("ratio", F.col("weight") / (F.col("tokens") / F.lit(float(total or 1)))))
    scale, budget = share, share * total
    for _ in range(scalings):
        full = F.lit(scale) * F.col("ratio") >= 1
        done, rest = at.agg(F.sum(F.when(full, F.col("tokens")).otherwise(0)), F.sum(F.when(~full, F.col("tokens") * F.col("ratio")).otherwise(0.0))).first()
        if not rest:
            break
        scale = (budget - done) / rest
    return at.withColumn("p", F.least(F.greatest(F.lit(scale) * F.col("ratio"), F.lit(0.0)), F.lit(1.0))).select(*margins, "p")


def weighed(docs: DataFrame, text_col: str = "text", topic_of: Column | None = None) -> DataFrame:
    """docs with topic and tokens; columns of these names are replaced."""
    return docs.withColumn("topic", topic_of if topic_of is not None else topic(F.col(text_col))).withColumn("tokens", token_count(F.col(text_col)))


def unused(name: str, taken: set[str]) -> str:
    """name, or a longer one that is not taken (Spark's names have no case); it is taken from then on."""
    while name.lower() in taken:
        name += "_"
    taken.add(name.lower())
    return name


def probabilities(cells: DataFrame, targets: Mapping[str, Mapping | None], temper: Mapping[str, float], margins: Sequence[str], share: float) -> DataFrame:
    """cells (margins, tokens) with p; up to CELLS cells are raked on the driver."""
    if cells.count() > CELLS:
        return cells.join(rake_table(cells, targets, temper, margins, share=share), list(margins))
    rows = sorted(tuple(r) for r in cells.select(*margins, "tokens").collect())  # at most CELLS rows
    p = rake(rows, targets, temper, margins, share=share).tolist() if rows else []
    return cells.sparkSession.createDataFrame([(*r, x) for r, x in zip(rows, p, strict=True)], ", ".join(f"{m} string" for m in margins) + ", tokens long, p double")


def report(found: DataFrame, targets: Mapping[str, Mapping | None] | None = None, temper: Mapping[str, float] = TEMPER, margins: Sequence[str] = MARGINS) -> DataFrame:
    """(margin, value, target, expected, off) of probabilities(): each value's goal and its expected share of the sample.

    off is the difference. It is over rounding where rounds did not converge, where targets name values without tokens, or
    where cells are sampled whole (p = 1) and so hold less than their weight.
    """
    spark, out = found.sparkSession, None
    total, kept = found.agg(F.sum("tokens"), F.sum(F.col("tokens") * F.col("p"))).first()
    for m in margins:
        per = found.groupBy(F.col(m).alias("value")).agg((F.sum("tokens") / F.lit(float(total or 1))).alias("observed"), (F.sum(F.col("tokens") * F.col("p")) / F.lit(float(kept or 1))).alias("expected"))
        given = (targets or {}).get(m)
        if given:
            pairs = spark.createDataFrame([(str(k), float(v)) for k, v in given.items()], "value string, raw double")
            per = per.join(pairs, "value", "full").select("value", F.coalesce("raw", F.lit(0.0)).alias("raw"), F.coalesce("expected", F.lit(0.0)).alias("expected"))
        else:
            per = per.select("value", F.pow("observed", F.lit(temper.get(m, 1.0))).alias("raw"), "expected")
        whole = per.agg(F.sum("raw")).first()[0] or 1.0
        rows = per.select(F.lit(m).alias("margin"), "value", (F.col("raw") / F.lit(whole)).alias("target"), "expected").withColumn("off", F.abs(F.col("expected") - F.col("target")))
        out = rows if out is None else out.unionByName(rows)
    return out


def drawn(docs: DataFrame, id_col: str, text_col: str | None, targets: Mapping[str, Mapping | None] | None, temper: Mapping[str, float], share: float, topic_of: Column | None) -> tuple[DataFrame, dict[str, str]]:
    """The sampled rows with all columns of docs, and topic, tokens and p under the names given beside them."""
    margins, taken = list(MARGINS), {c.lower() for c in docs.columns}
    if text_col is None:
        names, named = {"topic": "topic", "tokens": "tokens"}, docs
        usable = F.col("tokens") > 0
    else:
        names = {n: unused(n, taken) for n in ("topic", "tokens")}
        named = docs.withColumn(names["topic"], topic_of if topic_of is not None else topic(F.col(text_col))).withColumn(names["tokens"], token_count(F.col(text_col)))
        # the same rows as those with tokens, without counting them once more
        usable = F.coalesce(F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    usable = F.col(id_col).isNotNull() & usable
    names["p"] = unused("p", taken)
    key = {m: F.coalesce(F.col(names.get(m, m)).cast("string"), F.lit("(none)")) for m in margins}
    cells = written(named.where(usable).groupBy(*(key[m].alias(m) for m in margins)).agg(F.sum(names["tokens"]).alias("tokens")), "cells")
    found = probabilities(cells, targets or {}, temper, margins, share)
    on = {m: unused(f"_{m}", taken) for m in margins}
    table = found.select(*(F.col(m).alias(on[m]) for m in margins), F.col("p").alias(names["p"]))
    if cells.count() <= CELLS:
        table = F.broadcast(table)  # at most CELLS rows
    rows = named.join(table, [key[m] == F.col(on[m]) for m in margins]).where(usable & (draw(id_col) < F.col(names["p"])))
    return rows.drop(*on.values()), names


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str | None = "text", targets: Mapping[str, Mapping | None] | None = None, temper: Mapping[str, float] = TEMPER, share: float = SHARE, topic_of: Column | None = None) -> DataFrame:
    """Sampled rows of docs with topic, tokens and p, the probability with which their cell is sampled.

    Token weights are raked until source, language and topic have their targets (given shares by value, else tempered
    observed shares); a row is kept if a number drawn from its id is under p, so copies of an id share their fate and a
    rerun keeps the same rows. share: expected part of all tokens that is kept. Nulls in a margin are a value of their
    own, "(none)"; rows with no tokens or a null id are not sampled; an empty table gives no rows. Columns of docs named
    topic, tokens or p are replaced; sample() keeps them. text_col None: docs come from weighed(), and their texts may be
    left out.
    """
    rows, names = drawn(docs.drop("p") if text_col is None else docs, id_col, text_col, targets, temper, share, topic_of)
    return rows.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in names), *(F.col(v).alias(k) for k, v in names.items()))


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of mix() with the columns of docs as they are, whatever their names."""
    options = {"targets": None, "temper": TEMPER, "share": SHARE, "topic_of": None} | options
    return drawn(docs, id_col, text_col, **options)[0].select(*(F.col(f"`{c}`") for c in docs.columns))


def oracle(columns: str = "doc_id, source, lang, topic, tokens, round(p, 4) as p", table: str = "documents") -> str:
    """mix() with its defaults in DuckDB SQL; the rounds are written out."""
    steps = [
        rf"""named as materialized (select *, case when contains(coalesce(text, ''), ' | ') then 'table' when contains(coalesce(text, ''), '!!') then 'shout' when contains(coalesce(text, ''), '###') or contains(coalesce(text, ''), '%%%') then 'markup' when length(coalesce(text, '')) < 600 then 'note' else 'prose' end as topic,
  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as tokens from {table})""",
        "cells as materialized (select coalesce(source, '(none)') as source, coalesce(lang, '(none)') as lang, topic, sum(tokens)::double as tokens from named where doc_id is not null and tokens > 0 group by all)",
        "total as materialized (select sum(tokens) as t from cells)",
    ]
    for m in MARGINS:
        steps.append(f"g0_{m} as materialized (select {m}, pow(sum(tokens) / (select t from total), {TEMPER[m]}) as g from cells group by 1)")
        steps.append(f"g_{m} as materialized (select {m}, g / (select sum(g) from g0_{m}) as g from g0_{m})")
    steps.append("w0 as materialized (select *, tokens / (select t from total) as w from cells)")
    k = 0
    for _ in range(ROUNDS):
        for m in MARGINS:
            steps.append(f"w{k + 1} as materialized (select x.* exclude (w), w * (g.g / sum(w) over (partition by x.{m})) as w from w{k} x join g_{m} g on x.{m} = g.{m})")
            k += 1
    steps.append(f"r as materialized (select *, w / (tokens / (select t from total)) as ratio from w{k})")
    steps.append(f"s0 as materialized (select {SHARE}::double as scale)")
    for i in range(SCALINGS):
        steps.append(f"s{i + 1} as materialized (select ({SHARE} * (select t from total) - coalesce(sum(tokens) filter (where scale * ratio >= 1), 0)) / sum(tokens * ratio) filter (where scale * ratio < 1) as scale from r, s{i})")
    steps.append(f"p as materialized (select source, lang, topic, least(scale * ratio, 1) as p from r, s{SCALINGS})")
    return f"""with {", ".join(steps)} select {columns} from (select n.*, p.p from named n join p on coalesce(n.source, '(none)') = p.source and coalesce(n.lang, '(none)') = p.lang and n.topic = p.topic
where n.doc_id is not null and n.tokens > 0 and ('0x' || substr(md5(n.doc_id::varchar), 1, 8))::bigint / 4294967296.0::double < p.p)"""
