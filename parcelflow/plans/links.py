"""Links between records of one property, recomputed in full."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelflow.functions import status
from parcelflow.functions.udf import street_similarity
from parcelflow.operators.joins import near_pairs, point_pairs, points, proximity_pairs, similar_pairs
from parcelflow.sources.files import kept


def rank() -> Column:
    """Live before not live, then later seen, then lower id. last_seen_at stands for the last update: the loader sets both alike."""
    return F.struct((~status.not_live(F.col("status"))).alias("live"), F.col("last_seen_at").alias("seen"), (-F.col("property_id")).alias("low"))


def choose_canonical(pairs: DataFrame, properties: DataFrame) -> DataFrame:
    """hidden_sides() of pairs with the rank of their properties."""
    ranks = properties.select("property_id", rank().alias("r"))
    both = pairs.join(ranks.select(F.col("property_id").alias("a_property_id"), F.col("r").alias("a_r")), "a_property_id").join(ranks.select(F.col("property_id").alias("b_property_id"), F.col("r").alias("b_r")), "b_property_id")
    return hidden_sides(both)


def hidden_sides(pairs: DataFrame) -> DataFrame:
    """(property_id, canonical_id, metres, similarity): the hidden side of each pair, the one of the lower rank (a_r, b_r).

    A property hidden by several keeps its best canonical; similarity is null where the pairs have none.
    """
    a_wins = F.col("a_r") > F.col("b_r")
    side = pairs.select(
        F.when(a_wins, F.col("b_property_id")).otherwise(F.col("a_property_id")).alias("property_id"),
        F.when(a_wins, F.col("a_property_id")).otherwise(F.col("b_property_id")).alias("canonical_id"), F.greatest("a_r", "b_r").alias("r"), "metres",
        (F.col("similarity") if "similarity" in pairs.columns else F.lit(None).cast("double")).alias("similarity"),
    )
    return side.groupBy("property_id").agg(F.max_by(F.struct("canonical_id", "metres", "similarity"), "r").alias("x")).select("property_id", "x.canonical_id", "x.metres", "x.similarity")


#: A link as the store keeps it.
LINKS = "property_id long, canonical_id long, metres double, similarity double"
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789 "
PLACE = ("latitude", "longitude", "house", "street")
BOX = 0.0015


def letter_counts(c: Column) -> Column:
    """How often each letter of ALPHABET, and any other one, occurs."""
    found = [F.length(c) - F.length(F.replace(c, F.lit(x), F.lit(""))) for x in ALPHABET]
    return F.array(*found, F.length(c) - sum(found[1:], found[0]))


def ratio_bound(a: Column, b: Column) -> Column:
    """Not less than the ratio of matching blocks: twice the letters in common over all letters."""
    common = F.aggregate(F.zip_with(letter_counts(a), letter_counts(b), lambda x, y: F.least(x, y)), F.lit(0), lambda acc, x: acc + x)
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 1.0).otherwise(2 * common / total)


def open_streets(pairs: DataFrame, least: float) -> DataFrame:
    """The different pairs of street names, in both orders, that their letters leave open; only these need Python.

    The pairs of names are written first: else the bound would be worked out for every pair of places, below the aggregate.
    """
    unlike = pairs.where(F.col("a_street") != F.col("b_street")).select(F.least("a_street", "b_street").alias("a_street"), F.greatest("a_street", "b_street").alias("b_street")).distinct()
    left = kept(unlike, "street-names").where(ratio_bound(F.col("a_street"), F.col("b_street")) >= least)
    return left.unionByName(left.select(F.col("b_street").alias("a_street"), F.col("a_street").alias("b_street")))


def places(properties: DataFrame) -> DataFrame:
    """properties (property_id, source, latitude, longitude, house, street, r) with a house number and a point; r: rank()."""
    return points(properties, rank().alias("r"))


def place_pairs(pts: DataFrame, metres: float) -> DataFrame:
    """Ordered pairs of places (latitude, longitude, house, street) near each other with one house number, each with itself too."""
    one = kept(pts.select(*PLACE).distinct(), "one-places")
    named = lambda p: one.select(*(F.col(c).alias(f"{p}_{c}") for c in PLACE))
    return near_pairs(named("a"), named("b"), BOX, ["house"]).where(F.col("metres") <= metres)


def link_duplicates(properties: DataFrame, least: float = 0.6, metres: float = 100.0) -> DataFrame:
    """(property_id, canonical_id, metres, similarity): the hidden ones among properties of different sources at one place.

    The same as choose_canonical() of all similar pairs, without the pairs: properties with the same point, house number and
    street are one place, whose best property of each source is enough for every other place. Places are compared in grid
    cells by house number, streets by their letters first; what the letters leave open goes to Python, each pair of names once.
    Where names are similar in one order of ids only, their properties are paired. A place of any size is aggregated before it meets its members.
    """
    pts = kept(places(properties), "places")
    near = kept(place_pairs(pts, metres), "place-pairs")
    told = kept(open_streets(near, least).withColumn("_s", street_similarity("a_street", "b_street")), "streets")
    forth = told.select("a_street", "b_street", F.col("_s").alias("forth"))
    back = told.select(F.col("b_street").alias("a_street"), F.col("a_street").alias("b_street"), F.col("_s").alias("back"))
    same = F.col("a_street") == F.col("b_street")
    scored = near.join(forth, ["a_street", "b_street"], "left").join(back, ["a_street", "b_street"], "left").withColumns({"forth": F.when(same, 1.0).otherwise(F.col("forth")), "back": F.when(same, 1.0).otherwise(F.col("back"))})
    scored = kept(scored.where((F.col("forth") >= least) | (F.col("back") >= least)), "similar-places")
    member = lambda p: pts.select(*(F.col(c).alias(f"{p}_{c}") for c in pts.columns))
    keys = lambda p: [f"{p}_{c}" for c in PLACE]
    # similar in both orders: the best of each source of all places around one, then each of its properties
    best = pts.groupBy(*PLACE, "source").agg(F.max("r").alias("r")).select(*(F.col(c).alias(f"b_{c}") for c in (*PLACE, "source", "r")))
    around = scored.where((F.col("forth") >= least) & (F.col("back") >= least)).join(best, keys("b"))
    found = F.struct(F.col("b_r").alias("r"), F.col("b_source").alias("source"), "metres", "forth", "back")
    per_source = around.groupBy(*keys("a"), "b_source").agg(F.max(found).alias("x")).groupBy(*keys("a")).agg(F.sort_array(F.collect_list("x"), asc=False).alias("xs"))  # one a source
    own = F.filter("xs", lambda x: x["source"] != F.col("a_source"))
    whole = member("a").join(per_source, keys("a")).withColumn("x", F.get(own, F.lit(0))).where(F.col("x").isNotNull()).select("a_property_id", "a_r", "x.*")
    # similar in one order only
    split = scored.where((F.col("forth") >= least) != (F.col("back") >= least)).join(member("a"), keys("a")).join(member("b"), keys("b"))
    fits = F.when(F.col("a_property_id") < F.col("b_property_id"), F.col("forth")).otherwise(F.col("back")) >= least
    single = split.where((F.col("a_source") != F.col("b_source")) & fits).select("a_property_id", "a_r", F.col("b_r").alias("r"), F.col("b_source").alias("source"), "metres", "forth", "back")
    both = whole.unionByName(single).where(F.col("r") > F.col("a_r"))
    top = both.groupBy(F.col("a_property_id").alias("property_id")).agg(F.max(F.struct("r", "metres", "forth", "back")).alias("x"))
    canonical = -F.col("x.r.low")
    similarity = F.when(F.col("property_id") < canonical, F.col("x.forth")).otherwise(F.col("x.back"))
    return top.select("property_id", canonical.alias("canonical_id"), "x.metres", similarity.alias("similarity"))


def link_duplicates_by_pairs(properties: DataFrame, least: float = 0.6) -> DataFrame:
    """The same from all similar pairs of properties."""
    return choose_canonical(similar_pairs(proximity_pairs(properties), least), properties)


def link_candidates(properties: DataFrame) -> DataFrame:
    """The same without the similarity of street names, in built-in expressions alone: streets must be equal.

    Properties are read once and take their rank with them into the pairs, so nothing is joined to these again.
    """
    return hidden_sides(point_pairs(kept(places(properties), "places"), BOX, on=("house", "street")))
