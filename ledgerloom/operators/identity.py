"""Names that mean one thing although they are spelled differently: an edit-similarity join and its clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import graph as G
from .graph import _settled


def _edits(length: Column, least: float) -> Column:
    """The most edits between a name of that length and one that is not longer, at that similarity."""
    return F.floor(length * (1 - least) + 1e-9).cast("int")


def similar_names(names: DataFrame, least: float = 0.85) -> DataFrame:
    """(a, b, similarity) for a < b: distinct names (name) whose edit distance is at most 1 - least of the longer one's length.

    A name is cut into one piece more than a name of like length may differ from it in edits, so that one
    piece stands unchanged in the other, moved by no more than the edits before and
    behind it allow.  Pieces of the shorter name meet runs of the longer one by length, number and text; the distance is taken of those pairs alone.
    Nulls and empty names are in no pair.  least must be above one half.
    """
    if not 0.5 < least <= 1:
        raise ValueError("a similarity above one half is needed, so that every piece has a character")
    n = _settled(names.select("name").where("name <> ''").distinct().withColumn("l", F.length("name")))
    # Of a name of length l, the most edits that a partner up to l / least long may have, so that both sides cut alike.
    most = lambda l: _edits(F.floor(l / least + 1e-9), least)
    cut = lambda l, i: F.floor(i * l / (most(l) + 1)).cast("int")
    pieces = n.withColumn("i", F.explode(F.sequence(F.lit(0), most(F.col("l")))))
    start = cut(F.col("l"), F.col("i"))
    pieces = pieces.select(F.col("name").alias("short"), F.col("l").alias("sl"), "i", F.substring(F.col("name"), start + 1, cut(F.col("l"), F.col("i") + 1) - start).alias("piece"))
    runs = n.withColumn("sl", F.explode(F.sequence(F.greatest(F.lit(1), F.ceil(F.col("l") * least - 1e-9).cast("int")), F.col("l"))))
    runs = runs.withColumn("i", F.explode(F.sequence(F.lit(0), most(F.col("sl")))))
    # Moved by the edits before the piece at most, and so that those behind it make up the rest of the difference in length.
    more, i, left = F.col("l") - F.col("sl"), F.col("i"), most(F.col("sl")) - F.col("i")
    at, size = cut(F.col("sl"), i), cut(F.col("sl"), i + 1) - cut(F.col("sl"), i)
    lo, hi = F.greatest(at + F.greatest(-i, more - left), F.lit(0)), F.least(at + F.least(i, more + left), F.col("l") - size)
    runs = runs.where(lo <= hi).withColumn("p", F.explode(F.sequence(lo, hi))).select(F.col("name").alias("long"), "l", "sl", "i", F.substring(F.col("name"), F.col("p") + 1, size).alias("piece"))
    near = pieces.join(runs, ["sl", "i", "piece"]).where("short <> long").select(F.least("short", "long").alias("a"), F.greatest("short", "long").alias("b")).distinct()
    longer = F.greatest(F.length("a"), F.length("b"))
    d = near.withColumn("d", F.levenshtein("a", "b")).where(F.col("d") <= _edits(longer, least))
    return d.select("a", "b", F.round(1 - F.col("d") / longer, 6).alias("similarity"))


def fuzzy_identities(names: DataFrame, least: float = 0.85) -> DataFrame:
    """(key, identity, spelling, n, variants, mentions, evidence): the rows of each normalised name with the identity it belongs to.

    names has a column name.  Names equal in letters and digits are one key; keys
    are joined by similar_names and what follows from it.  identity is the cluster's key of
    most rows, of equal ones the first; spelling the key's commonest name, n its
    rows, variants and mentions the cluster's keys and rows, evidence the similarity of the key's best link, 1 where it stands alone.
    """
    keyed = names.select(T.normalized_key("name").alias("key"), "name").where("key <> ''")
    spelled = keyed.groupBy("key", "name").agg(F.count("*").alias("m"))
    keys = _settled(spelled.groupBy("key").agg(F.sum("m").alias("n"), F.min(F.struct((-F.col("m")).alias("m"), "name"))["name"].alias("spelling")))
    links = _settled(similar_names(keys.select(F.col("key").alias("name")), least))
    edges = links.select(F.col("a").alias("src"), F.col("b").alias("dst"))
    touched = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    groups = G.components(edges, touched).select(F.col("node").alias("key"), F.col("component").alias("c"))
    best = links.select(F.col("a").alias("key"), "similarity").unionByName(links.select(F.col("b").alias("key"), "similarity")).groupBy("key").agg(F.max("similarity").alias("evidence"))
    all_ = _settled(keys.join(groups, "key", "left").join(best, "key", "left").withColumns({"c": F.coalesce("c", "key"), "evidence": F.coalesce("evidence", F.lit(1.0))}))
    head = all_.groupBy("c").agg(F.min(F.struct((-F.col("n")).alias("m"), "key"))["key"].alias("identity"), F.count("*").alias("variants"), F.sum("n").alias("mentions"))
    return all_.join(head, "c").select("key", "identity", "spelling", "n", "variants", "mentions", "evidence")
