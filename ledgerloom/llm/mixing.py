"""Operator 9: mixing sources to target weights.

Documents get hash-random keys; within a source they follow in the order of
these keys.  Word counts are summed up by (source, key range), the ranges'
prefix sums show in which range a source's budget ends, and only that range is
sorted to find the exact cut.  The cuts, one row a source, are then applied to
all documents without a shuffle of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, fresh, table, text_or_empty

#: The words of a text: runs of anything but ASCII space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
#: Hex digits of a key that name its range.
RANGE_DIGITS = 3
#: Sources up to which their cuts are broadcast (about 100 bytes each); beyond it the join shuffles.
BROADCAST_SOURCES = 20_000


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def random_key(id_col: str, text_col: str) -> Column:
    """A hash-random key: equal for rows equal in id and text only."""
    return F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), text_or_empty(text_col)))


def targets(sizes: DataFrame, weights: Sequence[float], max_epochs: int) -> DataFrame:
    """(src, source_size) -> with target: all sizes shared by weight, none above max_epochs times its source.

    Sources by code point, null last, take the weights in turn.  A source is
    capped if its cap per weight is at most the final level; in the order of
    that ratio, the level after k capped sources is (all - their caps) / (the
    others' weight), and the first k whose level stays below the next ratio is
    the answer.
    """
    rank = F.row_number().over(Window.orderBy(F.col("src").asc_nulls_last())) - 1
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (rank % len(weights) + 1).cast("int"))
    s = sizes.withColumns({"_w": w, "_cap": F.col("source_size") * F.lit(max_epochs)})
    every = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("src").asc_nulls_last())
    s = s.withColumns({
        "_all": F.sum("source_size").over(every), "_wall": F.sum("_w").over(every),
        "_caps": F.sum("_cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)),
        "_ws": F.sum("_w").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)),
    })
    level = (F.col("_all") - F.coalesce("_caps", F.lit(0))) / (F.col("_wall") - F.coalesce("_ws", F.lit(0.0)))
    s = s.withColumn("_level", F.when(F.col("_w") * level < F.col("_cap"), level))
    first = F.first("_level", ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.least(F.col("_cap").cast("double"), F.coalesce(F.col("_w") * first, F.col("_cap").cast("double")))
    return s.select("src", "source_size", target.alias("target"))


def cuts(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: Sequence[float], max_epochs: int) -> DataFrame:
    """One row a source: src, source_size, target, epochs, cut_key, cut_words.

    A document is taken `epochs` times, once more below cut_key, and cut_words
    words more at cut_key.
    """
    d = docs.select(F.col(source_col).alias("src"), random_key(id_col, text_col).alias("key"), words(F.col(text_col)).alias("size"))
    d = d.withColumn("rng", F.substring("key", 1, RANGE_DIGITS))
    ranges = checkpointed(d.groupBy("src", "rng").agg(F.sum("size").alias("n")))
    goal = targets(ranges.groupBy("src").agg(F.sum("n").alias("source_size")), weights, max_epochs)
    budget = F.floor("target").cast("long")
    goal = goal.withColumns({
        "epochs": F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long"),
    }).withColumn("rest", budget - F.col("epochs") * F.col("source_size"))
    before = Window.partitionBy("src").orderBy("rng").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    goal = checkpointed(
        goal.alias("g").join(
            ranges.alias("r"),
            F.col("g.src").eqNullSafe(F.col("r.src")) & (F.col("rest") > F.col("before")) & (F.col("rest") <= F.col("before") + F.col("n")),
            "left",
        ).select("g.*", "rng", "before")
    )
    at = bounded(goal.where("rng is not null").select(F.col("src").alias("s"), F.col("rng").alias("r"), "rest", "before"))
    near = d.join(at, F.col("src").eqNullSafe(F.col("s")) & (F.col("rng") == F.col("r")), "inner")
    keys = near.groupBy("src", "key", "rest", "before").agg(F.sum("size").alias("n"), F.count("*").alias("rows"))
    upto = F.col("before") + F.coalesce(F.sum("n").over(Window.partitionBy("src").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = keys.withColumn("upto", upto).where((F.col("rest") > F.col("upto")) & (F.col("rest") <= F.col("upto") + F.col("n")))
    cut = cut.select(F.col("src").alias("s"), F.col("key").alias("cut_key"), F.floor((F.col("rest") - F.col("upto")) / F.col("rows")).cast("long").alias("cut_words"))
    return checkpointed(
        goal.join(cut, F.col("src").eqNullSafe(F.col("s")), "left")
        .select("src", "source_size", "target", "epochs", F.coalesce("cut_key", F.lit("")).alias("cut_key"), F.coalesce("cut_words", F.lit(0)).alias("cut_words"))
    )


def bounded(by_source: DataFrame) -> DataFrame:
    """A table of one row a source, marked for broadcast only if its counted rows are few."""
    return F.broadcast(by_source) if by_source.count() <= BROADCAST_SOURCES else by_source


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[float] = (5, 2, 1), max_epochs: int = 3, names: Sequence[str] = ("size", "source_size", "target", "taken"),
) -> DataFrame:
    """docs and the columns size, source_size, target and taken (words the mix takes, repeats counted).

    Null texts have size 0 and are never taken; a null source is a source of
    its own, the last.  Rows equal in id and text share the words left at a cut
    evenly.  A source without words has target 0.  Columns of docs named like a
    new one are replaced; other extra columns pass through.
    """
    size, source_size, target, taken = names
    docs = docs.drop(*[c for c in docs.columns if c.lower() in {n.lower() for n in names}])
    c = bounded(cuts(docs, id_col, text_col, source_col, weights, max_epochs))
    tmp = {k: fresh(docs, f"_{k}") for k in c.columns}
    c = c.select(*(F.col(k).alias(v) for k, v in tmp.items()))
    key = fresh(docs, "_key")
    out = docs.withColumns({key: random_key(id_col, text_col), size: words(F.col(text_col))})
    out = out.join(c, F.col(source_col).eqNullSafe(F.col(tmp["src"])), "left")
    n = F.col(size)
    more = F.when(F.col(key) < F.col(tmp["cut_key"]), n).when(F.col(key) == F.col(tmp["cut_key"]), F.least(n, F.col(tmp["cut_words"]))).otherwise(0)
    return out.select(
        *docs.columns, size, F.col(tmp["source_size"]).alias(source_size), F.col(tmp["target"]).alias(target),
        (F.col(tmp["epochs"]) * n + more).cast("long").alias(taken),
    )


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as it is taken, the one at a cut with its first words only.

    Columns are those of docs; the cut document's text ends after the last word taken.
    """
    names = [fresh(docs, f"_mix_{k}") for k in ("size", "source_size", "target", "taken")]
    text_col = options.get("text_col", "text")
    copy, part = fresh(docs, "_copy"), fresh(docs, "_part")
    m = mix(docs, names=names, **options)
    size, taken = F.col(names[0]), F.col(names[3])
    m = m.where(taken > 0).withColumn(part, taken % F.greatest(size, F.lit(1)))
    m = m.withColumn(copy, F.explode(F.sequence(F.lit(1), F.ceil(taken / size).cast("int"))))
    cut = (F.col(copy) > F.floor(taken / size)) & (F.col(part) > 0)
    rest = F.array_join(F.slice(F.split(F.col(text_col), r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"), F.lit(1), F.greatest(F.col(part), F.lit(1)).cast("int")), "")
    shortened = F.when(cut, rest).otherwise(F.col(text_col))
    m = m.withColumn(text_col, shortened)
    if "n_chars" in docs.columns:
        m = m.withColumn("n_chars", F.when(cut, F.length(text_col).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return m.select(*docs.columns)


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed with weights 5, 2, 1 and at most 3 epochs."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op9_mix_sources": op9_mix_sources}

ORACLE_SQL = {
    "op9_mix_sources": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS key,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, 3 * source_size AS cap,
             CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY cap / weight, source ASC NULLS LAST) AS k,
             coalesce(sum(cap) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS caps,
             coalesce(sum(weight) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ws,
             (sum(source_size) OVER ())::BIGINT AS total, sum(weight) OVER () AS wall FROM w),
l AS (SELECT *, (total - caps)::DOUBLE / (wall - ws) AS level FROM o),
f AS (SELECT arg_min(level, k) AS level FROM l WHERE weight * level < cap),
t AS (SELECT source, source_size, CASE WHEN f.level IS NULL THEN cap::DOUBLE ELSE least(cap::DOUBLE, weight * f.level) END AS target FROM l LEFT JOIN f ON true),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS epochs,
             CASE WHEN source_size > 0 THEN floor(target)::BIGINT % source_size ELSE 0 END AS rest FROM t),
g AS (SELECT source, key, sum(size)::BIGINT AS n, count(*) AS copies FROM d GROUP BY source, key),
p AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS upto FROM g)
SELECT d.doc_id, d.size, b.source_size, b.target,
       (b.epochs * d.size + CASE WHEN b.rest >= p.upto + p.n THEN d.size WHEN b.rest > p.upto THEN least(d.size, (b.rest - p.upto) // p.copies) ELSE 0 END)::BIGINT AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source JOIN p ON d.source IS NOT DISTINCT FROM p.source AND d.key = p.key
""",
}
