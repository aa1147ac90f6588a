"""Project state: facts, identities, state log, relations, readiness, orchestration, plans and dashboards."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Life cycles, weights and readiness words.
FACT_STATES = ("suggested", "verified", "rejected", "retired", "superseded")
DONE = ("complete", "completed", "passed", "approved", "accepted", "closed", "resolved")
PRIORITY_WEIGHTS = {"safety": 10.0, "life-safety": 10.0, "schedule": 7.0, "quality": 6.0, "cost": 5.0, "coordination": 4.0, "closeout": 3.0}
SEVERITY_RANK = {"critical": 0, "high": 1, "medium": 2, "low": 3}


# --- facts, identities, evidence -------------------------------------------------------------------

def latest_facts(log: DataFrame) -> DataFrame:
    """The current state of every fact of an append-only log (fact_id, subject, predicate, object, state, moment, source)."""
    w = Window.partitionBy("fact_id").orderBy(F.desc("moment"), F.desc("state"))
    return log.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def fact_conflicts(facts: DataFrame) -> DataFrame:
    """(subject, predicate, objects): live facts that say different things of one subject."""
    live = facts.where(F.col("state").isin("suggested", "verified"))
    return live.groupBy("subject", "predicate").agg(F.count_distinct("object").alias("objects"), F.min("object").alias("first"), F.max("object").alias("last")).where("objects > 1")


def evidence_confidence(facts: DataFrame) -> DataFrame:
    """(subject, predicate, object, sources, confidence): a quarter for each distinct source, 1 at most."""
    g = facts.groupBy("subject", "predicate", "object").agg(F.count_distinct("source").alias("sources"))
    return g.withColumn("confidence", F.least(F.lit(1.0), F.col("sources") * 0.25))


def identities(names: DataFrame) -> DataFrame:
    """(canonical, n, best): names that mean one thing, by letters and digits without leading zeros."""
    k = F.regexp_replace(F.regexp_replace(F.upper(T.folded("name")), "[^A-Z0-9]", ""), r"([A-Z])0+(\d)", "$1$2")
    return names.withColumn("canonical", k).where("canonical <> ''").groupBy("canonical").agg(F.count("*").alias("n"), F.min("name").alias("best"))


def name_similarity(a: Column, b: Column) -> Column:
    """1 if equal, 0.8 if one holds the other, else the share of the longer one's characters that the shorter has."""
    a, b = T.normalized_key(a), T.normalized_key(b)
    long, short = F.when(F.length(a) >= F.length(b), a).otherwise(b), F.when(F.length(a) >= F.length(b), b).otherwise(a)
    shared = F.size(F.filter(F.split(short, ""), lambda c: (c != "") & long.contains(c)))
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).when(long.contains(short), 0.8).otherwise(shared / F.greatest(F.length(long), F.lit(1)))


# --- states ----------------------------------------------------------------------------------------

def _changes(log: DataFrame) -> DataFrame:
    sid = F.concat_ws(":", F.lit("STATE"), F.regexp_replace(F.lower("category"), "[^a-z]", ""), F.regexp_replace(F.lower(T.folded("scope")), "[^a-z0-9]", ""))
    w = Window.partitionBy("state_id").orderBy("moment", "seq")
    s = log.withColumn("state_id", sid).withColumn("was", F.lag("state").over(w))
    return s.where("was is null or was <> state")


def state_history(log: DataFrame) -> DataFrame:
    """(state_id, moment, was, state): every change of the log (category, scope, state, moment, seq); repeats of a state are no change."""
    return _changes(log).select("state_id", "moment", "was", "state")


def current_states(log: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """(state_id, state, since, changes, stale) of the latest entry of every state."""
    h = _changes(log).groupBy("state_id").agg(F.max_by("state", F.struct("moment", "seq")).alias("state"), F.max("moment").alias("since"), (F.count("*") - 1).alias("changes"))
    return h.withColumn("stale", F.unix_timestamp(as_of.cast("timestamp")) - F.unix_timestamp("since") > hours * 3600)


def kept_history(log: DataFrame, key: str, most: int = 20) -> DataFrame:
    """The newest entries of every key, at most `most`."""
    w = Window.partitionBy(key).orderBy(F.desc("moment"), F.desc("seq"))
    return log.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


# --- relations of objects --------------------------------------------------------------------------

def missing_relation(objects: DataFrame, relations: DataFrame, kind: str) -> DataFrame:
    """Objects without a relation of a kind: no submittal, inspection, sheet or specification."""
    return objects.join(relations.where(F.col("kind") == kind).select(F.col("src").alias("id")).distinct(), "id", "left_anti")


def inherited_relations(relations: DataFrame, parents: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """relations and those of the kinds that children take from their parents, marked as such."""
    got = relations.where(F.col("kind").isin(list(kinds))).join(parents.select("child", F.col("parent").alias("src")), "src").select(F.col("child").alias("src"), "dst", "kind")
    new = got.distinct().join(relations, ["src", "dst", "kind"], "left_anti").withColumn("origin", F.lit("inherited"))
    return relations.withColumn("origin", F.lit("stated")).unionByName(new)


def readiness(nodes: DataFrame, dimensions: Sequence[str], overrides: DataFrame) -> DataFrame:
    """(id, dimension, state): the worst state of what an object needs by dimension (a word of the need's type); an override wins.

    nodes: id, need_type, status.
    """
    rank = F.when(F.lower("status") == "blocked", 3).when(F.lower("status").isin(*DONE), 1).when(F.col("status").isNull(), 2).otherwise(2)
    d = nodes.select("id", F.lower("need_type").alias("t"), rank.alias("r"))
    parts = [d.where(F.col("t").contains(x.split("-")[0])).groupBy("id").agg(F.max("r").alias("r")).withColumn("dimension", F.lit(x)) for x in dimensions]
    every = nodes.select("id").distinct().crossJoin(nodes.sparkSession.createDataFrame([(x,) for x in dimensions], "dimension string"))  # a literal list
    j = every.join(reduce(DataFrame.unionByName, parts), ["id", "dimension"], "left").join(overrides.select("id", "dimension", F.col("state").alias("own")), ["id", "dimension"], "left")
    state = F.coalesce("own", F.when(F.col("r") == 3, "blocked").when(F.col("r") == 2, "incomplete").when(F.col("r") == 1, "ready").otherwise("unknown"))
    return j.select("id", "dimension", state.alias("state"))


def impacts(edges: DataFrame, changed: str, depth: int = 8, most: int = 500) -> DataFrame:
    """(node, depth): what a change touches, nearest first, at most `most`."""
    from .graph import reachable

    seeds = edges.sparkSession.createDataFrame([(changed,)], "node string")
    return reachable(edges, seeds, depth).select("node", "depth").orderBy("depth", "node").limit(most)


# --- orchestration ---------------------------------------------------------------------------------

def blocked(work: DataFrame, needs: DataFrame) -> DataFrame:
    """(id, open_needs): work items with needs that are not done. needs: id, need, status."""
    return work.join(needs.where(~F.lower(T.folded("status")).isin(*DONE)), "id").groupBy("id").agg(F.count("*").alias("open_needs"))


def schedule_impact(deficiencies: DataFrame, limit: int = 5) -> DataFrame:
    """(object, open): objects with more open deficiencies than the limit."""
    return deficiencies.where(~F.lower(T.folded("status")).isin(*DONE)).groupBy("object").agg(F.count("*").alias("open")).where(F.col("open") > limit)


def priorities(items: DataFrame, weights: dict[str, float] = PRIORITY_WEIGHTS) -> DataFrame:
    """(id, priority): weight of the category times the value over ten, 1 at most."""
    m = F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))
    return items.select("id", F.least(F.lit(1.0), F.coalesce(F.try_element_at(m, F.lower("category")), F.lit(1.0)) * F.col("value") / 10).alias("priority")).orderBy(F.desc("priority"), "id")


def health(ratios: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean of the ratios that are there, in percent."""
    x = ratios.select(F.explode(F.array(*(F.col(k) for k in keys))).alias("v"))
    return x.agg(F.count("v").alias("n"), T.rounded(100 * F.avg("v"), 1).alias("health"))


def inspection_plan(objects: DataFrame, deficiencies: DataFrame, inspections: DataFrame, as_of: Column, minutes: int = 480) -> DataFrame:
    """(step, object, reason, minutes, confidence): open deficiencies first (30 minutes), then objects not inspected for 7 days (15), up to a day's work."""
    open_ = deficiencies.where(~F.lower(T.folded("status")).isin(*DONE)).select("object").distinct()
    recent = inspections.where(F.datediff(as_of, F.col("moment")) <= 7).select("object").distinct()
    o = objects.select(F.col("id").alias("object"), F.when(F.col("has_spec"), 0.85).otherwise(0.6).alias("confidence"))
    a = o.join(open_, "object", "left_semi").select("object", F.lit("open-deficiency").alias("reason"), F.lit(30).alias("minutes"), "confidence", F.lit(0).alias("k"))
    b = o.join(recent, "object", "left_anti").join(open_, "object", "left_anti").select("object", F.lit("not-inspected").alias("reason"), F.lit(15).alias("minutes"), "confidence", F.lit(1).alias("k"))
    w = Window.orderBy("k", "object")  # one project's objects: a plan for a day
    p = a.unionByName(b).withColumns({"step": F.row_number().over(w), "total": F.sum("minutes").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    return p.where(F.col("total") <= minutes).select("step", "object", "reason", "minutes", "confidence")


# --- dashboards ------------------------------------------------------------------------------------

def percent(c: Column) -> Column:
    """A share from `85 %`, `0.85` or `85`: above 1.5 it is taken for percent; null if it is no number."""
    s = F.regexp_replace(T.folded(c), r"[%,\s]", "")
    v = s.try_cast("double")
    return F.when(v > 1.5, v / 100).otherwise(v)


def posture(risks: Column, questions: Column, ready: Column) -> Column:
    return F.when((risks >= 8) | (ready < 0.55), "High").when((risks >= 4) | (questions >= 6) | (ready < 0.8), "Elevated").when((risks > 0) | (questions > 0), "Monitor").otherwise("Controlled")


def dashboard(buildings: DataFrame) -> DataFrame:
    """Buildings (id, readiness, risks, questions): total, average readiness, ready ones, risks and the campus posture."""
    s = buildings.agg(F.count("*").alias("total"), F.round(F.avg("readiness"), 6).alias("average"), F.count_if(F.col("readiness") >= 0.9).alias("ready"), F.sum("risks").cast("long").alias("risks"))
    return s.withColumn("posture", F.when(F.col("average") >= 0.8, "Mission Ready").when(F.col("average") >= 0.55, "Watch").otherwise("Critical"))


def attention(buildings: DataFrame, most: int = 5) -> DataFrame:
    """The buildings with most points: three a risk, two a question, one a percent that is missing."""
    points = 3 * F.col("risks") + 2 * F.col("questions") + (100 - T.rounded(100 * F.col("readiness")))
    return buildings.select("id", points.cast("double").alias("points"), posture(F.col("risks"), F.col("questions"), F.col("readiness")).alias("posture")).orderBy(F.desc("points"), "id").limit(most)


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key: the last."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def facets(rows: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """One row with how many rows meet each test, and all of them."""
    return rows.agg(F.count("*").alias("all_rows"), *(F.count_if(c).alias(n) for n, c in tests.items()))


def source_counts(docs: DataFrame, categories: dict[str, str]) -> DataFrame:
    """(category, n): documents by the words of their tags; one may count in several."""
    m = F.explode(F.array_compact(F.array(*(F.when(F.array_join("tags", " ").rlike(f"(?i){p}"), F.lit(n)) for n, p in categories.items()))))
    return docs.select(m.alias("category")).groupBy("category").agg(F.count("*").alias("n"))


def recent_activity(events: DataFrame, most: int = 8) -> DataFrame:
    return events.orderBy(F.desc("moment"), "id").limit(most)


def next_numbers(records: DataFrame, group: str, number: str) -> DataFrame:
    """(group, next): one more than the highest number of each group."""
    return records.groupBy(group).agg((F.max(number) + 1).alias("next"))


def search_records(parts: dict[str, DataFrame], words: str, most: int = 60) -> DataFrame:
    """(source, id, title): records of several tables (id, title, body) that hold the words, once each title, titles first."""
    n = words.lower()
    rows = [df.select(F.lit(s).alias("source"), F.col("id").cast("string").alias("id"), "title", F.lower(F.concat_ws(" ", "title", "body")).alias("b")) for s, df in parts.items()]
    u = reduce(DataFrame.unionByName, rows).where(F.col("b").contains(n))
    w = Window.partitionBy(T.normalized_key("title")).orderBy("source", "id")
    u = u.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return u.orderBy((~F.lower("title").contains(n)).cast("int"), "source", "id").limit(most).select("source", "id", "title")


def work_package(sheet: str, relations: DataFrame, inspections: DataFrame, documents: DataFrame) -> DataFrame:
    """(kind, n, items): what belongs to a sheet: objects, inspections of them, and documents that govern them."""
    objs = relations.where((F.col("dst") == sheet) & (F.col("kind") == "appears-on")).select(F.col("src").alias("object")).distinct()
    ins = inspections.join(objs, "object", "left_semi").select(F.col("inspection").alias("item"))
    gov = relations.where("kind = 'governed-by'").join(objs, F.col("src") == F.col("object"), "left_semi").select(F.col("dst").alias("item")).distinct()
    gov = gov.join(documents.select(F.col("id").alias("item")), "item", "left_semi")
    row = lambda kind, df, c: df.agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(c)), ",").alias("items")).select(F.lit(kind).alias("kind"), "n", "items")
    return row("objects", objs, "object").unionByName(row("inspections", ins, "item")).unionByName(row("documents", gov, "item"))


def compare_models(a: DataFrame, b: DataFrame) -> DataFrame:
    """(dimension, only_a, only_b, common): values of two models (dimension, value) by dimension."""
    x, y = a.distinct().withColumn("a", F.lit(1)), b.distinct().withColumn("b", F.lit(1))
    j = x.join(y, ["dimension", "value"], "full_outer")
    return j.groupBy("dimension").agg(F.count_if(F.col("b").isNull()).alias("only_a"), F.count_if(F.col("a").isNull()).alias("only_b"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("common"))
