"""Filters by criteria, import review, decisions on links, question routing, plans, adapters and text reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .project import DONE

# Routes of questions, first match wins, and the minutes of plan steps.
ROUTES = [
    ("blocking", r"\b(block|blocked|blocking|hold|waiting)\b"), ("readiness", r"\b(ready|readiness|turnover)\b"), ("evidence", r"\b(evidence|proof|document|record)s?\b"), ("change", r"\b(change|impact|affect)\w*\b"),
    ("governance", r"\b(govern|require|specification|code|standard)\w*\b"), ("schedule", r"\b(schedule|when|milestone|date)s?\b"), ("risk", r"\b(risk|attention|worst)s?\b"), ("explanation", r"\b(why|explain|reason)\b"),
]
TURNOVER = [("resolve-deficiency", 30), ("complete-inspection", 15), ("assemble-records", 60), ("walk-through", 45), ("sign-off", 15)]


def by_criteria(df: DataFrame, criteria: Mapping[str, object]) -> DataFrame:
    """Rows that meet all criteria: a value, a list of values, or {min, max, contains}; unknown columns are an error."""
    for name, want in criteria.items():
        c = F.col(name)
        if isinstance(want, Mapping):
            unknown = set(want) - {"min", "max", "contains"}
            if unknown:
                raise ValueError(f"unknown criteria: {sorted(unknown)}")
            if "min" in want:
                df = df.where(c >= want["min"])
            if "max" in want:
                df = df.where(c <= want["max"])
            if "contains" in want:
                df = df.where(F.lower(c.cast("string")).contains(str(want["contains"]).lower()))
        elif isinstance(want, (list, tuple, set)):
            df = df.where(c.isin(list(want)))
        else:
            df = df.where(c.eqNullSafe(F.lit(want)))
    return df


def holds_query(text: Column | str, terms: Sequence[str]) -> Column:
    """Whether a text holds one of the terms; no terms match all."""
    t = F.lower(T.folded(text))
    return reduce(lambda a, b: a | b, [t.contains(x.lower()) for x in terms], F.lit(not terms))


def eligible(kind: Column, discipline: Column) -> Column:
    """struct<rooms, equipment, callouts>: what may be read from a sheet of a type and discipline."""
    index = kind.isin("Index", "Cover")
    return F.struct((~index & ~kind.isin("Detail", "Schedule")).alias("rooms"), (~index & ~discipline.isin("Architectural", "Civil")).alias("equipment"), (~index).alias("callouts"))


def real_rows(df: DataFrame, name: str, numbers: Sequence[str]) -> DataFrame:
    """Rows of a report with a name that is no total or heading, and a number somewhere."""
    n = T.normalized_key(name)
    some = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in numbers])
    return df.where((n != "") & ~n.rlike(r"^(total|average|building|name|grand total|notes?)\b") & some)


def review_batch(files: DataFrame, corrections: DataFrame) -> DataFrame:
    """(id, kind, project, state): files of an import with corrections in place: ready, needs-review or rejected.

    files: id, name, kind, project, confidence, error; corrections: id, kind, project.
    """
    c = corrections.select("id", F.col("kind").alias("ck"), F.col("project").alias("cp"))
    j = files.join(c, "id", "left")
    kind, project = F.coalesce("ck", "kind"), F.coalesce("cp", "project")
    fixed = F.col("ck").isNotNull() | F.col("cp").isNotNull()
    state = F.when(F.col("error").isNotNull(), "rejected").when(kind.isNull() | project.isNull(), "needs-review").when(fixed | (F.col("confidence") >= 0.8), "ready").otherwise("needs-review")
    return j.select("id", kind.alias("kind"), project.alias("project"), state.alias("state"))


def read_json_tolerant(spark: SparkSession, paths: Sequence[str], schema: str) -> DataFrame:
    """Rows of the JSON files that exist; malformed ones give null rows that are dropped."""
    hadoop = spark._jsc.hadoopConfiguration()
    there = []
    for p in paths:
        h = spark._jvm.org.apache.hadoop.fs.Path(p)
        if h.getFileSystem(hadoop).exists(h):
            there.append(p)
    if not there:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(there).na.drop("all")


def decided_links(links: DataFrame, decisions: DataFrame) -> DataFrame:
    """Links (src, dst, confidence) with the latest decision on each: rejected ones go, confirmed ones are certain; added ones join.

    decisions: src, dst, decision (confirm, reject, add), seq.
    """
    w = Window.partitionBy("src", "dst").orderBy(F.desc("seq"))
    d = decisions.withColumn("n", F.row_number().over(w)).where("n = 1").select("src", "dst", "decision")
    j = links.join(d, ["src", "dst"], "full_outer").where("coalesce(decision, '') <> 'reject'").where("confidence is not null or decision = 'add'")
    return j.select("src", "dst", F.when(F.col("decision").isNotNull(), 1.0).otherwise(F.col("confidence")).alias("confidence"), F.coalesce("decision", F.lit("suggested")).alias("state"))


def answer_confidence(hits: DataFrame) -> DataFrame:
    """One row: high, medium or low, by the number of sources, documents and the best coverage. hits: document_id, coverage."""
    s = hits.agg(F.count("*").alias("sources"), F.count_distinct("document_id").alias("documents"), F.coalesce(F.max("coverage"), F.lit(0.0)).alias("coverage"))
    level = F.when(F.col("sources") == 0, "none").when((F.col("coverage") >= 0.8) & (F.col("sources") >= 3), "high").when(F.col("coverage") >= 0.5, "medium").otherwise("low")
    return s.withColumn("confidence", level)


def top_values(df: DataFrame, label: str, value: str, most: int) -> DataFrame:
    return df.groupBy(label).agg(F.sum(value).alias("total")).orderBy(F.desc("total"), label).limit(most)


def route(question: Column | str) -> Column:
    """The kind of a question about the project."""
    return T.ladder(question, ROUTES, "general")


def graph_issues(nodes: DataFrame, edges: DataFrame, node_types: Sequence[str], edge_types: Sequence[str]) -> DataFrame:
    """(id, issue): nodes and edges of unknown types, edges without ends, and verified nodes without a source."""
    have = nodes.select("node").distinct()
    a = nodes.where(~F.col("type").isin(list(node_types))).select(F.col("node").alias("id"), F.lit("unknown-node-type").alias("issue"))
    b = edges.where(~F.col("kind").isin(list(edge_types))).select(F.concat_ws(">", "src", "dst").alias("id"), F.lit("unknown-edge-type").alias("issue"))
    ends = edges.select(F.concat_ws(">", "src", "dst").alias("id"), F.explode(F.array("src", "dst")).alias("node")).join(have, "node", "left_anti").select("id", F.lit("missing-end").alias("issue")).distinct()
    d = nodes.where((F.col("state") == "verified") & F.col("source").isNull()).select(F.col("node").alias("id"), F.lit("verified-without-source").alias("issue"))
    return a.unionByName(b).unionByName(ends).unionByName(d)


def section_graph(sections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of sections: documents contain them, sections contain their parts, numbers are cited."""
    docs = sections.select(F.concat(F.lit("document:"), "document_id").alias("node"), F.lit("document").alias("type")).distinct()
    secs = sections.select(F.concat(F.lit("section:"), "id").alias("node"), F.lit("section").alias("type"))
    inside = sections.select(F.when(F.col("parent_id").isNull(), F.concat(F.lit("document:"), "document_id")).otherwise(F.concat(F.lit("section:"), "parent_id")).alias("src"), F.concat(F.lit("section:"), "id").alias("dst"), F.lit("contains").alias("kind"))
    cites = sections.select(F.concat(F.lit("section:"), "id").alias("src"), F.explode("cross_references").alias("r")).select("src", F.concat(F.lit("number:"), T.section_number_key("r")).alias("dst"), F.lit("cites").alias("kind"))
    numbers = cites.select(F.col("dst").alias("node"), F.lit("number").alias("type")).distinct()
    return docs.unionByName(secs).unionByName(numbers), inside.unionByName(cites)


def turnover_plan(deficiencies: DataFrame, inspections: DataFrame) -> DataFrame:
    """(step, object, minutes): open deficiencies, unfinished inspections, then the fixed steps. inspections: object, status."""
    minutes = dict(TURNOVER)
    spark = deficiencies.sparkSession
    a = deficiencies.where(~F.lower(T.folded("status")).isin(*DONE)).select(F.lit("resolve-deficiency").alias("step"), "object", F.lit(minutes["resolve-deficiency"]).alias("minutes"))
    b = inspections.where(~F.lower(T.folded("status")).isin(*DONE)).select(F.lit("complete-inspection").alias("step"), "object", F.lit(minutes["complete-inspection"]).alias("minutes"))
    rest = spark.createDataFrame([(s, None, m) for s, m in TURNOVER[2:]], "step string, object string, minutes int")
    return a.unionByName(b).unionByName(rest)


def plan_total(plan: DataFrame) -> DataFrame:
    return plan.groupBy("step").agg(F.count("*").alias("n"), F.sum("minutes").alias("minutes"))


def report_lines(reqs: DataFrame) -> DataFrame:
    """(place, line): a text report of requirements by strength: number, type, statement and source."""
    w = Window.orderBy(F.desc("strength"), "requirement_id")  # one answer's requirements
    line = F.concat(F.row_number().over(w).cast("string"), F.lit(". ["), F.upper("type"), F.lit("] "), T.truncated("statement", 120), F.lit(" ("), F.col("document_id"), F.lit(", "), F.col("heading"), F.lit(")"))
    return reqs.select(F.row_number().over(w).alias("place"), line.alias("line"))


def specification_index(sections: DataFrame, words: str | None = None) -> DataFrame:
    """(number, title, sections, pages): one row a section number, of those that hold the words if any are given."""
    g = sections.where("section_number <> ''").groupBy("section_number").agg(
        F.min_by("heading", F.struct("level", "ord")).alias("title"), F.count("*").alias("sections"), F.min("page_start").alias("first_page"), F.max("page_end").alias("last_page"), F.lower(F.concat_ws(" ", F.collect_list("heading"))).alias("_b"))
    g = g if words is None else g.where(F.col("_b").contains(words.lower()) | F.col("section_number").contains(words))
    return g.drop("_b")
