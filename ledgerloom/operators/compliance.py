"""Compliance of requirements by the evidence linked to them: findings, status of each requirement, score and actions.

requirements: id, text, level (prohibited, shall, must, required, will, should,
may), status, party, authority, required (array of evidence types); evidence: id,
type, outcome (pass, fail, waived, unknown), document, section, day, author,
description; links: requirement_id, evidence_id.  Links to unknown rows and
repeated links count for nothing; missing arrays are empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .pairs import similar_sets
from .rules import clamp, finding, severity_rank

# Findings by missing evidence type, and weights of severities.
MISSING = {"test_report": "missing-test", "inspection_report": "missing-inspection", "submittal": "missing-submittal", "approval": "missing-approval", "certificate": "missing-certificate", "closeout": "missing-closeout", "training": "missing-training"}
WEIGHT = {"critical": 18.0, "high": 9.0, "medium": 4.0, "low": 1.5, "info": 0.5}
BINDING = ["shall", "must", "required"]


def _level_severity(level: Column) -> Column:
    return F.when(level == "prohibited", "critical").when(level.isin(BINDING), "high").when(level.isin("will", "should"), "medium").otherwise("low")


def _named(links: DataFrame) -> list[str]:
    """What links (requirement_id, ...) name evidence by: evidence_id, or columns of evidence, each requirement with all that has these values."""
    return ["evidence_id"] if "evidence_id" in links.columns else [c for c in links.columns if c != "requirement_id"]


def _linked(requirements: DataFrame, evidence: DataFrame, links: DataFrame) -> DataFrame:
    """Requirements with what is linked to them: n_evidence, types, failed, counted (any not waived) and released (a waiver or an approval).

    What a link names is summed up before requirements meet it, so that no pairs of requirements and evidence are made.
    """
    on = _named(links)
    e = evidence.withColumns({"evidence_id": F.col("id"), "_type": F.col("type")}).select("_type", "outcome", *on)
    waived = F.coalesce(F.col("outcome") == "waived", F.lit(False))
    e = e.groupBy(*on).agg(
        F.count("*").alias("n_evidence"), F.collect_set("_type").alias("types"), F.max(F.coalesce(F.col("outcome") == "fail", F.lit(False))).alias("failed"), F.max(~waived).alias("counted"), F.max(waived | F.coalesce(F.col("_type") == "approval", F.lit(False))).alias("released"),
    )
    g = links.select("requirement_id", *on).distinct().join(e, on).groupBy(F.col("requirement_id").alias("id"))
    g = g.agg(F.sum("n_evidence").alias("n_evidence"), F.array_distinct(F.flatten(F.collect_list("types"))).alias("types"), *(F.max(c).alias(c) for c in ("failed", "counted", "released")))
    no = F.lit(False)
    out = requirements.join(g, "id", "left").withColumns({"n_evidence": F.coalesce("n_evidence", F.lit(0)), "types": F.coalesce("types", F.array().cast("array<string>")), "failed": F.coalesce("failed", no), "counted": F.coalesce("counted", no), "released": F.coalesce("released", no)})
    return out.withColumn("required", F.coalesce("required", F.array().cast("array<string>")))


def requirement_findings(requirements: DataFrame, evidence: DataFrame, links: DataFrame) -> DataFrame:
    """What each requirement lacks; node_b is the evidence type that is missing, if one is."""
    r = _linked(requirements, evidence, links)
    level, none = F.col("level"), F.lit(None).cast("string")

    def found(where: Column, kind: Column | str, severity: Column | str, confidence: float, b: Column = none) -> Column:
        lit = lambda x: x if isinstance(x, Column) else F.lit(x)
        return F.when(where, F.struct(lit(kind).alias("type"), lit(severity).alias("severity"), b.alias("node_b"), F.lit(confidence).alias("confidence")))

    kinds = F.create_map(*(F.lit(x) for kv in MISSING.items() for x in kv))
    lacking = F.transform(F.array_distinct(F.array_except("required", "types")), lambda t: found(F.lit(True), F.coalesce(F.try_element_at(kinds, t), F.lit("missing-evidence")), _level_severity(level), 0.92, t))
    flat = F.array(
        found((level == "prohibited") & F.col("counted"), "prohibited-condition", "critical", 0.96), found(F.col("n_evidence") == 0, "missing-evidence", _level_severity(level), 0.96), found(F.col("failed"), "non-compliant", "critical", 0.98),
        found(F.col("party").isNull() & level.isin(BINDING), "missing-responsible-party", "medium", 0.8), found(F.col("text").rlike(r"(?i)\b(approve(d|al)?|accept(ed|ance)?)\b") & F.col("authority").isNull(), "missing-acceptance-authority", "medium", 0.82),
        found((F.col("status") == "waived") & ~F.col("released"), "waiver-not-documented", "high", 0.9),
    )
    out = r.select("id", F.explode(F.array_compact(F.concat(flat, lacking))).alias("f"))
    return out.select(F.lit("compliance").alias("rule"), F.col("f.type").alias("type"), F.col("f.severity").alias("severity"), F.col("id").alias("node_a"), F.col("f.node_b").alias("node_b"), F.col("f.confidence").alias("confidence"))


def evidence_findings(evidence: DataFrame, links: DataFrame, alike: float = 0.9) -> DataFrame:
    """Evidence without requirement, day or author; the same said twice in one place; passes and failures in one document or section.

    Of a document's or section's passes and failures the first of each are named,
    not all pairs of them.
    """
    one = lambda where, kind, conf: evidence.where(where).select(*finding("compliance", kind, "low", "id", None, conf))
    orphan = evidence.withColumn("evidence_id", F.col("id")).join(links.select(*_named(links)).distinct(), _named(links), "left_anti").select(*finding("compliance", "orphan-evidence", "low", "id", None, 0.78))
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    e = evidence.select("id", F.coalesce("type", F.lit("")).alias("type"), low("document").alias("document"), low("section").alias("section"), T.stem_set("description").alias("w"))
    twice = similar_sets(e, F.col("w"), alike, same=("type", "document", "section"), either=True).select(*finding("compliance", "duplicate-evidence", "low", "a_id", "b_id", F.col("similarity")))
    scope = F.array_compact(F.array(F.when(F.col("document") != "", F.concat(F.lit("document "), low("document"))), F.when(F.col("section") != "", F.concat(F.lit("section "), low("section")))))
    said = evidence.where("outcome in ('pass', 'fail')").select("id", "outcome", F.explode(scope).alias("scope"))
    g = said.groupBy("scope").agg(F.min(F.when(F.col("outcome") == "pass", F.col("id"))).alias("a"), F.min(F.when(F.col("outcome") == "fail", F.col("id"))).alias("b")).where("a is not null and b is not null").select("a", "b").distinct()
    against = g.select(*finding("compliance", "conflicting-evidence", "critical", "a", "b", 0.8))
    return orphan.unionByName(one("day is null", "undated-evidence", 0.8)).unionByName(one("author is null or author = ''", "unattributed-evidence", 0.76)).unionByName(twice).unionByName(against)


def requirement_statuses(requirements: DataFrame, evidence: DataFrame, links: DataFrame) -> DataFrame:
    """(id, level, status, n_evidence, findings): each requirement with its status by the worst of its findings, and their types."""
    f = requirement_findings(requirements, evidence, links)
    worst = f.groupBy(F.col("node_a").alias("id")).agg(F.max(severity_rank(F.col("severity"))).alias("worst"), F.array_sort(F.collect_set("type")).alias("findings"))
    r = _linked(requirements, evidence, links).withColumnRenamed("status", "_given").join(worst, "id", "left")
    status = (
        F.when(F.col("_given").isin("not_applicable", "waived"), F.col("_given")).when(F.col("worst") == 4, "non_compliant").when(F.col("worst") >= 2, "partial").when(F.col("n_evidence") > 0, "compliant").otherwise("pending")
    )
    return r.select("id", "level", status.alias("status"), "n_evidence", F.coalesce("findings", F.array().cast("array<string>")).alias("findings"))


def compliance_summary(findings: DataFrame) -> DataFrame:
    """(findings, score, outcome, status) in one row: 100 less weight times confidence of every finding, rounded, 0 at least."""
    m = F.create_map(*(F.lit(x) for kv in WEIGHT.items() for x in kv))
    loss = F.coalesce(F.round(F.sum(F.coalesce(F.try_element_at(m, F.col("severity")), F.lit(4.0)) * clamp(F.col("confidence"), 0.25)), 6), F.lit(0.0))
    s = findings.agg(F.count("*").alias("findings"), F.greatest(F.lit(0), F.floor(100 - loss + 0.5)).cast("long").alias("score"), F.max(severity_rank(F.col("severity"))).alias("worst"))
    worst = F.coalesce("worst", F.lit(-1))
    outcome = F.when((worst == 4) | (F.col("score") < 70), "non_compliant").when(F.col("score") < 95, "partial").otherwise("compliant")
    status = F.when(worst == 4, "critical").when(worst == 3, "attention_required").when(F.col("findings") > 0, "review_required").otherwise("healthy")
    return s.select("findings", "score", outcome.alias("outcome"), status.alias("status"))
