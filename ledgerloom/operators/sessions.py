"""Corpus analysis: one question's results by preset, and sessions that analyse again only what changed.

A session keeps, for each document and rule, the fingerprint and the rule's
version that its findings belong to.  The next run compares; only documents that
are new or changed, or all where the rule has a new version, go through a rule.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from . import analysis as A
from . import extraction as X
from .graph import _settled

#: What a preset computes; each part is a DataFrame that nothing runs before it is asked for.
PRESETS = {
    "answer": ("context", "requirements", "responsibilities", "deliverables", "acceptance", "exceptions"),
    "full": ("context", "requirements", "responsibilities", "deliverables", "acceptance", "exceptions", "compliance", "evidence", "graph", "summary", "corpus"),
}
FINDING = "id string, rule string, type string, severity string, node_a string, node_b string, confidence double"


def analyze(hits: DataFrame, preset: str = "full", evidence: DataFrame | None = None, **includes: bool) -> dict[str, DataFrame]:
    """The parts of an analysis of hits by name; includes=True or False adds or leaves out a part.

    hits: see extraction, with source_number for the context; evidence: the sections that count as evidence, by default the hits.
    """
    reqs = X.requirements(hits)
    matches = lambda: X.evidence_matches(reqs, hits if evidence is None else evidence)
    parts: dict[str, Callable[[], DataFrame]] = {
        "corpus": lambda: hits, "context": lambda: A.context(hits), "requirements": lambda: reqs, "responsibilities": lambda: X.by_party(reqs), "deliverables": lambda: X.by_deliverable(reqs),
        "acceptance": lambda: X.sentences_of_kind(hits, L.ACCEPTANCE_NODE), "exceptions": lambda: X.sentences_of_kind(hits, L.EXCEPTION_NODE), "evidence": matches, "compliance": lambda: X.compliance_matrix(reqs, matches()),
        "graph": lambda: X.requirement_graph(reqs)[1], "summary": lambda: X.knowledge_summary(hits),
    }
    if unknown := set(includes) - set(parts):
        raise ValueError(f"no such parts: {sorted(unknown)}")
    return {n: make() for n, make in parts.items() if includes.get(n, n in PRESETS[preset])}


@dataclass(frozen=True)
class Rule:
    """findings(docs) has the columns of FINDING; id is the document that a finding comes from, and it depends on that document's row alone."""

    version: str
    findings: Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class State:
    """What a session knows: seen (id, fingerprint, rule, version) and findings (FINDING)."""

    seen: DataFrame
    findings: DataFrame


def fingerprints(docs: DataFrame) -> DataFrame:
    """(id, fingerprint): a hash of all columns by name; ids are unique, nulls and empty texts differ."""
    own = F.to_json(F.struct(*(F.col(c) for c in sorted(docs.columns))), {"ignoreNullFields": "false"})
    return docs.select(F.col("id").cast("string").alias("id"), F.sha2(own, 256).alias("fingerprint"))


def analyze_changes(docs: DataFrame, rules: Mapping[str, Rule], before: State | None = None) -> tuple[State, DataFrame]:
    """The state after docs (id, and what the rules read), and (rule, version, documents, analysed, reused, removed) of the run.

    The state equals that of a run without `before`.  Findings of unchanged documents are taken over, those of
    changed or vanished ones go, and rules that are no longer there go with theirs.  Rules read changed
    documents only; the fingerprints read all columns once.
    """
    spark = docs.sparkSession
    now = _settled(fingerprints(docs))
    seen, findings, report = [], [], []
    for name, rule in rules.items():
        own = now.select("id", "fingerprint", F.lit(name).alias("rule"), F.lit(rule.version).alias("version"))
        seen.append(own)
        known = before.seen.where((F.col("rule") == name) & (F.col("version") == rule.version)) if before else own.limit(0)
        kept = _settled(now.join(known.select("id", "fingerprint"), ["id", "fingerprint"], "left_semi").select("id"))
        stale = now.join(kept, "id", "left_anti").select("id")
        changed = docs.join(stale.select(F.col("id").alias("__id")), F.col("id").cast("string") == F.col("__id"), "left_semi")
        findings.append(rule.findings(changed).select("id", F.lit(name).alias("rule"), "type", "severity", "node_a", "node_b", "confidence"))
        if before:
            findings.append(before.findings.where(F.col("rule") == name).join(kept, "id", "left_semi"))
        gone = known.select("id").join(now.select("id"), "id", "left_anti").agg(F.count("*").alias("removed"))
        counts = now.agg(F.count("*").alias("documents")).crossJoin(kept.agg(F.count("*").alias("reused"))).crossJoin(gone)  # one row each
        report.append(counts.select(F.lit(name).alias("rule"), F.lit(rule.version).alias("version"), "documents", (F.col("documents") - F.col("reused")).alias("analysed"), "reused", "removed"))
    if not rules:
        empty = now.select("id", "fingerprint", F.lit("").alias("rule"), F.lit("").alias("version")).limit(0)
        return State(empty, spark.createDataFrame([], FINDING)), spark.createDataFrame([], "rule string, version string, documents long, analysed long, reused long, removed long")
    union = lambda x: reduce(DataFrame.unionByName, x)
    return State(_settled(union(seen)), _settled(union(findings))), union(report)
