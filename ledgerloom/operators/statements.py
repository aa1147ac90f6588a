"""What the rules reason about, read from texts: who has to do what, acceptance criteria, compliance requirements and evidence, activities.

nodes: id, document, section, heading, text.  A null heading or text is empty;
a node without text has no rows.  All four readings share the clause grammar or
its span functions, and run as Column expressions, so they need no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clauses as C
from ..functions import lexicons as L
from ..functions import text as T
from .graph import task_count
from .pairs import similar_sets
from .rules import clamp, finding, on_pairs, responsibility_conflicts, told

CARRIED = ("document", "section")


def word_set(c: Column, least: int = 3) -> Column:
    """Distinct words of lower-case letters and digits with at least so many characters."""
    return F.array_distinct(F.filter(F.split(T.normalized_key(c), " "), lambda w: F.length(w) >= least))


def _texts(nodes: DataFrame) -> DataFrame:
    return nodes.select("id", *(T.folded(c).alias(c) for c in CARRIED), C.clause_text("heading", "text").alias("text")).where("text <> ''")


def sentence_nodes(docs: DataFrame) -> DataFrame:
    """Documents (id, document, section, text) as nodes of a sentence each, with ids `id#number`: the grammar's work then grows with the text, however long a document is.

    Documents are dealt to all tasks first: the grammar takes far longer than a shuffle, and a file with few row groups has few tasks.
    """
    s = docs.select("id", *CARRIED, "text").repartition(task_count(docs), "id").select("id", *CARRIED, F.posexplode(T.sentences("text")).alias("pos", "text"))
    return s.select(F.concat_ws("#", "id", "pos").alias("id"), *CARRIED, F.lit(None).cast("string").alias("heading"), "text")


def clause_rows(nodes: DataFrame, grammar: C.Grammar = C.RESPONSIBILITY) -> DataFrame:
    """A row for each clause: id, document, section, pos (from 0, by place), action, spans of action, actor, modal and condition, object, actors, negated, exclusive, confidence.

    Offsets count the characters of the squeezed heading and text.  The spans are computed once
    a node, below the row that an action makes.
    """
    t, a = F.col("text"), F.col("_a")
    more = lambda df, cols: df.select("*", *(c.alias(n) for n, c in cols.items()))
    marked = more(more(_texts(nodes), C.found(t, grammar)), C.marks(t, grammar))
    # The outer form, since for the inner one Spark would look for actions in every text once more beforehand.
    rows = more(marked.select("id", *CARRIED, "text", *(c for c in marked.columns if c.startswith("_") and c not in ("_own", "_acts")), "exclusive", F.posexplode_outer("_acts").alias("pos", "_a")).where("pos is not null"), C.around(t, a, grammar))
    rows = more(rows, C.held(t, a, grammar))
    return rows.select("id", *CARRIED, "pos", *(c.alias(n) for n, c in C.clause(t, a, grammar).items()))


def responsibility_statements(nodes: DataFrame, grammar: C.Grammar = C.RESPONSIBILITY) -> DataFrame:
    """The clauses as statements, of equal ones (actors, action, object, negation) in a node the first: statement_id, party, action, object, negated, exclusive, confidence and spans."""
    c = clause_rows(nodes, grammar)
    party = F.when(F.size("actors") > 0, F.array_join(F.array_sort("actors"), ",")).otherwise("unknown")
    c = c.withColumn("party", party).withColumn("_first", F.struct("pos", "span", "actor", "modal", "condition", "object", "object_end", "exclusive", "confidence"))
    kept = c.groupBy("id", *CARRIED, "party", "action", F.lower("object").alias("_object"), "negated").agg(F.min_by("_first", "pos").alias("f"))
    f = F.col("f")
    return kept.select(
        "id", *CARRIED, F.concat_ws("#", "id", f["pos"]).alias("statement_id"), "party", "action", f["object"].alias("object"), "negated", f["exclusive"].alias("exclusive"), f["confidence"].alias("confidence"),
        f["span"].alias("span"), f["actor"].alias("actor"), f["modal"].alias("modal"), f["condition"].alias("condition"), f["object_end"].alias("object_end"),
    )


def responsibility_findings(nodes: DataFrame, grammar: C.Grammar = C.RESPONSIBILITY) -> DataFrame:
    """Conflicts between the statements of all nodes, and nodes that oblige nobody by name."""
    s = responsibility_statements(nodes, grammar)
    known = s.where("party <> 'unknown' and object <> ''").select(F.col("statement_id").alias("id"), "party", "action", "object", "negated", "exclusive", "confidence")
    return responsibility_conflicts(known).unionByName(unassigned(nodes, grammar))


def unassigned(nodes: DataFrame, grammar: C.Grammar = C.RESPONSIBILITY) -> DataFrame:
    """Nodes that oblige somebody (shall, must, required to, is responsible) without naming an actor."""
    bound = F.col("text").rlike(r"(?i)\bshall\b|\bmust\b|\brequired\s+to\b|\bis\s+responsible\b")
    return _texts(nodes).where(bound & (F.size(C.names_in(F.col("text"), grammar.actors)) == 0)).select(*finding("responsibility", "unassigned", "medium", "id", None, 0.68))


def acceptance_criteria(nodes: DataFrame) -> DataFrame:
    """One criterion for each node that names an acceptance action: subject, actions, status, parties, evidence, prerequisites, threshold, negated, confidence."""
    t = F.col("text")
    ends = rf"(?i){L.ACCEPTANCE_SUBJECT_ENDS}"
    before, behind = F.trim(F.regexp_extract(t, rf"(?is)^(.*?){L.ACCEPTANCE_SUBJECT_ENDS}", 1)), F.trim(F.regexp_extract(t, rf"(?is){L.ACCEPTANCE_SUBJECT_ENDS}(.*)$", 1))
    subject = F.trim(F.substring(F.when(t.rlike(ends), F.when(before != "", before).otherwise(behind)).otherwise(t), 1, 180))
    needs = F.array_distinct(F.transform(F.concat(*(F.regexp_extract_all(t, F.lit(f"(?i){p}"), F.lit(1)) for p in L.ACCEPTANCE_PREREQUISITE)), lambda x: F.trim(x)))
    c = _texts(nodes).select(
        "id", *CARRIED, subject.alias("subject"), C.names_in(t, L.ACCEPTANCE_ACTIONS).alias("actions"), T.ladder("text", L.ACCEPTANCE_STATUS, "unknown").alias("status"), C.names_in(t, L.ACCEPTANCE_PARTIES).alias("parties"),
        C.names_in(t, L.ACCEPTANCE_EVIDENCE).alias("evidence"), needs.alias("prerequisites"), t.rlike(f"(?i){L.ACCEPTANCE_THRESHOLD}").alias("threshold"), t.rlike(f"(?i){L.ACCEPTANCE_NEGATION}").alias("negated"),
    ).where("size(actions) > 0")
    more = lambda cond, x: F.when(cond, x).otherwise(0.0)
    confidence = 0.55 + more(F.size("parties") > 0, 0.15) + more(F.col("status") != "unknown", 0.1) + more(F.size("evidence") > 0, 0.1) + more(F.col("threshold"), 0.1)
    return c.withColumn("confidence", F.round(confidence, 6))


def acceptance_findings(criteria: DataFrame, edges: DataFrame, least: float = 0.4) -> DataFrame:
    """Criteria on one subject that contradict each other, gates that are ambiguous, and prerequisites that no edge (src, dst) stands for."""
    keep = ("actions", "status", "parties", "evidence", "threshold", "negated", "confidence")
    same, low, sim = F.arrays_overlap("a_actions", "b_actions"), F.least("a_confidence", "b_confidence"), F.col("similarity")
    other = (F.size("a_parties") > 0) & (F.size("b_parties") > 0) & ~F.arrays_overlap("a_parties", "b_parties")
    between = lambda x: F.array_sort(F.array("a_status", "b_status")) == F.array(*map(F.lit, x))
    rungs = [
        ((F.col("a_negated") != F.col("b_negated")) & same, "contradictory-criteria", 0.65 + 0.2 * sim + 0.1 * low), (between(["prohibited", "required"]), "contradictory-criteria", 0.75 + 0.2 * sim),
        (same & other, "different-acceptor", 0.5 + 0.25 * sim + 0.1 * low), ((F.col("a_status") != F.col("b_status")) & ((F.col("a_status") == "conditional") | (F.col("b_status") == "conditional")), "conditional-mismatch", 0.45 + 0.25 * sim + 0.1 * low),
        (same & ((F.size("a_evidence") == 0) != (F.size("b_evidence") == 0)), "missing-evidence", 0.5 + 0.2 * sim), (same & (F.col("a_threshold") != F.col("b_threshold")), "missing-threshold", 0.45 + 0.2 * sim),
    ]
    first = F.coalesce(*(F.when(cond, F.struct(F.lit(kind).alias("kind"), clamp(conf).alias("conf"))) for cond, kind, conf in rungs))
    kind, conf = F.col("type"), F.col("f.conf")
    severity = (
        F.when(kind == "contradictory-criteria", F.when(conf >= 0.8, "critical").otherwise("high"))
        .when(kind.isin("different-acceptor", "conditional-mismatch"), F.when(conf >= 0.75, "high").otherwise("medium")).otherwise(F.when(conf >= 0.7, "medium").otherwise("low"))
    )
    also = {"f": first} | told("acceptance", F.col("f.kind"), severity, conf)
    p = similar_sets(criteria.select("id", *keep, "subject"), word_set(F.col("subject"), 3), least, keep=keep, also=also)
    lacks = (F.size("parties") == 0).cast("int") + (F.size("evidence") == 0).cast("int") + (~F.col("threshold")).cast("int")
    vague = criteria.where(F.col("status").isin("required", "conditional")).withColumn("lacks", lacks).where("lacks > 0")
    led = edges.select(F.col("dst").alias("id")).distinct()
    return (
        on_pairs(p)
        .unionByName(vague.select(*finding("acceptance", "ambiguous-gate", F.when(F.col("lacks") >= 2, "medium").otherwise("low"), "id", None, 0.55 + F.col("lacks") * 0.1)))
        .unionByName(criteria.where("size(prerequisites) > 0").join(led, "id", "left_anti").select(*finding("acceptance", "unsatisfied-prerequisite", "medium", "id", None, 0.72)))
    )


def _pieces(text: Column) -> Column:
    """Sentences between white space that follows an end mark and goes before a capital or a digit."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?;])\s+(?=[A-Z0-9])"), lambda s: F.trim(s)), lambda s: s != "")


def compliance_requirements(nodes: DataFrame) -> DataFrame:
    """Sentences that require something (weight 0.7 or more): requirement_id, text, level, status, party, authority, required (evidence types), confidence."""
    s = _texts(nodes).select("id", *CARRIED, F.posexplode(_pieces(F.col("text"))).alias("pos", "text"))
    t = F.col("text")
    # The heaviest level, of equal ones the first.
    best = F.greatest(*(F.when(t.rlike(f"(?i){p}"), F.struct(F.lit(w).alias("weight"), F.lit(-i).alias("place"), F.lit(n).alias("level"))) for i, (n, p, w) in enumerate(L.COMPLIANCE_LEVELS)))
    required = F.array_distinct(F.flatten(F.array_compact(F.array(*(F.when(t.rlike(f"(?i){p}"), F.array(*map(F.lit, types))) for p, types in L.COMPLIANCE_CALLS_FOR)))))
    s = s.withColumn("b", best).where(F.col("b.weight") >= 0.7).withColumn("required", required)
    return s.select(
        F.concat_ws("#", "id", "pos").alias("requirement_id"), "id", *CARRIED, "text", F.col("b.level").alias("level"), T.ladder("text", L.COMPLIANCE_STATUS, "unknown").alias("status"),
        T.ladder("text", L.COMPLIANCE_PARTIES).alias("party"), T.ladder("text", L.COMPLIANCE_AUTHORITIES).alias("authority"), "required",
        F.round(clamp(F.col("b.weight") + F.when(F.size("required") > 0, 0.01).otherwise(0.0)), 6).alias("confidence"),
    )


def compliance_evidence(nodes: DataFrame) -> DataFrame:
    """A row for each type of evidence that a node names: evidence_id, type, outcome, day (as text), description, confidence; `other` where only an outcome is told."""
    t = F.col("text")
    hit = lambda p: t.rlike(f"(?i){p}")
    types = C.names_in(t, L.COMPLIANCE_EVIDENCE)
    passed, failed = hit(L.OUTCOME_PASS), hit(L.OUTCOME_FAIL)
    outcome = F.when(passed & failed, "conflicting").when(failed, "fail").when(passed, "pass").when(hit(L.OUTCOME_WAIVER), "waived").otherwise("unknown")
    day = F.regexp_extract(t, r"\b(20\d{2}[-/][01]?\d[-/][0-3]?\d|[01]?\d[-/][0-3]?\d[-/]20\d{2})\b", 1)
    selected = F.when(F.size(types) > 0, types).when(passed | failed, F.array(F.lit("other"))).otherwise(F.array().cast("array<string>"))
    e = _texts(nodes).select("id", *CARRIED, "text", outcome.alias("outcome"), F.when(day != "", day).alias("day"), F.explode(selected).alias("type"))
    return e.select(F.concat_ws("#", "id", "type").alias("evidence_id"), "id", *CARRIED, "type", "outcome", "day", F.col("text").alias("description"), F.when(F.col("type") == "other", 0.7).otherwise(0.9).alias("confidence"))


def workflow_activities(nodes: DataFrame) -> DataFrame:
    """A row for each activity a node names: activity_id, action, phase, object, status, party, evidence, preconditions, approval, confidence.

    The object is what follows the action's word, or the word and `of`, up to a mark or a time word.
    """
    t = F.col("text")

    def activity(name: str, phase: str, weight: float, patterns: list[str]) -> Column:
        hits = sum((t.rlike(f"(?i){p}").cast("int") for p in patterns), F.lit(0))
        first = F.regexp_extract(t, rf"(?i)\b{name}(?:ed|ing|s)?\s+(?:the\s+)?([^.;:]{{3,100}})", 1)
        raw = F.when(first != "", first).otherwise(F.regexp_extract(t, rf"(?i)\b{name}\s+of\s+([^.;:]{{3,100}})", 1))
        obj = F.trim(F.regexp_replace(raw, f"(?i){L.ACTIVITY_OBJECT_ENDS}", ""))
        confidence = clamp(F.lit(weight) + F.least(F.lit(0.03), (hits - 1) * 0.015) + F.when(obj != "", 0.02).otherwise(0.0))
        return F.when(hits > 0, F.struct(F.lit(name).alias("action"), F.lit(phase).alias("phase"), obj.alias("object"), F.round(confidence, 6).alias("confidence")))

    every = F.array_compact(F.array(*(activity(*a) for a in L.WORKFLOW_ACTIVITIES)))
    before = F.array_distinct(C.names_in(t, L.WORKFLOW_PRECONDITIONS))
    a = _texts(nodes).select(
        "id", *CARRIED, T.ladder("text", L.WORKFLOW_STATUS, "unknown").alias("status"), T.ladder("text", L.WORKFLOW_PARTIES).alias("party"), C.names_in(t, L.WORKFLOW_EVIDENCE).alias("evidence"), before.alias("preconditions"),
        F.explode(every).alias("a"),
    )
    return a.select(
        F.concat_ws("#", "id", "a.action").alias("activity_id"), "id", *CARRIED, "a.action", "a.phase", "a.object", "status", "party", "evidence", "preconditions", F.array_contains("preconditions", "approval").alias("approval"), "a.confidence",
    )
