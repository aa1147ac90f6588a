"""Sentences to requirements, responsibilities, deliverables, definitions, evidence and compliance tables.

A hit is a section with source_number, document_id, heading, path, level and text.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T
from .graph import _counted, _settled
from .pairs import FREQUENT, found_in, hashed, similar_sets, with_common_words

# Phases, checklist categories, evidence types and owner actions, first match wins.
PHASES = [
    ("preconstruction", r"\b(preconstruction|pre construction|before work|prior to work|notice to proceed|kickoff|mobilization)\b"),
    ("submittal", r"\b(submittal|shop drawing|product data|sample|mockup|approval)\b"),
    ("installation", r"\b(install|installation|construct|construction|execute work|perform work)\b"),
    ("inspection", r"\b(inspect|inspection|verify|verification|quality control|quality assurance|qc|qa)\b"),
    ("testing", r"\b(test|testing|commission|commissioning|functional performance|startup|start up|demonstration)\b"),
    ("acceptance", r"\b(acceptance|accepted|approve|approval|turnover|substantial completion)\b"),
    ("closeout", r"\b(closeout|warranty|record drawing|as built|operation manual|maintenance manual|training|final completion)\b"),
]
CATEGORIES = [
    ("Submittals", r"\b(submittal|shop drawing|product data|sample|mockup)\b"),
    ("Readiness and Safety", r"\b(icra|pcra|infection control|safety plan|hazard|permit)\b"),
    ("Inspection", r"\b(inspect|inspection|verify|verification|qc|qa|quality control|quality assurance)\b"),
    ("Testing and Commissioning", r"\b(test|testing|commission|commissioning|startup|functional performance)\b"),
    ("Documentation", r"\b(photo|photograph|record|report|certificate|documentation)\b"),
    ("Deficiencies", r"\b(punch|deficien|corrective|nonconform|non conform)\b"),
    ("Closeout", r"\b(closeout|warranty|training|record drawing|as built|operation manual|maintenance manual)\b"),
    ("Acceptance", r"\b(accept|acceptance|approved|approval)\b"),
]
EVIDENCE_TYPES = [
    ("Report", r"\b(report)\b"), ("Photograph", r"\b(photo|photograph)\b"), ("Certificate", r"\b(certificate|certification)\b"), ("Schedule", r"\b(schedule)\b"),
    ("Approved Submittal", r"\b(submittal|shop drawing|product data|sample)\b"), ("Record Drawing", r"\b(record drawing|as built)\b"), ("Warranty", r"\b(warranty)\b"), ("Training Record", r"\b(training)\b"),
]
OWNER_ACTIONS = [
    ("approve", r"\b(approve|approval|accept|acceptance)\b"), ("witness", r"\b(witness|observe|attend)\b"), ("inspect", r"\b(inspect|inspection|verify|verification)\b"),
    ("review", r"\b(review|submittal|shop drawing)\b"), ("receive", r"\b(deliver|submit|provide|turnover)\b"),
]
EVIDENCE_AT, EVIDENCE_MOST = 0.42, 5
#: Texts that may hold a term or stem before it is common: pairs are made of what is rarer, classes of what is common.
RARE = 64


def sentence_rows(hits: DataFrame) -> DataFrame:
    """One row per sentence of every hit, with its position."""
    s = hits.select("id", "document_id", "heading", "path", "level", F.posexplode(T.sentences("text")).alias("pos", "sentence"))
    return s.withColumn("responsible_party", T.party("sentence")).withColumn("deliverables", T.deliverables("sentence"))


def knowledge_summary(hits: DataFrame) -> DataFrame:
    """Counts of sentences by kind."""
    s = sentence_rows(hits)
    n = lambda c: F.count_if(c)
    return s.agg(
        F.count("*").alias("total_nodes"), n(T.matches("sentence", L.REQUIREMENT_NODE)).alias("requirements"), n(T.matches("sentence", L.ACCEPTANCE_NODE)).alias("acceptance"),
        n(T.matches("sentence", L.EXCEPTION_NODE)).alias("exceptions"), n(F.size("deliverables") > 0).alias("deliverables"), n(F.col("responsible_party").isNotNull()).alias("responsible"),
    )


def requirements(hits: DataFrame) -> DataFrame:
    """One row per requirement sentence with all its fields, before duplicates go."""
    s = sentence_rows(hits).where(T.matches("sentence", L.REQUIREMENT_NODE))
    statement = T.squeezed("sentence")
    kind = T.requirement_type("sentence")
    s = s.withColumns({"statement": statement, "type": kind, "strength": T.requirement_strength(kind), "references": T.references("sentence")})
    s = s.withColumns({"action": T.action("sentence"), "subject": T.subject("sentence", F.col("responsible_party")), "timing": T.timing("sentence"), "conditions": T.conditions("sentence"), "exceptions": T.exceptions("sentence")})
    more = F.when(F.col("responsible_party").isNotNull(), 5).otherwise(0) + F.when(F.size("deliverables") > 0, 5).otherwise(0)
    confidence = F.least(F.lit(100), F.greatest(F.lit(0), T.rounded(T.sentence_confidence("sentence") + F.col("strength") * 0.15 + more))).cast("int")
    terms = F.array_distinct(F.filter(F.concat("deliverables", "references", F.array("action", "subject", "responsible_party")), lambda x: x.isNotNull() & (x != "")))
    terms = F.filter(F.flatten(F.transform(terms, lambda x: F.split(T.normalized_key(x), " "))), lambda x: F.length(x) >= 4)
    whole = F.concat_ws(" ", "statement", "action", F.array_join("deliverables", " "))
    about = T.normalized_key(F.concat_ws(" ", whole, "heading", F.array_join("path", " ")))
    s = s.withColumns({"confidence": confidence, "evidence_terms": terms, "phase": T.ladder(about, PHASES, "general"), "category": T.ladder(T.normalized_key(whole), CATEGORIES, "General")})
    return s.withColumn("requirement_id", F.concat_ws("#", "id", "pos")).drop("sentence")


def without_fuzzy_duplicates(reqs: DataFrame, scope: str = "document_id") -> DataFrame:
    """Per scope, in the order of (id, pos): of statements alike by 0.88, or 0.72 under the same heading, the more confident stays.

    Order decides, so each scope is one pandas group; scopes are documents.
    """
    stem = re.compile(f"({'|'.join(L.STEM_ENDINGS)})$")

    def words(s: str) -> frozenset:
        return frozenset(stem.sub("", t, count=1) for t in re.findall(L.TOKEN, s.lower()) if len(t) > 1 and t not in L.STOP_WORDS)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["id", "pos"], kind="stable").reset_index(drop=True)
        kept: list[list] = []  # [place in the result, words, heading, confidence]
        for i, r in rows.iterrows():
            w, h = words(r["statement"]), re.sub("[^a-z0-9]+", " ", (r["heading"] or "").lower()).strip()
            for k in kept:
                alike = len(w & k[1]) / len(w | k[1]) if w and k[1] else 0.0
                if alike >= 0.88 or (alike >= 0.72 and h == k[2]):
                    if r["confidence"] > k[3]:
                        k[:] = [i, w, h, r["confidence"]]
                    break
            else:
                kept.append([i, w, h, r["confidence"]])
        return rows.loc[[k[0] for k in kept]]

    return reqs.groupBy(scope).applyInPandas(run, reqs.schema)


def requirement_summary(reqs: DataFrame) -> DataFrame:
    kinds = ["mandatory", "prohibited", "permitted", "advisory", "informational"]
    return reqs.agg(
        F.count("*").alias("total"), *(F.count_if(F.col("type") == k).alias(k) for k in kinds), F.count_if(F.col("responsible_party").isNotNull()).alias("with_party"),
        F.count_if(F.size("deliverables") > 0).alias("with_deliverables"), F.count_if(F.col("timing").isNotNull()).alias("with_timing"), F.count_if(F.size("exceptions") > 0).alias("with_exceptions"),
    )


def by_party(reqs: DataFrame) -> DataFrame:
    who = F.coalesce("responsible_party", "subject", F.lit("Unassigned"))
    return reqs.groupBy(who.alias("party")).agg(
        F.count("*").alias("n"), F.count_if(F.col("type") == "mandatory").alias("mandatory"), F.count_if(F.col("type") == "prohibited").alias("prohibited"), F.count_distinct("document_id").alias("documents"))


def by_deliverable(reqs: DataFrame) -> DataFrame:
    d = reqs.select("document_id", "responsible_party", F.explode("deliverables").alias("deliverable"))
    return d.groupBy("deliverable", T.deliverable_type("deliverable").alias("kind")).agg(F.count("*").alias("n"), F.count_distinct("document_id").alias("documents"), F.count("responsible_party").alias("assigned"))


def sentences_of_kind(hits: DataFrame, pattern: str) -> DataFrame:
    """Acceptance criteria, exceptions: the sentences that a pattern finds."""
    s = sentence_rows(hits).where(T.matches("sentence", pattern))
    return s.select("id", "pos", T.squeezed("sentence").alias("statement"), "responsible_party", T.sentence_confidence("sentence").alias("confidence"))


def definitions(hits: DataFrame) -> DataFrame:
    """(id, pos, term, meaning) of sentences that say what a term means."""
    s = sentence_rows(hits)
    p = r"(?i)^[\"“]?(.{2,80}?)[\"”]?\s+(?:shall mean|means|is defined as|are defined as|refers to)\s+(.+)$"
    x = T.squeezed("sentence")
    term = F.regexp_replace(F.trim(F.regexp_extract(x, p, 1)), r"(?i)^(the|a|an)\s+", "")
    return s.where(x.rlike(p)).select("id", "document_id", "pos", term.alias("term"), F.regexp_replace(F.trim(F.regexp_extract(x, p, 2)), r"[.;]+$", "").alias("meaning"))


def _evidence_score(p: DataFrame) -> DataFrame:
    """Pairs of requirement and evidence columns with their score."""
    found = F.size(F.filter("evidence_terms", lambda x: F.col("n").contains(x))) / F.greatest(F.lit(1), F.size("evidence_terms"))
    some = lambda c: F.when(F.exists(c, lambda x: F.col("n").contains(x)), 0.25).otherwise(0.0)
    score = F.when(F.size("evidence_terms") == 0, 0.0).otherwise(F.least(F.lit(1.0), found * 0.45 + T.jaccard(F.col("rs"), F.col("es")) * 0.25 + some("refs") + some("dels")))
    return p.withColumn("score", score)


def _evidence_sides(reqs: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    whole = F.concat_ws(" ", "heading", F.array_join("path", " "), "text")
    e = evidence.select(F.col("id").alias("evidence_id"), T.normalized_key(whole).alias("n"), T.stem_set(whole).alias("es"))
    words = lambda c: F.filter(F.transform(F.col(c), lambda x: T.normalized_key(x)), lambda x: x != "")
    return reqs.select("requirement_id", F.col("id").alias("own"), "evidence_terms", words("references").alias("refs"), words("deliverables").alias("dels"), T.stem_set("statement").alias("rs")), e


def evidence_matches(reqs: DataFrame, evidence: DataFrame, at: float = EVIDENCE_AT, most: int = EVIDENCE_MOST) -> DataFrame:
    """(requirement_id, evidence_id, score, rank): the best evidence sections of each requirement.

    Score: 0.45 of the share of its terms found, 0.25 of the word similarity,
    0.25 for a reference and for a deliverable found.  Beyond 0.25 one of these
    must be found as a part of the evidence's text, whatever its length, which
    pairs.found_in tells without a cross join.  Pairs are scored that share what is
    rare (in RARE texts at most), and the best by what is common.
    """
    if at <= 0.25:
        raise ValueError("a threshold of 0.25 or less can be met without a term found")
    r, e = _evidence_sides(reqs, evidence)
    r, e = _settled(r.where("size(evidence_terms) > 0")), _settled(e)
    terms = r.select("requirement_id", F.explode(F.array_distinct(F.concat("evidence_terms", "refs", "dels"))).alias("x"))
    hits = found_in(terms.select(F.col("x").alias("term")), e.select(F.col("evidence_id").alias("id"), "n")).select(F.lit(False).alias("stem"), F.col("term").alias("x"), F.col("id").alias("evidence_id"))
    held = _settled(hits.unionByName(e.select(F.lit(True).alias("stem"), F.explode("es").alias("x"), "evidence_id")))
    common, n = _counted(held.groupBy("stem", "x").agg(F.count("*").alias("m")).where(F.col("m") > RARE).select("stem", "x"))
    common = F.broadcast(common) if n <= FREQUENT else common
    asked = terms.select(F.lit(False).alias("stem"), "x", "requirement_id").unionByName(r.select(F.lit(True).alias("stem"), F.explode("rs").alias("x"), "requirement_id"))
    few = asked.join(held.join(common, ["stem", "x"], "left_anti"), ["stem", "x"]).select("requirement_id", "evidence_id")
    many = _class_matches(r, e, held, common, at, most + 1)  # one of them may be a requirement's own
    pairs = few.unionByName(many).distinct().join(r, "requirement_id").where("own <> evidence_id")
    p = _evidence_score(pairs.join(e, "evidence_id")).where(F.col("score") >= at)
    w = Window.partitionBy("requirement_id").orderBy(F.desc("score"), "evidence_id")
    return p.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("requirement_id", "evidence_id", "score", "rank")


def _class_matches(r: DataFrame, e: DataFrame, held: DataFrame, common: DataFrame, at: float, most: int) -> DataFrame:
    """(requirement_id, evidence_id): the `most` best of each requirement by common terms and stems alone, the first of equal ones.

    Requirements alike in these and in their sizes are a class, and so is evidence; classes are scored,
    and of each the first rows by id stand for all.  What is rare can only raise a score, so that
    whatever else is among a requirement's best shares something rare with it.
    """
    key = lambda *cs: F.struct(F.xxhash64(*cs).alias("h"), F.xxhash64(F.lit(1), *cs).alias("g"))
    kinds = [("t", False, "evidence_terms"), ("r", False, "refs"), ("d", False, "dels"), ("s", True, "rs")]
    tagged = lambda k, stem, c: F.transform(c, lambda x: F.struct(F.lit(stem).alias("stem"), F.lit(k).alias("kind"), x.alias("x")))
    of = F.concat(*(tagged(*k) for k in kinds))
    flat = lambda k: F.transform(F.filter("f", lambda s: s["kind"] == k), lambda s: s["x"])
    rf = r.select("requirement_id", F.explode(of).alias("o")).select("requirement_id", "o.*").join(common, ["stem", "x"], "left_semi").groupBy("requirement_id").agg(F.array_sort(F.collect_list(F.struct("kind", "x"))).alias("f"))
    rc = r.select("requirement_id", F.size("evidence_terms").alias("nt"), F.size("rs").alias("ns")).join(rf, "requirement_id").withColumn("rk", key("f", "nt", "ns"))
    rc = _settled(rc)
    rcl = rc.groupBy("rk").agg(F.first("f").alias("f"), F.first("nt").alias("nt"), F.first("ns").alias("ns")).select("rk", "nt", "ns", *(flat(k).alias(k) for k, _, _ in kinds))
    ef = held.join(common, ["stem", "x"], "left_semi").groupBy("evidence_id").agg(F.array_sort(F.collect_set(F.struct("stem", "x"))).alias("f"))
    ec = e.select("evidence_id", F.size("es").alias("ms")).join(ef, "evidence_id").withColumn("ek", key("f", "ms"))
    first = Window.partitionBy("ek").orderBy("evidence_id")
    ec = ec.withColumn("place", F.row_number().over(first)).where(F.col("place") <= most)
    told = lambda st: F.transform(F.filter("f", lambda s: s["stem"] == st), lambda s: s["x"])
    ecl = ec.groupBy("ek").agg(F.first("f").alias("f"), F.first("ms").alias("ms"), F.collect_list("evidence_id").alias("firsts")).select("ms", "firsts", told(False).alias("et"), told(True).alias("es"))
    named = F.array_distinct(F.concat("t", "r", "d"))
    met = _settled(rcl).withColumn("named", named).select("*", F.explode("named").alias("x")).join(_settled(ecl).select("*", F.explode("et").alias("x")), "x")
    met = met.where(F.element_at(F.array_intersect("named", "et"), 1) == F.col("x"))  # a pair counts at the first term that both have
    some = lambda c: F.when(F.arrays_overlap(c, "et"), 0.25).otherwise(0.0)
    n = F.size(F.array_intersect("s", "es"))
    alike = F.when((F.col("ns") == 0) | (F.col("ms") == 0), 0.0).otherwise(n / (F.col("ns") + F.col("ms") - n))
    found = F.size(F.filter("t", lambda x: F.array_contains("et", x))) / F.greatest(F.lit(1), F.col("nt"))
    met = met.withColumn("score", F.least(F.lit(1.0), found * 0.45 + alike * 0.25 + some("r") + some("d"))).where(F.col("score") >= at)
    best = Window.partitionBy("rk").orderBy(F.desc("score"), "evidence_id")
    best = met.select("rk", "score", F.explode("firsts").alias("evidence_id")).withColumn("place", F.row_number().over(best)).where(F.col("place") <= most)
    return rc.select("requirement_id", "rk").join(best.select("rk", "evidence_id"), "rk").select("requirement_id", "evidence_id")


def compliance_matrix(reqs: DataFrame, matches: DataFrame) -> DataFrame:
    """Requirements with status and risk by whether evidence supports them."""
    best = matches.groupBy("requirement_id").agg(F.max("score").alias("best"), F.count("*").alias("n_evidence"))
    m = reqs.join(best, "requirement_id", "left")
    ok = F.col("best").isNotNull()
    kind = F.col("type")
    status = F.when(kind == "prohibited", F.when(ok, "controlled").otherwise("review-required")).when(ok, "supported").otherwise("missing-evidence")
    risk = (F.when(kind == "prohibited", F.when(ok, "medium").otherwise("high")).when((kind == "mandatory") & ~ok, "high").when(kind == "mandatory", "low").when((kind == "advisory") & ~ok, "medium").otherwise("low"))
    who = F.coalesce("responsible_party", "subject", F.lit("Unassigned"))
    return m.select("requirement_id", "type", "phase", "category", who.alias("party"), status.alias("status"), risk.alias("risk"), F.coalesce("n_evidence", F.lit(0)).alias("n_evidence"), "confidence")


def compliance_rollup(matrix: DataFrame) -> DataFrame:
    """Counts and supported percentage by type, phase, status and risk in one pass, and in total."""
    ok = F.count_if(F.col("status").isin("supported", "controlled"))
    g = matrix.groupingSets([["type"], ["phase"], ["status"], ["risk"], []], "type", "phase", "status", "risk").agg(
        F.count("*").alias("n"), ok.alias("supported"), F.grouping_id().alias("gid"))
    dim = F.when(F.col("gid") == 7, "type").when(F.col("gid") == 11, "phase").when(F.col("gid") == 13, "status").when(F.col("gid") == 14, "risk").otherwise("all")
    return g.select(dim.alias("dimension"), F.coalesce("type", "phase", "status", "risk", F.lit("all")).alias("value"), "n", "supported", T.rounded(100.0 * F.col("supported") / F.col("n")).alias("percent"))


def checklist(reqs: DataFrame, phases: list[str] | None = None) -> DataFrame:
    """Items by category: the requirements of some phases, numbered within their category."""
    r = reqs.where(F.col("phase").isin(phases)) if phases else reqs
    w = Window.partitionBy("category").orderBy(F.desc("strength"), "requirement_id")
    evidence = T.ladder(T.normalized_key(F.array_join("deliverables", " ")), EVIDENCE_TYPES, "Record")
    return r.select("category", F.row_number().over(w).alias("item"), "requirement_id", "statement", evidence.alias("expected_evidence"))


def owner_actions(reqs: DataFrame) -> DataFrame:
    """What the owner's quality control has to do, counted by action and type."""
    a = T.ladder("statement", OWNER_ACTIONS, "monitor")
    return reqs.groupBy(a.alias("owner_action"), "type").agg(F.count("*").alias("n"), F.min("requirement_id").alias("first_requirement"))


def opposing_sources(hits: DataFrame, most: int = 6) -> DataFrame:
    """Pairs of sections of different documents on common matter that say opposite things, the surest first.

    Matter in common is three shared long stems or a similarity of 0.2.  Sections
    of a document with equal stems, but for those that no other section has, and
    equal in what else is asked of them, are alike to every other one: a pair among
    the first `most` has none but the first `most` of them, so the others go.
    """
    both = F.concat_ws(" ", "heading", "text")
    s = hits.select("id", "document_id", T.polarity(both).alias("pol"), T.stem_set(both).alias("s"), T.matches(both, L.EXCEPTION).alias("exc")).where("pol <> 'neutral'")
    s = with_common_words(s, F.col("s"))
    s = s.withColumn("long", F.array_intersect(hashed(F.filter("s", lambda w: F.length(w) >= 4)), "common"))
    alike = Window.partitionBy("document_id", "pol", "exc", "n", "common", "long").orderBy("id")
    s = _settled(s.withColumn("place", F.row_number().over(alike)).where(F.col("place") <= most).drop("place"))
    against = (F.col("a_id") < F.col("b_id")) & (F.col("a_document_id") != F.col("b_document_id")) & ((F.col("a_pol") != F.col("b_pol")) | (F.col("a_exc") != F.col("b_exc")))
    shared = F.size(F.array_intersect("a_long", "b_long"))
    alike = F.size(F.array_intersect("a_common", "b_common"))
    conf = F.greatest(F.lit(50), F.least(F.lit(95), T.rounded(45 + F.col("similarity") * 100 + F.least(F.lit(20), F.col("shared") * 3)))).cast("int")
    how = {"keep": ("document_id", "pol", "exc", "n", "common", "long"), "apart": against, "either": True}
    how["also"] = {"shared": shared, "similarity": alike / (F.col("a_n") + F.col("b_n") - alike), "confidence": conf}
    near = similar_sets(s, F.col("s"), 0.2, **how)
    far = similar_sets(s, F.filter("s", lambda w: F.length(w) >= 4), None, 3, **how)
    order = (F.desc("confidence"), "source_a", "source_b")
    found = near.unionByName(far).select(F.col("a_id").alias("source_a"), F.col("b_id").alias("source_b"), "confidence", "shared").orderBy(*order)
    return found.limit(2 * most).distinct().orderBy(*order).limit(most)  # either way finds a pair once


def source_agreement(hits: DataFrame, digits: int | None = None) -> DataFrame:
    """Pairs of sections of different documents that agree (similarity 0.28 or more) or differ (0.08 or more); the similarity to so many digits, if given."""
    apart = (F.col("a_id") < F.col("b_id")) & (F.col("a_document_id") != F.col("b_document_id"))
    also = {"verdict": F.when(F.col("similarity") >= 0.28, "agree").otherwise("differ")} | ({} if digits is None else {"similarity": F.round("similarity", digits)})
    p = similar_sets(hits.select("id", "document_id", "text"), T.stem_set("text"), 0.08, keep=("document_id",), apart=apart, also=also, either=True)
    return p.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), "similarity", "verdict")


def requirement_graph(reqs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): requirements, parties, deliverables and references, and what ties them."""
    req = reqs.select(F.col("requirement_id").alias("source"), "responsible_party", "deliverables", "references")
    edges = (
        req.where("responsible_party is not null").select("source", F.concat(F.lit("party:"), "responsible_party").alias("target"), F.lit("assigned_to").alias("kind"))
        .unionByName(req.select("source", F.explode("deliverables").alias("t")).select("source", F.concat(F.lit("deliverable:"), "t").alias("target"), F.lit("produces").alias("kind")))
        .unionByName(req.select("source", F.explode("references").alias("t")).select("source", F.concat(F.lit("reference:"), "t").alias("target"), F.lit("cites").alias("kind")))
    ).distinct()
    nodes = edges.select(F.col("target").alias("node")).unionByName(req.select(F.col("source").alias("node"))).distinct()
    return nodes, edges


def verify_citations(claims: DataFrame, hits: DataFrame) -> DataFrame:
    """Per answer: claims, cited ones, citations of sources that don't exist, and coverage in percent.

    claims has answer_id and answer; hits has answer_id and source_number.
    """
    c = claims.select("answer_id", F.posexplode(T.sentences("answer")).alias("pos", "claim")).withColumn("cited", T.citations("claim"))
    per = c.groupBy("answer_id").agg(F.count("*").alias("claims"), F.count_if(F.size("cited") > 0).alias("cited_claims"))
    marks = c.select("answer_id", F.explode("cited").alias("source_number")).distinct()
    bad = marks.join(hits.select("answer_id", "source_number").distinct(), ["answer_id", "source_number"], "left_anti").groupBy("answer_id").agg(F.count("*").alias("invalid"))
    out = per.join(bad, "answer_id", "left")
    return out.select("answer_id", "claims", "cited_claims", F.coalesce("invalid", F.lit(0)).alias("invalid"), T.rounded(100.0 * F.col("cited_claims") / F.col("claims")).alias("coverage"))


def answer_score(facts: Column, cited: Column, has_section: Column, has_document: Column, complete: Column, penalties: Column) -> Column:
    """0 to 100: 50 for facts, 21 for citations, 12 for section and document each, 5 for completeness, less penalties."""
    s = facts * 50 + cited * 21 + has_section.cast("int") * 12 + has_document.cast("int") * 12 + complete.cast("int") * 5 - penalties
    return F.greatest(F.lit(0), F.least(F.lit(100), T.rounded(s))).cast("int")


def first_matches(reqs: DataFrame, limit: int) -> DataFrame:
    """The first distinct statements in scan order up to a limit, then by strength and document."""
    w = Window.partitionBy(T.normalized_key("statement")).orderBy("document_id", "id", "pos")
    once = reqs.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return once.orderBy("document_id", "id", "pos").limit(limit).orderBy(F.desc("strength"), "document_id", "id", "pos")
