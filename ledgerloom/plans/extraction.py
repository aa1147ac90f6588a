"""Queries of requirement extraction and compliance over the literal corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T
from ..operators import extraction as X
from . import sqltext as S
from .corpus import SECTIONS_SQL, frame, sections, values

SENT = f"(SELECT id, document_id, heading, path, level, unnest(s) AS sentence, unnest(range(len(s)))::INTEGER AS pos FROM (SELECT *, {S.sentences('text')} AS s FROM {SECTIONS_SQL}))"
LIST = lambda c, words: "list_filter([" + ", ".join(f"CASE WHEN contains(lower({c}), {S.q(w)}) THEN {S.q(w)} END" for w in words) + "], lambda x: x IS NOT NULL)"
NK = lambda c: f"trim(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9]+', ' ', 'g'))"
MODAL = "shall not|must not|may not|shall|must|required to|required|may|should|will"
ACTION = f"CASE WHEN regexp_matches(st, '(?i)\\b(?:{MODAL})\\b\\s+(.+)') THEN trim(regexp_replace(trim(regexp_extract(st, '(?i)\\b(?:{MODAL})\\b\\s+(.+)', 1)), '[.;:]+$', '')) ELSE st END"
SUBJ = f"(?i)^(.{{2,100}}?)\\s+\\b(?:{MODAL.replace('required|', '')})\\b"
SUBJECT = f"coalesce(party, CASE WHEN regexp_matches(st, '{SUBJ}') THEN trim(regexp_replace(trim(regexp_extract(st, '{SUBJ}', 1)), '(?i)^(the|a|an)\\s+', '')) END)"
TIMING = "coalesce(" + ", ".join(f"CASE WHEN {S.has('sentence', p)} THEN {S.squeezed('regexp_extract(sentence, ' + S.q('(?i)(' + p + ')') + ', 1)')} END" for p in L.TIMING) + ")"
EXC = f"list_distinct(regexp_extract_all(sentence, {S.q('(?i)' + L.EXCEPTION_CLAUSE)}))"
REFS = "list_distinct(list_filter(list_transform(list_concat(list_concat(" + ", ".join(f"regexp_extract_all(lower(sentence), {S.q(p)})" for p in L.REFERENCES[:2]) + f"), regexp_extract_all(lower(sentence), {S.q(L.REFERENCES[2])})), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: len(x) >= 3))"
WHOLE = "st || ' ' || action || ' ' || array_to_string(dels, ' ')"
REQ = f"""(SELECT *, {S.ladder(NK(WHOLE + " || ' ' || coalesce(heading, '') || ' ' || array_to_string(path, ' ')"), X.PHASES, 'general')} AS phase, {S.ladder(NK(WHOLE), X.CATEGORIES, 'General')} AS category,
  greatest(0, least(100, floor(conf + strength * 0.15 + CASE WHEN party IS NOT NULL THEN 5 ELSE 0 END + CASE WHEN len(dels) > 0 THEN 5 ELSE 0 END + 0.5)))::INTEGER AS confidence,
  list_filter(flatten(list_transform(list_distinct(list_filter(list_concat(list_concat(dels, refs), [action, subject, party]), lambda x: x IS NOT NULL AND x <> '')), lambda x: string_split({NK('x')}, ' '))), lambda x: len(x) >= 4) AS terms
  FROM (SELECT *, {ACTION} AS action, {SUBJECT} AS subject, {S.strength('type')} AS strength FROM (
    SELECT id, document_id, heading, path, pos, id || '#' || pos AS requirement_id, sentence, {S.squeezed('sentence')} AS st, {S.requirement_type('sentence')} AS type, {S.first_of('sentence', L.PARTIES)} AS party,
      {LIST('sentence', L.DELIVERABLES)} AS dels, {TIMING} AS timing, {EXC} AS exc, {REFS} AS refs, {S.confidence('sentence')} AS conf FROM {SENT} WHERE {S.has('sentence', L.REQUIREMENT_NODE)})))"""
MATCH = f"""(WITH r AS (SELECT requirement_id, id, terms, list_filter(list_transform(refs, lambda x: {NK('x')}), lambda x: x <> '') AS refs, list_transform(dels, lambda x: {NK('x')}) AS dels, {S.stem_set('st')} AS rs FROM {REQ}),
  e AS (SELECT id AS evidence_id, {NK("coalesce(heading, '') || ' ' || array_to_string(path, ' ') || ' ' || coalesce(text, '')")} AS n, {S.stem_set("coalesce(heading, '') || ' ' || array_to_string(path, ' ') || ' ' || coalesce(text, '')")} AS es FROM {SECTIONS_SQL}),
  p AS (SELECT requirement_id, evidence_id, CASE WHEN len(terms) = 0 THEN 0.0 ELSE least(1.0, len(list_filter(terms, lambda x: contains(n, x))) / greatest(1, len(terms))::DOUBLE * 0.45 + {S.jaccard('rs', 'es')} * 0.25
    + CASE WHEN len(list_filter(refs, lambda x: contains(n, x))) > 0 THEN 0.25 ELSE 0 END + CASE WHEN len(list_filter(dels, lambda x: contains(n, x))) > 0 THEN 0.25 ELSE 0 END) END AS score FROM r, e WHERE id <> evidence_id)
  SELECT *, row_number() OVER (PARTITION BY requirement_id ORDER BY score DESC, evidence_id)::INTEGER AS rank FROM p WHERE score >= 0.42 QUALIFY rank <= 5)"""
MATRIX = f"""(SELECT r.requirement_id, type, phase, category, coalesce(party, subject, 'Unassigned') AS party,
  CASE WHEN type = 'prohibited' THEN CASE WHEN best IS NULL THEN 'review-required' ELSE 'controlled' END WHEN best IS NULL THEN 'missing-evidence' ELSE 'supported' END AS status,
  CASE WHEN type = 'prohibited' THEN CASE WHEN best IS NULL THEN 'high' ELSE 'medium' END WHEN type = 'mandatory' AND best IS NULL THEN 'high' WHEN type = 'mandatory' THEN 'low' WHEN type = 'advisory' AND best IS NULL THEN 'medium' ELSE 'low' END AS risk,
  coalesce(n, 0) AS n_evidence, confidence FROM {REQ} r LEFT JOIN (SELECT requirement_id, max(score) AS best, count(*) AS n FROM {MATCH} GROUP BY 1) m ON r.requirement_id = m.requirement_id)"""


def reqs(spark):
    return X.requirements(sections(spark))


def requirement_rows(spark, sf):
    return reqs(spark).select(
        "requirement_id", "statement", "type", "strength", "responsible_party", "action", "subject", "timing", "confidence", "phase", "category",
        F.size("deliverables").alias("n_deliverables"), F.size("references").alias("n_references"), F.size("exceptions").alias("n_exceptions"), F.size("evidence_terms").alias("n_terms"))


def matrix(spark):
    r = reqs(spark)
    return X.compliance_matrix(r, X.evidence_matches(r, sections(spark)))


MEANS = r"(?i)^[\"“]?(.{2,80}?)[\"”]?\s+(?:shall mean|means|is defined as|are defined as|refers to)\s+(.+)$"
ANSWERS = [("a1", "The contractor tests first [S1]. Acceptance follows [S2][S9]. Nobody said why."), ("a2", "No sources here."), ("a3", "")]
ANSWER_HITS = [("a1", 1), ("a1", 2), ("a2", 1)]


def citation_check(spark, sf):
    return X.verify_citations(frame(spark, ANSWERS, "answer_id string, answer string"), frame(spark, ANSWER_HITS, "answer_id string, source_number int"))


_CITE_SQL = f"""WITH a AS {values(ANSWERS, 'answer_id string, answer string')}, h AS {values(ANSWER_HITS, 'answer_id string, source_number int')},
  c AS (SELECT answer_id, unnest({S.sentences('answer')}) AS claim FROM a), m AS (SELECT DISTINCT answer_id, unnest(regexp_extract_all(claim, '\\[S(\\d+)\\]', 1))::INTEGER AS n FROM c),
  b AS (SELECT answer_id, count(*) AS invalid FROM m WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.answer_id = m.answer_id AND h.source_number = m.n) GROUP BY 1)
  SELECT answer_id, count(*) AS claims, count(*) FILTER (regexp_matches(claim, '\\[S\\d+\\]')) AS cited_claims, coalesce(any_value(invalid), 0) AS invalid,
    floor(100.0 * count(*) FILTER (regexp_matches(claim, '\\[S\\d+\\]')) / count(*) + 0.5) AS coverage FROM c LEFT JOIN b USING (answer_id) GROUP BY answer_id"""

_SUM = ", ".join(f"count(*) FILTER (type = '{k}') AS {k}" for k in ["mandatory", "prohibited", "permitted", "advisory", "informational"])
_KEEP = "x.s AS sa, y.s AS sb"
_OPPOSE = f"""WITH s AS (SELECT id, document_id, {S.ladder("heading || ' ' || coalesce(text, '')", [('negative', L.NEGATIVE), ('positive', L.POSITIVE)], 'neutral')} AS pol, {S.stem_set("heading || ' ' || coalesce(text, '')")} AS s,
  {S.has("heading || ' ' || coalesce(text, '')", L.EXCEPTION)} AS exc FROM {SECTIONS_SQL}),
  p AS (SELECT x.id AS source_a, y.id AS source_b, len(list_filter(list_intersect(x.s, y.s), lambda w: len(w) >= 4))::INTEGER AS shared, {S.jaccard('x.s', 'y.s')} AS sim, x.pol <> y.pol AS o, x.exc <> y.exc AS d
    FROM s x, s y WHERE x.id < y.id AND x.document_id <> y.document_id AND x.pol <> 'neutral' AND y.pol <> 'neutral')
  SELECT source_a, source_b, greatest(50, least(95, floor(45 + sim * 100 + least(20, shared * 3) + 0.5)))::INTEGER AS confidence, shared FROM p WHERE (shared >= 3 OR sim >= 0.2) AND (o OR d)
  ORDER BY confidence DESC, source_a, source_b LIMIT 6"""

QUERIES = {
    "knowledge_summary": (lambda s, f: X.knowledge_summary(sections(s)), f"""SELECT count(*) AS total_nodes, count(*) FILTER ({S.has('sentence', L.REQUIREMENT_NODE)}) AS requirements, count(*) FILTER ({S.has('sentence', L.ACCEPTANCE_NODE)}) AS acceptance,
      count(*) FILTER ({S.has('sentence', L.EXCEPTION_NODE)}) AS exceptions, count(*) FILTER (len({LIST('sentence', L.DELIVERABLES)}) > 0) AS deliverables, count({S.first_of('sentence', L.PARTIES)}) AS responsible FROM {SENT}"""),
    "requirement_rows": (requirement_rows, f"""SELECT requirement_id, st AS statement, type, strength, party AS responsible_party, action, subject, timing, confidence, phase, category, len(dels)::INTEGER AS n_deliverables,
      len(refs)::INTEGER AS n_references, least(len(exc), 6)::INTEGER AS n_exceptions, len(terms)::INTEGER AS n_terms FROM {REQ}"""),
    "requirements_without_duplicates": (lambda s, f: X.without_fuzzy_duplicates(reqs(s)).select("requirement_id", "statement", "confidence"), None),
    "requirement_summary": (lambda s, f: X.requirement_summary(reqs(s)), f"SELECT count(*) AS total, {_SUM}, count(party) AS with_party, count(*) FILTER (len(dels) > 0) AS with_deliverables, count(timing) AS with_timing, count(*) FILTER (len(exc) > 0) AS with_exceptions FROM {REQ}"),
    "responsibilities_by_party": (lambda s, f: X.by_party(reqs(s)), f"SELECT coalesce(party, subject, 'Unassigned') AS party, count(*) AS n, count(*) FILTER (type = 'mandatory') AS mandatory, count(*) FILTER (type = 'prohibited') AS prohibited, count(DISTINCT document_id) AS documents FROM {REQ} GROUP BY 1"),
    "deliverable_groups": (lambda s, f: X.by_deliverable(reqs(s)), f"SELECT deliverable, {S.ladder('deliverable', L.DELIVERABLE_TYPES, 'deliverable')} AS kind, count(*) AS n, count(DISTINCT document_id) AS documents, count(party) AS assigned FROM (SELECT document_id, party, unnest(dels) AS deliverable FROM {REQ}) GROUP BY ALL"),
    "acceptance_criteria": (lambda s, f: X.sentences_of_kind(sections(s), L.ACCEPTANCE_NODE), f"SELECT id, pos, {S.squeezed('sentence')} AS statement, {S.first_of('sentence', L.PARTIES)} AS responsible_party, {S.confidence('sentence')} AS confidence FROM {SENT} WHERE {S.has('sentence', L.ACCEPTANCE_NODE)}"),
    "exception_sentences": (lambda s, f: X.sentences_of_kind(sections(s), L.EXCEPTION_NODE), f"SELECT id, pos, {S.squeezed('sentence')} AS statement, {S.first_of('sentence', L.PARTIES)} AS responsible_party, {S.confidence('sentence')} AS confidence FROM {SENT} WHERE {S.has('sentence', L.EXCEPTION_NODE)}"),
    "definitions": (lambda s, f: X.definitions(sections(s)), f"""SELECT id, document_id, pos, regexp_replace(trim(regexp_extract(st, {S.q(MEANS)}, 1)), '(?i)^(the|a|an)\\s+', '') AS term,
      regexp_replace(trim(regexp_extract(st, {S.q(MEANS)}, 2)), '[.;]+$', '') AS meaning FROM (SELECT *, {S.squeezed('sentence')} AS st FROM {SENT}) WHERE regexp_matches(st, {S.q(MEANS)})"""),
    "evidence_matches": (lambda s, f: X.evidence_matches(reqs(s), sections(s)).withColumn("score", F.round("score", 6)), f"SELECT requirement_id, evidence_id, round(score, 6) AS score, rank FROM {MATCH}"),
    "compliance_matrix": (lambda s, f: matrix(s), f"SELECT * FROM {MATRIX}"),
    "compliance_rollup": (lambda s, f: X.compliance_rollup(matrix(s)), f"""WITH m AS {MATRIX}, u AS (SELECT 'type' AS dimension, type AS value, status FROM m UNION ALL SELECT 'phase', phase, status FROM m UNION ALL SELECT 'status', status, status FROM m UNION ALL SELECT 'risk', risk, status FROM m UNION ALL SELECT 'all', 'all', status FROM m)
      SELECT dimension, value, count(*) AS n, count(*) FILTER (status IN ('supported', 'controlled')) AS supported, floor(100.0 * count(*) FILTER (status IN ('supported', 'controlled')) / count(*) + 0.5) AS percent FROM u GROUP BY ALL"""),
    "checklist": (lambda s, f: X.checklist(reqs(s)), f"SELECT category, row_number() OVER (PARTITION BY category ORDER BY strength DESC, requirement_id)::INTEGER AS item, requirement_id, st AS statement, {S.ladder(NK(chr(97) + 'rray_to_string(dels, ' + S.q(' ') + ')'), X.EVIDENCE_TYPES, 'Record')} AS expected_evidence FROM {REQ}"),
    "commissioning_checklist": (lambda s, f: X.checklist(reqs(s), ["testing", "acceptance", "inspection"]).select("category", "item", "requirement_id"), f"SELECT category, row_number() OVER (PARTITION BY category ORDER BY strength DESC, requirement_id)::INTEGER AS item, requirement_id FROM {REQ} WHERE phase IN ('testing', 'acceptance', 'inspection')"),
    "owner_qc_matrix": (lambda s, f: X.owner_actions(reqs(s)), f"SELECT {S.ladder('st', X.OWNER_ACTIONS, 'monitor')} AS owner_action, type, count(*) AS n, min(requirement_id) AS first_requirement FROM {REQ} GROUP BY ALL"),
    "opposing_sources": (lambda s, f: X.opposing_sources(sections(s)), _OPPOSE),
    "source_agreement": (lambda s, f: X.source_agreement(sections(s), 6), f"""WITH s AS (SELECT id, document_id, {S.stem_set('text')} AS s FROM {SECTIONS_SQL}), p AS (SELECT x.id AS a, y.id AS b, {S.jaccard('x.s', 'y.s')} AS similarity FROM s x, s y WHERE x.id < y.id AND x.document_id <> y.document_id)
      SELECT a, b, round(similarity, 6) AS similarity, CASE WHEN similarity >= 0.28 THEN 'agree' ELSE 'differ' END AS verdict FROM p WHERE similarity >= 0.08"""),
    "requirement_graph_edges": (lambda s, f: X.requirement_graph(reqs(s))[1], f"SELECT DISTINCT requirement_id AS source, 'party:' || party AS target, 'assigned_to' AS kind FROM {REQ} WHERE party IS NOT NULL UNION SELECT requirement_id, 'deliverable:' || unnest(dels), 'produces' FROM {REQ} UNION SELECT requirement_id, 'reference:' || unnest(refs), 'cites' FROM {REQ}"),
    "citation_check": (citation_check, _CITE_SQL),
    "first_requirements": (lambda s, f: X.first_matches(reqs(s), 6).select("requirement_id", "strength"), f"SELECT requirement_id, strength FROM (SELECT * FROM {REQ} QUALIFY row_number() OVER (PARTITION BY {NK('st')} ORDER BY document_id, id, pos) = 1 ORDER BY document_id, id, pos LIMIT 6)"),
}
