"""Queries of what is read from texts: clauses with spans, statements, criteria, requirements, evidence and activities, and the findings they lead to."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clauses as C
from ..functions import lexicons as L
from ..functions import text as T
from ..operators import analysis as A
from ..operators import compliance as CO
from ..operators import statements as S
from ..operators import workflow as W
from ..operators.graph import task_count
from . import rules, sqltext as Q
from .corpus import SECTIONS_SQL, sections, values


def prose(left: str, right: str) -> C.Grammar:
    """A grammar for the invented prose of `documents`, in four languages: determiners with a noun act, copulas link, small words open a condition.

    left and right are the word boundaries, ASCII ones in either engine.
    """
    word = lambda *ws: left + "(?:" + "|".join(ws) + ")" + right
    noun = lambda *ws: word(*ws) + r"\s+[a-z]+"
    links = ("for", "with", "from", "when", "mit", "bei", "pour", "avec", "para", "con")
    return C.Grammar(
        actors=[("the", noun("the")), ("this", noun("this")), ("that", noun("that")), ("der", noun("der", "die", "das")), ("le", noun("le", "la", "les")), ("el", noun("el", "los", "las"))],
        actions=[("is", word("is", "ist", "est", "es")), ("are", word("are", "sind", "sont", "son")), ("was", word("was", "war", "fue"))],
        modal=word("and", "und", "et", "y"), negation=word("not", "nicht", "pas", "no"), exclusive=word("only", "nur", "solo"), binding=word("is", "was", "are"),
        qualifier=word(*links), condition=word(*links) + r"[^.;:\n]*", window=60,
    )


PROSE, PROSE_SQL = prose("(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"), prose(r"\b", r"\b")


def section_nodes(s) -> DataFrame:
    """All sections, dealt to all tasks: reading one takes milliseconds, and a file with few row groups has few tasks."""
    n = sections(s).select("id", F.col("document_id").alias("document"), F.col("section_number").alias("section"), "heading", "text")
    return n.repartition(task_count(n), "id")


def document_nodes(s, f: str) -> DataFrame:
    """All documents by sentence."""
    d = s.read.parquet(f"{f}/documents.parquet")
    return S.sentence_nodes(d.select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("document"), F.col("lang").alias("section"), "text"))


NODES_SQL = f"(SELECT id, coalesce(document_id, '') AS document, coalesce(section_number, '') AS section, {Q.squeezed("array_to_string(list_filter([heading, text], lambda x: x <> ''), '. ')")} AS text FROM {SECTIONS_SQL})"
DOCUMENTS_SQL = f"""(SELECT concat_ws('#', id, pos) AS id, document, section, {Q.squeezed('s')} AS text
  FROM (SELECT doc_id::VARCHAR AS id, coalesce(source, '') AS document, coalesce(lang, '') AS section, unnest({Q.sentences('text')}) AS s, generate_subscripts({Q.sentences('text')}, 1) - 1 AS pos FROM documents))"""


# --- SQL of the clause grammar ---------------------------------------------------------------------

def spans_sql(c: str, pattern: str) -> str:
    """A list of {s, e}: where the matches of a pattern begin and end."""
    p = Q.q(f"(?i)(?:{pattern})")
    found, pieces = f"regexp_extract_all({c}, {p})", f"string_split_regex({c}, {p})"
    return f"""list_transform(range(1, len({found}) + 1), lambda i: {{'s': (list_sum(list_transform({pieces}[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform({found}[1:i - 1], lambda x: length(x))), 0))::INTEGER,
      'e': (list_sum(list_transform({pieces}[1:i], lambda x: length(x))) + list_sum(list_transform({found}[1:i], lambda x: length(x))))::INTEGER, 't': {found}[i]}})"""


def names_sql(c: str, patterns) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {Q.has(c, p)} THEN {Q.q(n)} END" for n, p in patterns) + "], lambda x: x IS NOT NULL)"


def clauses_sql(nodes: str, g: C.Grammar) -> str:
    """CTEs up to c: a row for each clause with the columns of clause_columns()."""
    last = lambda of: f"list_filter({of}, lambda x: x.e <= a.s AND x.s >= a.s - {g.window})[-1]"
    first = lambda of, at: f"list_filter({of}, lambda x: x.s >= {at})[1]"
    action = "CASE " + " ".join(f"WHEN {Q.has('a.t', p)} THEN {Q.q(n)}" for n, p in g.actions) + f" ELSE '{g.other}' END"
    return f"""n AS (SELECT * FROM {nodes} WHERE text <> ''),
m AS MATERIALIZED (SELECT *, length(text)::INTEGER AS size, {spans_sql('text', C.any_of([p for _, p in g.actions]))} AS acts, {spans_sql('text', C.any_of([p for _, p in g.actors]))} AS who, {spans_sql('text', g.modal)} AS modals,
  {spans_sql('text', g.condition)} AS conds, {spans_sql('text', '[.;:' + chr(92) + 'n]|' + g.qualifier)} AS stops, {names_sql('text', g.actors)} AS named, {Q.has('text', g.binding)} AS bound, {Q.has('text', g.exclusive)} AS exclusive FROM n),
u AS (SELECT *, unnest(acts) AS a, generate_subscripts(acts, 1) - 1 AS pos FROM m),
v AS (SELECT *, substr(text, greatest(a.s - {g.window}, 0) + 1, least(a.s, {g.window})) AS before, coalesce(({first('stops', 'a.e')}).s, size) AS object_end FROM u),
w AS (SELECT *, {names_sql('before', g.actors)} AS near, trim(regexp_replace(regexp_replace(regexp_replace(substr(text, a.e + 1, object_end - a.e), '^[\\s,:-]+', ''), {Q.q('(?is)^(.*?)' + g.leading)}, '\\1'), '\\s+', ' ', 'g')) AS object FROM v),
c AS (SELECT id, document, section, pos::INTEGER AS pos, {action} AS action, a.s AS start, a.e AS finish, ({last('who')}).s AS actor_at, ({last('who')}).t AS actor, ({last('modals')}).t AS modal, ({first('conds', 'a.s')}).s AS condition_at, ({first('conds', 'a.s')}).t AS condition,
    object, object_end, CASE WHEN len(near) > 0 THEN near ELSE named END AS actors, {Q.has('before', g.negation)} AS negated, exclusive,
    round(0.5 + CASE WHEN len(CASE WHEN len(near) > 0 THEN near ELSE named END) > 0 THEN 0.3 ELSE 0 END + CASE WHEN length(object) > 2 THEN 0.15 ELSE 0 END + CASE WHEN bound THEN 0.05 ELSE 0 END, 6)::DOUBLE AS confidence FROM w
  UNION ALL SELECT id, document, section, 0, '{g.other}', size, size, NULL, NULL, NULL, NULL, NULL, '', size, named, {Q.has('text', g.negation)}, exclusive, 0.45 FROM m WHERE len(acts) = 0 AND len(named) > 0)"""


def flat(c: DataFrame) -> DataFrame:
    return c.select(
        "id", "document", "section", "pos", "action", F.col("span.start").alias("start"), F.col("span.end").alias("finish"), F.col("actor.start").alias("actor_at"), F.col("actor.text").alias("actor"), F.col("modal.text").alias("modal"),
        F.col("condition.start").alias("condition_at"), F.col("condition.text").alias("condition"), "object", "object_end", "actors", "negated", "exclusive", "confidence",
    )


def section_clauses(s, f):
    return flat(S.clause_rows(section_nodes(s)))


def document_clauses(s, f):
    """Every clause of all documents, with the places of its parts."""
    return flat(S.clause_rows(document_nodes(s, f), PROSE))


def document_assignments(s, f):
    """What all documents say of each actor and action."""
    c = S.clause_rows(document_nodes(s, f), PROSE).select("id", "action", F.explode("actors").alias("party"), "negated", "confidence", "condition", "object")
    return c.groupBy("party", "action").agg(
        F.count("*").alias("clauses"), F.count_distinct(F.substring_index("id", "#", 1)).alias("documents"), F.count_if("negated").alias("negated"), F.count_if(F.col("condition").isNotNull()).alias("conditional"),
        F.count_if(F.col("object") == "").alias("without_object"), F.round(F.avg("confidence"), 6).alias("confidence"),
    )


def _statements_sql(nodes: str, g: C.Grammar) -> str:
    return f"""{clauses_sql(nodes, g)},
st AS (SELECT id AS node, concat_ws('#', id, pos) AS id, CASE WHEN len(actors) > 0 THEN array_to_string(list_sort(actors), ',') ELSE 'unknown' END AS party, action, object, negated, exclusive, confidence FROM c),
kept AS (SELECT arg_min(id, pos) AS id, party, action, arg_min(object, pos) AS object, negated, arg_min(exclusive, pos) AS exclusive, arg_min(confidence, pos) AS confidence FROM (SELECT *, split_part(id, '#', 2)::INTEGER AS pos FROM st) GROUP BY node, party, action, lower(object), negated)"""


def section_statements(s, f):
    return S.responsibility_statements(section_nodes(s)).select("statement_id", "party", "action", "object", "negated", "exclusive", "confidence")


def section_responsibility(s, f):
    return S.responsibility_findings(section_nodes(s))


_UNASSIGNED = f"""SELECT 'responsibility' AS rule, 'unassigned' AS type, 'medium' AS severity, id AS node_a, NULL::VARCHAR AS node_b, 0.68::DOUBLE AS confidence FROM n
  WHERE regexp_matches(text, '(?i){chr(92)}bshall{chr(92)}b|{chr(92)}bmust{chr(92)}b|{chr(92)}brequired{chr(92)}s+to{chr(92)}b|{chr(92)}bis{chr(92)}s+responsible{chr(92)}b') AND len({names_sql('text', L.RESPONSIBLE_ACTORS)}) = 0"""


# --- acceptance ------------------------------------------------------------------------------------

_ENDS, _NEEDS = L.ACCEPTANCE_SUBJECT_ENDS, "list_concat(" * (len(L.ACCEPTANCE_PREREQUISITE) - 1) + f"regexp_extract_all(text, {Q.q('(?i)' + L.ACCEPTANCE_PREREQUISITE[0])}, 1)" + "".join(f", regexp_extract_all(text, {Q.q('(?i)' + p)}, 1))" for p in L.ACCEPTANCE_PREREQUISITE[1:])
CRITERIA_SQL = f"""cr AS MATERIALIZED (SELECT *, round(0.55 + CASE WHEN len(parties) > 0 THEN 0.15 ELSE 0 END + CASE WHEN status <> 'unknown' THEN 0.1 ELSE 0 END + CASE WHEN len(evidence) > 0 THEN 0.1 ELSE 0 END + CASE WHEN threshold THEN 0.1 ELSE 0 END, 6)::DOUBLE AS confidence FROM (
  SELECT id, document, section, trim(substr(CASE WHEN NOT {Q.has('text', _ENDS)} THEN text WHEN trim(regexp_extract(text, {Q.q('(?is)^(.*?)' + _ENDS)}, 1)) <> '' THEN trim(regexp_extract(text, {Q.q('(?is)^(.*?)' + _ENDS)}, 1)) ELSE trim(regexp_extract(text, {Q.q('(?is)' + _ENDS + '(.*)$')}, 1)) END, 1, 180)) AS subject,
    {names_sql('text', L.ACCEPTANCE_ACTIONS)} AS actions, {Q.ladder('text', L.ACCEPTANCE_STATUS, 'unknown')} AS status, {names_sql('text', L.ACCEPTANCE_PARTIES)} AS parties, {names_sql('text', L.ACCEPTANCE_EVIDENCE)} AS evidence,
    list_transform({_NEEDS}, lambda x: trim(x)) AS needs, {Q.has('text', L.ACCEPTANCE_THRESHOLD)} AS threshold, {Q.has('text', L.ACCEPTANCE_NEGATION)} AS negated FROM {NODES_SQL} WHERE text <> '') WHERE len(actions) > 0)"""


def section_criteria(s, f):
    c = S.acceptance_criteria(section_nodes(s))
    return c.select("id", "document", "section", "subject", "actions", "status", "parties", "evidence", F.array_sort("prerequisites").alias("prerequisites"), "threshold", "negated", "confidence")


def section_acceptance(s, f):
    """Findings on the criteria of all sections; a section stands before the next one of its document."""
    return S.acceptance_findings(S.acceptance_criteria(section_nodes(s)), section_order(s))


def section_order(s) -> DataFrame:
    return sections(s).where("parent_id is not null").select(F.col("parent_id").alias("src"), F.col("id").alias("dst"))


_WORDS = "list_distinct(list_filter(string_split(trim(regexp_replace(lower(subject), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: length(x) >= 3))"
_SAME, _APART = "list_has_any(x.actions, y.actions)", "(len(x.parties) > 0 AND len(y.parties) > 0 AND NOT list_has_any(x.parties, y.parties))"
ACCEPTANCE_SQL = f"""WITH {CRITERIA_SQL}, k AS (SELECT *, {_WORDS} AS w FROM cr),
p AS (SELECT x.id AS a, y.id AS b, {Q.jaccard('x.w', 'y.w')} AS sim, least(x.confidence, y.confidence) AS low, {_SAME} AS same, {_APART} AS other, x.negated <> y.negated AS neg, x.status AS sx, y.status AS sy, (len(x.evidence) = 0) <> (len(y.evidence) = 0) AS ev, x.threshold <> y.threshold AS th FROM k x JOIN k y ON x.id < y.id),
g AS (SELECT a, b, CASE WHEN neg AND same THEN 1 WHEN list_sort([sx, sy]) = ['prohibited', 'required'] THEN 2 WHEN same AND other THEN 3 WHEN sx <> sy AND 'conditional' IN (sx, sy) THEN 4 WHEN same AND ev THEN 5 WHEN same AND th THEN 6 END AS r, sim, low FROM p WHERE sim >= 0.4),
h AS (SELECT a, b, ['contradictory-criteria', 'contradictory-criteria', 'different-acceptor', 'conditional-mismatch', 'missing-evidence', 'missing-threshold'][r] AS kind,
  greatest(0, least(1, CASE r WHEN 1 THEN 0.65 + 0.2 * sim + 0.1 * low WHEN 2 THEN 0.75 + 0.2 * sim WHEN 3 THEN 0.5 + 0.25 * sim + 0.1 * low WHEN 4 THEN 0.45 + 0.25 * sim + 0.1 * low WHEN 5 THEN 0.5 + 0.2 * sim ELSE 0.45 + 0.2 * sim END))::DOUBLE AS conf FROM g WHERE r IS NOT NULL),
v AS (SELECT id, (len(parties) = 0)::INT + (len(evidence) = 0)::INT + (NOT threshold)::INT AS lacks FROM cr WHERE status IN ('required', 'conditional'))
SELECT 'acceptance' AS rule, kind AS type, CASE WHEN kind = 'contradictory-criteria' THEN CASE WHEN conf >= 0.8 THEN 'critical' ELSE 'high' END WHEN kind IN ('different-acceptor', 'conditional-mismatch') THEN CASE WHEN conf >= 0.75 THEN 'high' ELSE 'medium' END WHEN conf >= 0.7 THEN 'medium' ELSE 'low' END AS severity,
  a AS node_a, b AS node_b, round(conf, 6) AS confidence FROM h
UNION ALL SELECT 'acceptance', 'ambiguous-gate', CASE WHEN lacks >= 2 THEN 'medium' ELSE 'low' END, id, NULL, round(0.55 + lacks * 0.1, 6)::DOUBLE FROM v WHERE lacks > 0
UNION ALL SELECT 'acceptance', 'unsatisfied-prerequisite', 'medium', id, NULL, 0.72::DOUBLE FROM cr WHERE len(needs) > 0 AND id NOT IN (SELECT id FROM {SECTIONS_SQL} WHERE parent_id IS NOT NULL)"""


# --- compliance ------------------------------------------------------------------------------------

_BEST = "greatest(" + ", ".join(f"CASE WHEN {Q.has('text', p)} THEN {w} ELSE 0 END" for _, p, w in L.COMPLIANCE_LEVELS) + ")"
_LEVEL = "CASE " + " ".join(f"WHEN best = {w} AND {Q.has('text', p)} THEN '{n}'" for n, p, w in L.COMPLIANCE_LEVELS) + " END"
_CALLS = "list_distinct(flatten([" + ", ".join(f"CASE WHEN {Q.has('text', p)} THEN {types} ELSE []::VARCHAR[] END" for p, types in L.COMPLIANCE_CALLS_FOR) + "]))"
_PIECES = "list_filter(list_transform(string_split(regexp_replace(text, '([.!?;]) ([A-Z0-9])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')"
REQUIRED_SQL = f"""rq AS (SELECT concat_ws('#', id, pos) AS requirement_id, id, document, section, text, {_LEVEL} AS level, {Q.ladder('text', L.COMPLIANCE_STATUS, 'unknown')} AS status, {names_sql('text', L.COMPLIANCE_PARTIES)}[1] AS party, {names_sql('text', L.COMPLIANCE_AUTHORITIES)}[1] AS authority,
  list_sort({_CALLS}) AS required, round(least(1.0, best + CASE WHEN len({_CALLS}) > 0 THEN 0.01 ELSE 0 END), 6)::DOUBLE AS confidence
  FROM (SELECT *, {_BEST} AS best FROM (SELECT id, document, section, unnest({_PIECES}) AS text, generate_subscripts({_PIECES}, 1) - 1 AS pos FROM {NODES_SQL} WHERE text <> '')) WHERE best >= 0.7)"""
_DAY = r"\b(20\d{2}[-/][01]?\d[-/][0-3]?\d|[01]?\d[-/][0-3]?\d[-/]20\d{2})\b"
_TYPES = names_sql("text", L.COMPLIANCE_EVIDENCE)
EVIDENCE_SQL = f"""ev AS (SELECT concat_ws('#', id, type) AS evidence_id, id, document, section, type, CASE WHEN p AND f THEN 'conflicting' WHEN f THEN 'fail' WHEN p THEN 'pass' WHEN w THEN 'waived' ELSE 'unknown' END AS outcome, CASE WHEN type = 'other' THEN 0.7 ELSE 0.9 END::DOUBLE AS confidence,
  text AS description, nullif(regexp_extract(text, {Q.q(_DAY)}, 1), '') AS day FROM (SELECT *, unnest(CASE WHEN len({_TYPES}) > 0 THEN {_TYPES} WHEN p OR f THEN ['other'] ELSE []::VARCHAR[] END) AS type FROM (SELECT *, {Q.has('text', L.OUTCOME_PASS)} AS p, {Q.has('text', L.OUTCOME_FAIL)} AS f, {Q.has('text', L.OUTCOME_WAIVER)} AS w FROM {NODES_SQL} WHERE text <> '')))"""


def section_requirements(s, f):
    r = S.compliance_requirements(section_nodes(s))
    return r.select("requirement_id", "id", "document", "section", "text", "level", "status", "party", "authority", F.array_sort("required").alias("required"), "confidence")


def section_evidence(s, f):
    return S.compliance_evidence(section_nodes(s)).select("evidence_id", "id", "document", "section", "type", "outcome", "confidence")


def section_compliance(s, f):
    """Requirements and evidence read from all sections, linked where a section names what it calls for, and the findings on both."""
    r, e, links = _read(s)
    return CO.requirement_findings(r, e, links).unionByName(CO.evidence_findings(e, links))


def _read(s):
    n = section_nodes(s)
    r = S.compliance_requirements(n).withColumn("id", F.col("requirement_id"))
    e = S.compliance_evidence(n).select(F.col("evidence_id").alias("id"), F.col("id").alias("node"), "type", "outcome", "document", "section", "day", F.lit(None).cast("string").alias("author"), "description")
    # A requirement is held against what its own document's section says of the types it calls for.
    links = r.select(F.col("id").alias("requirement_id"), "document", "section", F.explode("required").alias("type"))
    return r, e, links


# --- workflow --------------------------------------------------------------------------------------

def _activity_sql(name: str, phase: str, weight: float, patterns: list[str]) -> str:
    hits = " + ".join(f"({Q.has('text', p)})::INT" for p in patterns)
    first, second = Q.q(rf"(?i)\b{name}(?:ed|ing|s)?\s+(?:the\s+)?([^.;:]{{3,100}})"), Q.q(rf"(?i)\b{name}\s+of\s+([^.;:]{{3,100}})")
    obj = f"trim(regexp_replace(CASE WHEN regexp_extract(text, {first}, 1) <> '' THEN regexp_extract(text, {first}, 1) ELSE regexp_extract(text, {second}, 1) END, {Q.q('(?i)' + L.ACTIVITY_OBJECT_ENDS)}, ''))"
    return f"SELECT id, document, section, text, '{name}' AS action, '{phase}' AS phase, {obj} AS object, {weight} AS weight, {hits} AS hits FROM nodes WHERE {hits} > 0"


ACTIVITIES_SQL = f"""nodes AS (SELECT * FROM {NODES_SQL} WHERE text <> ''), act AS ({' UNION ALL '.join(_activity_sql(*a) for a in L.WORKFLOW_ACTIVITIES)})
SELECT concat_ws('#', id, action) AS activity_id, id, document, section, action, phase, object, {Q.ladder('text', L.WORKFLOW_STATUS, 'unknown')} AS status, {names_sql('text', L.WORKFLOW_PARTIES)}[1] AS party, {names_sql('text', L.WORKFLOW_EVIDENCE)} AS evidence,
  list_sort(list_distinct({names_sql('text', L.WORKFLOW_PRECONDITIONS)})) AS preconditions, list_contains({names_sql('text', L.WORKFLOW_PRECONDITIONS)}, 'approval') AS approval, round(least(1.0, weight + least(0.03, (hits - 1) * 0.015) + CASE WHEN object <> '' THEN 0.02 ELSE 0 END), 6)::DOUBLE AS confidence FROM act"""


def section_activities(s, f):
    a = S.workflow_activities(section_nodes(s))
    return a.withColumn("preconditions", F.array_sort("preconditions"))


def section_workflow(s, f):
    """Findings on the activities read from all sections."""
    return W.workflow_findings(S.workflow_activities(section_nodes(s)).withColumn("id", F.col("activity_id")))


WORKFLOW_SQL = rules.JOBSQL.replace(values(rules.JOBS, rules.JOB_SCHEMA), f"(SELECT * EXCLUDE (id), activity_id AS id FROM (WITH {ACTIVITIES_SQL}))") + " SELECT document, 'workflow' AS rule, type, severity, node_a, node_b, confidence::DOUBLE AS confidence FROM every"
_DUTIES, _PROOFS = f"(SELECT requirement_id AS id, * EXCLUDE (id, requirement_id) FROM (WITH {REQUIRED_SQL} SELECT * FROM rq))", f"(SELECT evidence_id AS id, NULL::VARCHAR AS author, * EXCLUDE (id, evidence_id) FROM (WITH {EVIDENCE_SQL} SELECT * FROM ev))"
_LINKED = f"(SELECT d.id AS requirement_id, e.id AS evidence_id FROM (SELECT id, document, section, unnest(required) AS type FROM {_DUTIES}) d JOIN {_PROOFS} e USING (document, section, type))"
_FILLED = [x.replace(rules.DUTYSQL, _DUTIES).replace(rules.PROOFSQL, _PROOFS).replace(rules.LINKSQL, _LINKED) for x in (rules.DUTY_FINDINGS, rules.PROOF_FINDINGS)]
COMPLIANCE_SQL = f"SELECT * FROM ({_FILLED[0]}) UNION ALL SELECT * FROM ({_FILLED[1]})"

QUERIES = {
    "section_clauses": (section_clauses, f"WITH {clauses_sql(NODES_SQL, C.RESPONSIBILITY)} SELECT * FROM c"),
    "document_clauses": (document_clauses, f"WITH {clauses_sql(DOCUMENTS_SQL, PROSE_SQL)} SELECT * FROM c"),
    "document_assignments": (document_assignments, f"""WITH {clauses_sql(DOCUMENTS_SQL, PROSE_SQL)}, e AS (SELECT *, unnest(actors) AS party FROM c)
  SELECT party, action, count(*) AS clauses, count(DISTINCT split_part(id, '#', 1)) AS documents, count(*) FILTER (negated) AS negated, count(condition) AS conditional, count(*) FILTER (object = '') AS without_object, round(avg(confidence), 6) AS confidence FROM e GROUP BY party, action"""),
    "section_statements": (section_statements, f"WITH {_statements_sql(NODES_SQL, C.RESPONSIBILITY)} SELECT id AS statement_id, party, action, object, negated, exclusive, confidence FROM kept"),
    "section_responsibility": (section_responsibility, f"WITH {_statements_sql(NODES_SQL, C.RESPONSIBILITY)} {rules.responsibility_sql('(SELECT * FROM kept WHERE party <> ' + chr(39) + 'unknown' + chr(39) + ' AND object <> ' + chr(39) * 2 + ')', more=True)} UNION ALL {_UNASSIGNED}"),
    "section_criteria": (section_criteria, f"WITH {CRITERIA_SQL} SELECT * EXCLUDE (needs), list_sort(list_distinct(needs)) AS prerequisites FROM cr"),
    "section_acceptance": (section_acceptance, ACCEPTANCE_SQL),
    "section_requirements": (section_requirements, f"WITH {REQUIRED_SQL} SELECT * FROM rq"),
    "section_evidence": (section_evidence, f"WITH {EVIDENCE_SQL} SELECT * EXCLUDE (description, day) FROM ev"),
    "section_compliance": (section_compliance, COMPLIANCE_SQL),
    "section_activities": (section_activities, f"WITH {ACTIVITIES_SQL}"),
    "section_workflow": (section_workflow, WORKFLOW_SQL),
}
