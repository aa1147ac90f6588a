"""Dependencies between requirements, timelines, evidence links, specification search, and the texts handed to an answer."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as T
from . import retrieval as R
from .extraction import PHASES
from .graph import _settled, task_count
from .pairs import dealt_members, found_in, similar_sets
from .rules import clamp

PHASE_RANK = {name: i for i, (name, _) in enumerate(PHASES)}
MILESTONE_ORDER = ["notice to proceed", "kickoff", "submittal approval", "delivery", "installation", "testing", "commissioning", "acceptance", "occupancy", "final completion"]


def long_words(c: Column | str) -> Column:
    return F.array_distinct(F.filter(F.split(T.normalized_key(c), " "), lambda w: F.length(w) >= 4))


def overlap(a: Column, b: Column) -> Column:
    """Words in common over the size of the larger set."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(a), F.size(b))


# --- dependencies ----------------------------------------------------------------------------------

def phase_edges(reqs: DataFrame) -> DataFrame:
    """(src, dst, confidence): requirements of neighbouring phases on one matter.

    One matter: the same heading, the same document with an overlap of 0.12, or
    an overlap of 0.28.  Pairs of one heading come from a join, the others from
    similar word sets, of all documents from 0.28 on and of one below; so none
    comes twice, and what is told of pairs is told where they are made.
    """
    rank = F.create_map(*(F.lit(x) for kv in PHASE_RANK.items() for x in kv))
    r = reqs.where("phase <> 'general'").select(F.col("requirement_id").alias("id"), "document_id", T.normalized_key("heading").alias("h"), rank[F.col("phase")].alias("k"), long_words("statement").alias("w"))
    r = _settled(r)
    after = F.col("b_k") == F.col("a_k") + 1
    conf = lambda o, doc, head: F.least(T.rounded(100 * (0.45 + o + 0.2 * head.cast("int") + 0.1 * doc.cast("int"))), F.lit(100)).cast("int")
    one = F.coalesce(F.col("a_document_id") == F.col("b_document_id"), F.lit(False))
    a, b = (r.where("h <> ''").select("h", *(F.col(c).alias(f"{x}_{c}") for c in ("id", "k", "document_id", "w"))) for x in "ab")
    out = a.join(b, "h").where(after).select(F.col("a_id").alias("src"), F.col("b_id").alias("dst"), conf(overlap(F.col("a_w"), F.col("b_w")), one, F.lit(True)).alias("confidence"))
    r = r.select(F.struct("id", "h").alias("id"), "document_id", "k", "w")
    a, b = F.col("a_id.h"), F.col("b_id.h")
    other = after & ~F.coalesce((a == b) & (a != ""), F.lit(False))
    far = {"keep": ("k", "document_id"), "also": {"confidence": conf(F.col("similarity"), one, F.lit(False))}, "apart": other}
    near = {"keep": ("k",), "same": ("document_id",), "also": {"confidence": conf(F.col("similarity"), F.lit(True), F.lit(False))}, "apart": other & (F.col("similarity") < 0.28)}
    for least, how in ((0.28, far), (0.12, near)):
        p = similar_sets(r, F.col("w"), least, measure="larger", fits=lambda x, y: y["k"] == x["k"] + 1, **how)
        out = out.unionByName(p.select(F.col("a_id.id").alias("src"), F.col("b_id.id").alias("dst"), "confidence"))
    return out


def _clause_score(p: DataFrame) -> DataFrame:
    phase = F.when((F.col("p") == F.col("phase")) & (F.col("p") != "general"), 0.25).otherwise(0.0)
    return p.withColumn("score", overlap(F.col("w"), F.col("rw")) + phase + F.when((F.col("h") != "") & F.col("c").contains(F.col("h")), 0.25).otherwise(0.0))


def _clause_sides(clauses: DataFrame, reqs: DataFrame) -> tuple[DataFrame, DataFrame]:
    c = clauses.select("clause_id", "own", T.normalized_key("clause").alias("c"), long_words("clause").alias("w"), T.ladder(T.normalized_key("clause"), PHASES, "general").alias("p"))
    return c, reqs.select("requirement_id", "phase", T.normalized_key("heading").alias("h"), long_words("statement").alias("rw"))


def clause_matches(clauses: DataFrame, reqs: DataFrame, at: float = 0.28, most: int = 5) -> DataFrame:
    """(clause_id, requirement_id, score, place): the requirements a clause speaks of: overlap, 0.25 for its phase, 0.25 for its heading.

    clauses: clause_id, own (the requirement it comes from), clause.  Beyond 0.25
    a pair needs a word in common or a heading that stands in the clause,
    wherever and however short.
    """
    if at <= 0.25:
        raise ValueError("a threshold of 0.25 or less can be met by the phase alone")
    c, r = (_settled(x) for x in _clause_sides(clauses, reqs))
    by_word = c.select("clause_id", F.explode("w").alias("x")).join(r.select("requirement_id", F.explode("rw").alias("x")), "x").select("clause_id", "requirement_id")
    hits = found_in(r.select(F.col("h").alias("term")), c.select(F.col("clause_id").alias("id"), F.col("c").alias("n")))
    by_head = r.select("requirement_id", F.col("h").alias("term")).join(hits, "term").select(F.col("id").alias("clause_id"), "requirement_id")
    p = by_word.unionByName(by_head).distinct().join(c, "clause_id").join(r, "requirement_id").where("own <> requirement_id")
    w = Window.partitionBy("clause_id").orderBy(F.desc("score"), "requirement_id")
    return _clause_score(p).where(F.col("score") >= at).withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("clause_id", "requirement_id", "score", "place")


def workflow_by_phase(reqs: DataFrame) -> DataFrame:
    """(phase, place, requirement_id): all requirements in the order of phases."""
    rank = F.create_map(*(F.lit(x) for kv in PHASE_RANK.items() for x in kv))
    w = Window.partitionBy("phase").orderBy(F.desc("strength"), "requirement_id")
    return reqs.select("phase", F.row_number().over(w).alias("place"), "requirement_id", F.coalesce(F.try_element_at(rank, F.col("phase")), F.lit(99)).alias("rank")).orderBy("rank", "place")


# --- timeline --------------------------------------------------------------------------------------

def timeline_conflicts(events: DataFrame, at: float = 0.35) -> DataFrame:
    """(a, b, kind, gap, severity): events on one topic whose dates or durations differ by a day or more. events: id, text, day, days."""
    gap, dur = F.abs(F.datediff("a_day", "b_day")).cast("double"), F.abs(F.col("a_days") - F.col("b_days"))
    one = lambda kind, g, sev: F.when(g >= 1, F.struct(F.lit(kind).alias("kind"), g.alias("gap"), sev.alias("severity")))
    found = F.array(one("date-discrepancy", gap, F.when(gap > 30, "high").when(gap > 7, "medium").otherwise("low")), one("duration-discrepancy", dur, F.when(dur > 30, "high").otherwise("medium")))
    p = similar_sets(events.select("id", "day", "days", "text"), long_words("text"), at, measure="larger", keep=("day", "days"), each=F.array_compact(found), either=True)
    return p.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), "each.*")


def chronological(events: DataFrame) -> DataFrame:
    """(id, place): dated events by day; undated ones by the usual order of milestones, a year apart from the first day on."""
    first = F.min("day").over(Window.partitionBy())
    rank = F.coalesce(*(F.when(F.lower("text").contains(m), F.lit(i)) for i, m in enumerate(MILESTONE_ORDER)), F.lit(len(MILESTONE_ORDER)))
    e = events.withColumn("k", F.coalesce(F.col("day"), F.date_add(first, rank * 365)))
    return e.select("id", F.row_number().over(Window.orderBy("k", F.desc("priority"), "id")).alias("place"))  # one project's events


def timeline_priority(kind: Column, clause: Column, dated: Column, final: Column) -> Column:
    """Points by requirement type, clause and milestone, 100 at most."""
    s = F.when(kind == "prohibited", 35).when(kind == "mandatory", 30).otherwise(0) + F.when(clause == "deadline", 25).when(clause == "blocking-until", 20).otherwise(0)
    return F.least(F.lit(100), s + F.when(dated, 20).otherwise(0) + F.when(final, 15).otherwise(0))


def anchored(durations: DataFrame, anchors: DataFrame) -> DataFrame:
    """(id, due): relative durations (id, anchor, relation, days) resolved at their anchor's day; unknown anchors stay open."""
    j = durations.join(anchors, "anchor", "left")
    return j.select("id", F.when(F.col("relation") == "before", F.date_sub("day", F.ceil("days").cast("int"))).otherwise(F.date_add("day", F.ceil("days").cast("int"))).alias("due"))


# --- evidence --------------------------------------------------------------------------------------

def _link_score(p: DataFrame) -> DataFrame:
    yes = lambda c, v: F.when(c, v).otherwise(0.0)
    s = 0.45 * T.jaccard(F.col("w"), F.col("ew")) + yes(F.col("document_id") == F.col("e_doc"), 0.18) + yes(F.col("section") == F.col("e_sec"), 0.17) + yes(F.col("links_to") == F.col("requirement_id"), 0.5)
    return p.withColumn("score", clamp(s + yes(F.col("needs_type") == F.col("e_type"), 0.25) + yes(F.col("party") == F.col("e_party"), 0.08)))


def _link_sides(reqs: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    r = reqs.select("requirement_id", "document_id", "section", "party", "needs_type", T.stem_set("statement").alias("w"))
    return r, evidence.select("evidence_id", F.col("document_id").alias("e_doc"), F.col("section").alias("e_sec"), F.col("party").alias("e_party"), F.col("type").alias("e_type"), "links_to", T.stem_set("text").alias("ew"))


def evidence_links(reqs: DataFrame, evidence: DataFrame, at: float = 0.32) -> DataFrame:
    """(requirement_id, evidence_id, score): by words, place, an explicit link, the required type and party.

    What can make 0.32 without a word: an explicit link, document and section, or
    the required type with the document, the section or the party.  Any other
    link needs a similarity of the words of 2/15 at least, as what else is equal
    then makes 0.26 at most.  Rows with equal words, place, type and party are
    scored as one, and no pair of rows is shuffled.
    """
    if at < 0.32:
        raise ValueError("pairs below 0.32 are not looked for")
    key = lambda *cs: F.struct(F.xxhash64(*cs).alias("h"), F.xxhash64(F.lit(1), *cs).alias("g"))
    own, theirs = ("document_id", "section", "party", "needs_type", "w"), ("e_doc", "e_sec", "e_party", "e_type", "ew")
    r, e = _link_sides(reqs, evidence)
    # xxhash64 passes nulls over, so a null and a text are told apart by flags.
    rows = lambda x, cs: _settled(x.withColumn("__u", key(*cs, *(F.col(c).isNull() for c in cs))))
    r, e = rows(r, own), rows(e, theirs)
    alike = lambda x, cs, k: _settled(x.groupBy("__u").agg(*(F.first(c).alias(c) for c in cs)).withColumnRenamed("__u", k))
    rc, ec = alike(r, own, "rk"), alike(e, theirs, "ek").withColumn("links_to", F.lit(None).cast("string"))
    pairs = None
    for k, o in ((("document_id", "section"), ("e_doc", "e_sec")), *(((x, "needs_type"), (y, "e_type")) for x, y in (("document_id", "e_doc"), ("section", "e_sec"), ("party", "e_party")))):
        a = rc.select("rk", *(F.col(c).alias(f"_k{i}") for i, c in enumerate(k)))
        b = ec.select("ek", *(F.col(c).alias(f"_k{i}") for i, c in enumerate(o)))
        some = a.join(b, [f"_k{i}" for i in range(len(k))]).select("rk", "ek")
        pairs = some if pairs is None else pairs.unionByName(some)
    sides = rc.select(F.lit(0).alias("side"), F.col("rk").alias("k"), "w").unionByName(ec.select(F.lit(1).alias("side"), F.col("ek").alias("k"), F.col("ew").alias("w")))
    near = similar_sets(sides.withColumn("id", F.to_json(F.struct("side", "k"))), F.col("w"), 2 / 15 - 1e-9, keep=("side", "k"), apart=F.col("a_side") < F.col("b_side"))
    pairs = pairs.unionByName(near.select(F.col("a_k").alias("rk"), F.col("b_k").alias("ek"))).distinct()
    scored = _link_score(pairs.join(rc, "rk").join(ec, "ek").withColumn("requirement_id", F.lit(None).cast("string"))).where(F.col("score") >= at).select("rk", "ek", "score")
    # What a link names is scored by itself; all others are the members of two classes, whose parts go to all tasks.
    named = _link_score(r.join(e, F.col("requirement_id") == F.col("links_to"))).where(F.col("score") >= at).select("requirement_id", "evidence_id", "score")
    part = lambda x, i, held, k, n: dealt_members(x.select("__u", F.col(i).alias("id"), *held), held).select(F.col("__u").alias(k), F.col("__part").alias(f"{n}_part"), F.col("__mem").alias(n))
    p = scored.join(part(r, "requirement_id", [], "rk", "rm"), "rk").join(part(e, "evidence_id", ["links_to"], "ek", "em"), "ek")
    p = p.repartition(task_count(p), "rk", "rm_part", "ek", "em_part").select("score", F.explode("rm").alias("x"), "em").select("score", "x", F.explode("em").alias("y"))
    p = p.select("score", "y.links_to", F.explode("x.id").alias("requirement_id"), "y").select("score", "links_to", "requirement_id", F.explode("y.id").alias("evidence_id"))
    return p.where(~F.col("requirement_id").eqNullSafe(F.col("links_to"))).select("requirement_id", "evidence_id", "score").unionByName(named)


def evidence_pairs(evidence: DataFrame) -> DataFrame:
    """(a, b, kind): copies (type and place equal, similarity 0.9) and pass against fail on one scope.

    Neither meets pairs that it doesn't name: copies are pairs of similar word sets, and a scope's passes and its
    failures are dealt to parts, pairs of which go to all tasks.
    """
    e = _settled(evidence.select(F.col("evidence_id").alias("id"), "type", "section", "result", T.stem_set("text").alias("w")).where("type is not null and section is not null"))
    against = lambda a, b: F.coalesce(F.array_sort(F.array(a, b)) == F.array(F.lit("fail"), F.lit("pass")), F.lit(False))
    copies = similar_sets(e, F.col("w"), 0.9, keep=("result",), same=("type", "section"), each=F.when(against(F.col("a_result"), F.col("b_result")), F.array().cast("array<string>")).otherwise(F.array(F.lit("duplicate"))), either=True)
    part = lambda result, k: dealt_members(e.where(F.col("result") == result).select(F.struct("type", "section").alias("__u"), "id"), []).select("__u", F.col("__part").alias(f"{k}_part"), F.flatten("__mem.id").alias(k))
    p = part("pass", "x").join(part("fail", "y"), "__u")
    p = p.repartition(task_count(p), "__u", "x_part", "y_part").select(F.explode("x").alias("x"), "y").select("x", F.explode("y").alias("y"))
    pairs = p.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.lit("conflicting").alias("kind"))
    return copies.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), F.col("each").alias("kind")).unionByName(pairs)


# --- answers ---------------------------------------------------------------------------------------

def context(hits: DataFrame, most: int = 12) -> DataFrame:
    """One row: the evidence text of the hits in the order of their numbers."""
    block = F.concat(F.lit("[S"), F.col("source_number").cast("string"), F.lit("] "), F.col("heading"), F.lit("\n"), T.folded("text"))
    h = hits.where(F.col("source_number") <= most).select("source_number", block.alias("b"))
    return h.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source_number", "b"))), lambda x: x["b"]), "\n\n").alias("context"), F.count("*").alias("sources"))


def best_sentences(hits: DataFrame, words: Iterable[str], most: int = 3) -> DataFrame:
    """(id, pos, sentence): the sentences of each hit with most of the words, in the order of the text."""
    stems = F.array(*(F.lit(R._stem(w)) for w in words))
    s = hits.select("id", F.posexplode(T.sentences("text")).alias("pos", "sentence")).withColumn("score", F.size(F.array_intersect(T.stem_set("sentence"), stems)))
    w = Window.partitionBy("id").orderBy(F.desc("score"), "pos")
    return s.where("score > 0").withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).select("id", "pos", "sentence").orderBy("id", "pos")


def expanded_retrieval(sections: DataFrame, questions: Sequence[str], k: int = 5) -> DataFrame:
    """(id, score, questions): the union of several questions' scores; a section counts with its best."""
    out = None
    for i, q in enumerate(questions):
        s = R.score_sections(sections, R.expand_query(q)).where("score > 0").select("id", "score", F.lit(i).alias("q")).orderBy(F.desc("score"), "id").limit(k)
        out = s if out is None else out.unionByName(s)
    return out.groupBy("id").agg(F.max("score").alias("score"), F.count_distinct("q").alias("questions"))


def session_audit(hits: DataFrame, used: DataFrame) -> DataFrame:
    """One row: sources found, used, and unused, documents and the confidence of a retrieval session."""
    u = used.select("source_number").distinct().withColumn("u", F.lit(1))
    j = hits.join(u, "source_number", "left")
    return j.agg(F.count("*").alias("found"), F.count("u").alias("used"), (F.count("*") - F.count("u")).alias("unused"), F.count_distinct("document_id").alias("documents"), T.rounded(100.0 * F.count("u") / F.greatest(F.count("*"), F.lit(1))).alias("percent"))


# --- specifications --------------------------------------------------------------------------------

def page_index(lines: DataFrame, last_page: int) -> DataFrame:
    """(number, title, start_page, end_page): section starts in page lines (page, line, text), without those of a table of contents.

    A start is a line `SECTION NN NN NN`; its title is the rest of the line or
    the next one.  Pages with more than three starts, and lines with leaders or a
    page number at the end, are a table of contents.  A number starts once.
    """
    w = Window.orderBy("page", "line")  # one document's lines
    p = r"(?i)^\s*SECTION\s+(\d{2})[ .-]?(\d{2})[ .-]?(\d{2})\s*(?:[-–—:]\s*)?(.*)$"
    hit = F.col("text").rlike(p)
    s = lines.withColumns({"next": F.lead("text").over(w), "hit": hit}).where("hit")
    s = s.where(~F.col("text").rlike(r"\.{3,}|\s\d{1,4}$") | F.col("text").rlike(r"(?i)^\s*SECTION\s+\d{2}[ .-]?\d{2}[ .-]?\d{2}\s*$"))
    s = s.withColumn("on_page", F.count("*").over(Window.partitionBy("page"))).where("on_page <= 3")
    title = F.trim(F.regexp_extract("text", p, 4))
    s = s.select("page", "line", F.concat_ws(" ", *(F.regexp_extract("text", p, i) for i in (1, 2, 3))).alias("number"), F.when(title != "", title).otherwise(F.trim("next")).alias("title"))
    s = s.withColumn("n", F.row_number().over(Window.partitionBy("number").orderBy("page", "line"))).where("n = 1")
    nxt = F.lead("page").over(Window.orderBy("page", "line"))
    return s.select("number", "title", F.col("page").alias("start_page"), F.when(nxt.isNull(), F.lit(last_page)).otherwise(F.greatest(F.col("page"), nxt - 1)).alias("end_page"))


def search_pages(pages: DataFrame, words: str, around: int = 40) -> DataFrame:
    """(page, excerpt, n): pages that hold the words, with the text around their first place."""
    return pages.where(F.lower("text").contains(words.lower())).select("page", T.excerpt("text", words, around).alias("excerpt"), T.count_occurrences("text", words).alias("n"))


def rank_specifications(specs: DataFrame, question: str, most: int = 5) -> DataFrame:
    """(number, points, matched): 10 for a term in the number, 5 in the title, 2 in the body; long questions need two terms.

    A question about schedules prefers division 01: 12 more there, 4 less elsewhere, and if any of it is left only that.
    """
    terms = list(dict.fromkeys(R._tokens(question)))
    timed = bool(re.search(r"\b(schedule|milestone|duration|completion)\b", question.lower()))
    num, title, body = F.lower("number"), F.lower(T.folded("title")), F.lower(T.folded("body"))
    points, matched = F.lit(0), F.lit(0)
    for t in terms:
        n, i, b = num.contains(t), title.contains(t), body.contains(t)
        points = points + F.when(n, 10).otherwise(0) + F.when(i, 5).otherwise(0) + F.when(b, 2).otherwise(0)
        matched = matched + (n | i | b).cast("int")
    s = specs.withColumns({"points": points, "matched": matched}).where(F.col("matched") >= (2 if len(terms) > 3 else 1))
    if timed:
        first = F.substring("number", 1, 2) == "01"
        s = s.withColumn("points", F.col("points") + F.when(first, 12).otherwise(-4)).withColumn("any01", F.max(first).over(Window.partitionBy()))
        s = s.where(~F.col("any01") | first)
    return s.select("number", F.col("points").cast("int").alias("points"), F.col("matched").cast("int").alias("matched")).orderBy(F.desc("points"), F.desc("matched"), "number").limit(most)


def vocabulary_matches(texts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(id, term, applies): defined terms that a text uses; a term with a scope applies where the text names it."""
    t = texts.select("id", F.concat(F.lit(" "), T.normalized_key("text"), F.lit(" ")).alias("k"))
    v = vocabulary.select("term", T.normalized_key("term").alias("tk"), T.normalized_key("scope").alias("sk")).withColumn("head", F.element_at(F.split("tk", " "), 1))
    words = t.select("id", "k", F.explode(F.array_distinct(F.split(F.trim("k"), " "))).alias("head"))
    j = words.join(v, "head").where(F.col("k").contains(F.concat(F.lit(" "), F.col("tk"), F.lit(" "))))
    return j.select("id", "term", ((F.col("sk") == "") | F.col("k").contains(F.concat(F.lit(" "), F.col("sk"), F.lit(" ")))).alias("applies")).distinct()


def relevant_records(records: DataFrame, question: str, most: int = 10) -> DataFrame:
    """(id, matched): records (id, body) with most of the question's words."""
    words = F.array(*(F.lit(t) for t in dict.fromkeys(R._tokens(question))))
    return records.select("id", F.size(F.array_intersect(F.array_distinct(T.tokens("body")), words)).alias("matched")).where("matched > 0").orderBy(F.desc("matched"), "id").limit(most)


def entities(texts: DataFrame) -> DataFrame:
    """(id, kind, value): section numbers, rooms, tags, dates and parties that a text names."""
    from . import drawings as W

    t = T.folded("text")
    kinds = {
        "section": F.regexp_extract_all(t, F.lit(r"(\b\d{2} \d{2} \d{2}\b)")), "room": F.transform(F.regexp_extract_all(t, F.lit(r"(?i)\bROOM\s*(\d{2,5}[A-Z]?)\b")), lambda x: F.upper(x)),
        "equipment": F.transform(F.regexp_extract_all(t, F.lit(W.TAG)), lambda x: F.upper(x)), "date": D.absolute_dates("text"), "party": T.all_of("text", ["contractor", "owner", "engineer", "architect"]),
    }
    e = F.flatten(F.array(*(_tagged(k, v) for k, v in kinds.items())))
    return texts.select("id", F.explode(F.array_distinct(e)).alias("e")).select("id", "e.*")


def _tagged(kind: str, values: Column) -> Column:
    return F.transform(values, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("value")))


def root_causes(findings: DataFrame, edges: DataFrame, depth: int = 12) -> DataFrame:
    """(finding_node, cause, distance): findings upstream of others, nearest first: what to mend before."""
    from .graph import reachable, reversed_edges

    hit = findings.select(F.col("node_a").alias("node")).distinct()
    up = reachable(reversed_edges(edges), hit, depth)
    return up.join(hit, "node", "left_semi").where("seed <> node").select(F.col("seed").alias("finding_node"), F.col("node").alias("cause"), F.col("depth").alias("distance"))
