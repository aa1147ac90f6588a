"""Text functions as Column expressions: tokens, stems, sentences, references and the fields of a requirement."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as L

_EDGE = "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def folded(c: Column | str) -> Column:
    """The column as a string, null as empty."""
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


def squeezed(c: Column | str) -> Column:
    """White space collapsed and trimmed."""
    return F.trim(F.regexp_replace(folded(c), r"\s+", " "))


def normalized_key(c: Column | str) -> Column:
    """Lower case, runs of anything but letters and digits as one space."""
    return F.trim(F.regexp_replace(F.lower(folded(c)), "[^a-z0-9]+", " "))


def section_number_key(c: Column | str) -> Column:
    """Digits and letters only, lower case: `01-45-00`, `01 45 00` and `014500` are equal."""
    return F.regexp_replace(F.lower(folded(c)), "[^a-z0-9]", "")


def section_number(c: Column | str) -> Column:
    """The six-digit section number as `NN NN NN` with its suffix, else the text squeezed."""
    s = squeezed(c)
    p = r"^(\d{2})[ .-]?(\d{2})[ .-]?(\d{2})(\.\d+)?$"
    return F.when(s.rlike(p), F.regexp_replace(s, p, "$1 $2 $3$4")).otherwise(s)


def tokens(c: Column | str, stop_words: Sequence[str] = L.STOP_WORDS) -> Column:
    """Lower-case tokens longer than one character without stop words, repeats kept."""
    stops = F.array(*(F.lit(w) for w in stop_words))
    return F.filter(F.regexp_extract_all(F.lower(folded(c)), F.lit(f"({L.TOKEN})")), lambda t: (F.length(t) > 1) & ~F.array_contains(stops, t))


def stem(c: Column, endings: Sequence[str] = L.STEM_ENDINGS) -> Column:
    """A token without the first of the endings that fits."""
    return F.regexp_replace(F.lower(c), f"({'|'.join(endings)})$", "")


def stems(c: Column | str) -> Column:
    return F.transform(tokens(c), lambda t: stem(t))


def stem_set(c: Column | str) -> Column:
    return F.array_distinct(stems(c))


def count_occurrences(text: Column | str, term: str) -> Column:
    """How often a term stands between characters that are no letters or digits."""
    if not term:
        return F.lit(0)
    quoted = "".join("\\" + ch if ch in r".*+?^${}()|[]\/-" else ch for ch in term.lower())
    return F.regexp_count(F.lower(folded(text)), F.lit(f"(^|[^a-z0-9]){quoted}(?=$|[^a-z0-9])"))


def sentences(c: Column | str) -> Column:
    """Pieces between white space that follows `.`, `!` or `?`, trimmed, empty ones dropped."""
    parts = F.split(F.regexp_replace(folded(c), "\r", " "), r"(?<=[.!?])\s+")
    return F.filter(F.transform(parts, lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def references(c: Column | str) -> Column:
    """Distinct section, number and paragraph references, lower case, three characters or more."""
    t = F.lower(folded(c))
    found = F.concat(*(F.regexp_extract_all(t, F.lit(f"({p})")) for p in L.REFERENCES))
    clean = F.transform(found, lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return F.array_distinct(F.filter(clean, lambda x: F.length(x) >= 3))


def ascii_bounds(pattern: str) -> str:
    """The pattern with `\\b` as the edge of a run of ASCII letters, digits and `_`; to Java's own, `ä` is part of a word."""
    return re.sub(r"(?<!\\)((?:\\\\)*)\\b", lambda m: m[1] + _EDGE, pattern)


def matches(c: Column | str, pattern: str) -> Column:
    return folded(c).rlike(f"(?i){pattern}")


def first_of(c: Column | str, words: Sequence[str]) -> Column:
    """The first word of the list that the text holds anywhere; null if none."""
    t = F.lower(folded(c))
    return F.coalesce(*(F.when(t.contains(w), F.lit(w)) for w in words))


def all_of(c: Column | str, words: Sequence[str]) -> Column:
    """The words of the list that the text holds, in the list's order."""
    t = F.lower(folded(c))
    return F.filter(F.array(*(F.when(t.contains(w), F.lit(w)) for w in words)), lambda x: x.isNotNull())


def ladder(c: Column | str, rungs: Sequence[tuple[str, str]], otherwise: str | None = None) -> Column:
    """The name of the first pattern that matches."""
    out = None
    for name, p in rungs:
        out = F.when(matches(c, p), name) if out is None else out.when(matches(c, p), name)
    return out.otherwise(otherwise)


def party(c: Column | str, parties: Sequence[str] = L.PARTIES) -> Column:
    return first_of(c, parties)


def deliverables(c: Column | str, words: Sequence[str] = L.DELIVERABLES) -> Column:
    return all_of(c, words)


def polarity(c: Column | str) -> Column:
    return ladder(c, [("negative", L.NEGATIVE), ("positive", L.POSITIVE)], "neutral")


def requirement_type(c: Column | str) -> Column:
    return ladder(c, [("prohibited", L.NEGATIVE), ("mandatory", L.POSITIVE), ("permitted", r"\bmay\b"), ("advisory", r"\bshould\b")], "informational")


def requirement_strength(kind: Column) -> Column:
    m = F.create_map(*(F.lit(x) for kv in L.STRENGTH.items() for x in kv))
    return F.coalesce(F.try_element_at(m, kind), F.lit(25))


def action(c: Column | str) -> Column:
    """What follows the first modal verb, without final punctuation; the whole sentence if there is none."""
    s = squeezed(c)
    p = r"(?i)\b(?:shall not|must not|may not|shall|must|required to|required|may|should|will)\b\s+(.+)"
    return F.when(s.rlike(p), F.trim(F.regexp_replace(F.trim(F.regexp_extract(s, p, 1)), "[.;:]+$", ""))).otherwise(s)


def subject(c: Column | str, of_party: Column) -> Column:
    """The party, else the 2 to 100 characters before the first modal verb, without a leading article."""
    s = squeezed(c)
    p = r"(?i)^(.{2,100}?)\s+\b(?:shall not|must not|may not|shall|must|required to|may|should|will)\b"
    return F.coalesce(of_party, F.when(s.rlike(p), F.trim(F.regexp_replace(F.trim(F.regexp_extract(s, p, 1)), r"(?i)^(the|a|an)\s+", ""))))


def timing(c: Column | str) -> Column:
    """The clause of the first timing pattern that matches, else null."""
    s = folded(c)
    return F.coalesce(*(F.when(s.rlike(f"(?i){p}"), squeezed(F.regexp_extract(s, f"(?i)({p})", 1))) for p in L.TIMING))


def clauses(c: Column | str, pattern: str, most: int = 6) -> Column:
    """Distinct clauses that a pattern finds, in order, the first `most`."""
    found = F.regexp_extract_all(folded(c), F.lit(f"(?i)({pattern})"))
    return F.slice(F.array_distinct(F.filter(F.transform(found, lambda x: squeezed(x)), lambda x: x != "")), 1, most)


def conditions(c: Column | str) -> Column:
    return clauses(c, L.CONDITION)


def exceptions(c: Column | str) -> Column:
    return clauses(c, L.EXCEPTION_CLAUSE)


def deliverable_type(c: Column | str) -> Column:
    return ladder(c, L.DELIVERABLE_TYPES, "deliverable")


def sentence_confidence(c: Column | str) -> Column:
    s = folded(c)
    flag = lambda p, n: F.when(matches(s, p), n).otherwise(0)
    score = flag(L.REQUIREMENT, 25) + flag(L.RESPONSIBILITY, 20) + flag(L.DEFINITION, 15) + flag(L.EXCEPTION, -5) + F.least(F.length(s) / 12, F.lit(20.0))
    return F.greatest(F.lit(0), F.least(F.lit(100), rounded(score))).cast("int")


def rounded(c: Column, digits: int = 0) -> Column:
    """Half up toward positive infinity, as floor(x + 0.5)."""
    k = 10**digits
    return F.floor(c * k + 0.5) / k


def intents(c: Column | str) -> Column:
    """All intents of a question in the lexicon's order; `general` if none."""
    found = F.filter(F.array(*(F.when(matches(c, p), F.lit(n)) for n, p in L.INTENTS.items())), lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("general")))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets given as arrays; 0 if one is empty."""
    n = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(n / (F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)) - n))


def text_similarity(a: Column | str, b: Column | str) -> Column:
    return jaccard(stem_set(a), stem_set(b))


def truncated(c: Column | str, most: int) -> Column:
    """At most `most` characters, the last an ellipsis if something was cut."""
    s = squeezed(c)
    return F.when(F.length(s) > most, F.concat(F.rtrim(F.substring(s, 1, most - 1)), F.lit("…"))).otherwise(s)


def excerpt(c: Column | str, term: str, around: int = 200) -> Column:
    """The text around the first place of a term, null if it is not there."""
    s = folded(c)
    at = F.locate(term.lower(), F.lower(s))
    start = F.greatest(at - around, F.lit(1))
    return F.when(at > 0, F.trim(F.substring(s, start, (at - start) + len(term) + around)))


def citations(c: Column | str) -> Column:
    """Distinct numbers of `[S#]` marks in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(folded(c), F.lit(r"\[S(\d{1,9})\]"), F.lit(1)), lambda x: x.cast("int")))


def escaped(c: Column | str) -> Column:
    """Mark-up characters as entities."""
    s = folded(c)
    for ch, e in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        s = F.replace(s, F.lit(ch), F.lit(e))
    return s


def stable_key(c: Column | str) -> Column:
    """A hash of a JSON text that does not depend on the order of fields, at any depth, nor on spaces; null if it is no JSON.

    A variant keeps the fields of an object in the order of their names.
    """
    return F.md5(F.to_json(F.try_parse_json(F.col(c) if isinstance(c, str) else c)).cast("binary"))
