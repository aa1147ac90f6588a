"""Fragments of DuckDB SQL that say what the text functions compute."""

from ..functions import lexicons as L

STOPS = "[" + ", ".join(f"'{w}'" for w in L.STOP_WORDS) + "]"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def tokens(c: str) -> str:
    return f"list_filter(regexp_extract_all(lower(coalesce({c}, '')), '{L.TOKEN}'), lambda t: len(t) > 1 AND NOT list_contains({STOPS}, t))"


def stems(c: str) -> str:
    return f"list_transform({tokens(c)}, lambda t: regexp_replace(t, '({'|'.join(L.STEM_ENDINGS)})$', ''))"


def stem_set(c: str) -> str:
    return f"list_distinct({stems(c)})"


def jaccard(a: str, b: str) -> str:
    n = f"len(list_intersect({a}, {b}))"
    return f"(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE {n}::DOUBLE / (len({a}) + len({b}) - {n}) END)"


def sentences(c: str) -> str:
    cut = f"regexp_replace(replace(coalesce({c}, ''), chr(13), ' '), '([.!?])\\s+', '\\1' || chr(1), 'g')"
    return f"list_filter(list_transform(string_split({cut}, chr(1)), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '')"


def has(c: str, pattern: str) -> str:
    return f"regexp_matches(coalesce({c}, ''), {q('(?i)' + pattern)})"


def ladder(c: str, rungs, otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {has(c, p)} THEN {q(n)}" for n, p in rungs) + f" ELSE {q(otherwise)} END"


def first_of(c: str, words) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower(coalesce({c}, '')), {q(w)}) THEN {q(w)}" for w in words) + " END"


def squeezed(c: str) -> str:
    return f"trim(regexp_replace(coalesce({c}, ''), '\\s+', ' ', 'g'))"


REQUIREMENT_TYPE = [("prohibited", L.NEGATIVE), ("mandatory", L.POSITIVE), ("permitted", r"\bmay\b"), ("advisory", r"\bshould\b")]


def requirement_type(c: str) -> str:
    return ladder(c, REQUIREMENT_TYPE, "informational")


def strength(kind: str) -> str:
    return "CASE " + kind + " " + " ".join(f"WHEN {q(k)} THEN {v}" for k, v in L.STRENGTH.items()) + " ELSE 25 END"


def confidence(c: str) -> str:
    flag = lambda p, n: f"CASE WHEN {has(c, p)} THEN {n} ELSE 0 END"
    s = " + ".join([flag(L.REQUIREMENT, 25), flag(L.RESPONSIBILITY, 20), flag(L.DEFINITION, 15), flag(L.EXCEPTION, -5), f"least(len({c}) / 12.0::DOUBLE, 20.0)"])
    return f"greatest(0, least(100, floor({s} + 0.5)))::INTEGER"
