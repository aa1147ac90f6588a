"""Operator 5 [native]: secret scan with corpus-wide ownership frequency.

Candidates are found by patterns with their positions; the hash of every
candidate's value is then counted over the whole corpus by distinct
repositories and owners.  A value that many owners share is a copied example;
one that a single owner holds and that looks random is taken for live.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, fresh, table, text_or_empty

# The patterns of the base kinds, in the order in which kinds are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
#: Opaque strings outside the base kinds: 24 characters or more, judged by their mix of classes.
OPAQUE = r"[A-Za-z0-9+/_=-]{24,}"
KINDS = ("assign", "access", "hex", "opaque", "live", "copied")


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    group: int  # the group that is the secret's value
    least: int  # the least length of that value
    guard: str  # a cheaper test that every text with a match passes


BASE = (
    Kind("assign", ASSIGN, 2, 12, r"[:=]"),
    Kind("access", ACCESS, 0, 18, "AKIA"),
    Kind("hex", HEX, 0, 16, HEX),
)
EXTRA = Kind("opaque", OPAQUE, 0, 24, OPAQUE)


#: Matches whose positions are summed up at once; the sums of the runs are added up after that.
RUN = 128


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once: inside a lambda, what doesn't depend on its argument is computed for each element."""
    return F.transform(F.array(value), use)[0]


def _placed(parts: Column, kind: Kind) -> Column:
    """Positions of matches given as (gap before, length, value): running sums, run by run, so that no long array is copied for each match."""
    spans_t = "array<struct<start:int,end:int,kind:string,value:string>>"
    runs = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(parts) / F.lit(RUN)).cast("int") - 1, F.lit(0)))
    run = lambda c: F.slice(parts, c * RUN + 1, F.lit(RUN))
    sums = F.transform(runs, lambda c: F.aggregate(run(c), F.lit(0), lambda s, m: s + m["gap"] + m["len"]))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    firsts = F.aggregate(sums, zero, lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])

    def inside(first: Column, c: Column) -> Column:
        state = F.struct(first.alias("at"), F.array().cast(spans_t).alias("out"))
        return F.aggregate(run(c), state, lambda s, m: F.struct(
            (s["at"] + m["gap"] + m["len"]).alias("at"),
            F.concat(s["out"], F.array(F.struct(
                (s["at"] + m["gap"]).alias("start"), (s["at"] + m["gap"] + m["len"]).alias("end"), F.lit(kind.name).alias("kind"), m["value"].alias("value"),
            ))).alias("out"),
        ), lambda s: s["out"])

    return F.flatten(F.zip_with(firsts, runs, inside))


def spans(text: Column, kind: Kind) -> Column:
    """array<struct<start, end, kind, value>>: leftmost non-overlapping matches, failing ones dropped.

    The pieces between the matches and the matches themselves give every
    position, in code points, end exclusive; time is linear in the text but for
    the runs of RUN matches.
    """
    p = F.lit(kind.pattern)
    whole = F.regexp_extract_all(text, p, F.lit(0))
    value = F.regexp_extract_all(text, p, F.lit(kind.group)) if kind.group else whole
    parts = F.zip_with(F.split(text, kind.pattern, -1), F.arrays_zip(whole.alias("w"), value.alias("v")),
                       lambda a, b: F.struct(F.length(a).alias("gap"), F.length(b["w"]).alias("len"), b["v"].alias("value")))
    # The piece behind the last match has no partner: its length is null.
    found = _let(F.filter(parts, lambda m: m["len"].isNotNull()), lambda x: _placed(x, kind))
    kept = F.filter(found, lambda x: F.length(x["value"]) >= kind.least)
    return F.when(text.rlike(kind.guard), kept).otherwise(F.array().cast("array<struct<start:int,end:int,kind:string,value:string>>"))


def random_looking(v: Column) -> Column:
    """Whether a value has the looks of a random key: enough distinct characters, and digits beside letters."""
    distinct = F.size(F.array_distinct(F.split(v, "")))
    return (F.length(v) >= 16) & v.rlike("[0-9]") & v.rlike("[A-Za-z]") & (distinct >= 8) & ~v.rlike("(?i)example|changeme|placeholder|x{6}|0123456|abcdef0")


def candidates(text: Column) -> Column:
    """Base spans and opaque ones of mixed classes, as one array."""
    opaque = F.filter(spans(text, EXTRA), lambda x: x["value"].rlike("[a-z]") & x["value"].rlike("[A-Z]") & x["value"].rlike("[0-9]"))
    return F.concat(*(spans(text, k) for k in BASE), opaque)


def ownership(found: DataFrame, value: str, repo: str, owner: str) -> DataFrame:
    """(value, n_repos, n_owners) from candidate rows; nulls count as a repository or owner of their own.

    Rows are first reduced to distinct (value, owner, repo), with map-side
    combine, then to counts by (value, owner), then by value: a value held by
    everyone comes to one row per owner and task.
    """
    pairs = found.select(value, F.struct(repo).alias("_r"), F.struct(owner).alias("_o")).distinct()
    by_owner = pairs.groupBy(value, "_o").agg(F.count("*").alias("_n"))
    return by_owner.groupBy(value).agg(F.sum("_n").alias("n_repos"), F.count("*").alias("n_owners"))


def scan_secrets(
    docs: DataFrame, text_col: str = "text", repo_cols: tuple[str, ...] = ("source", "lang"), owner_col: str = "source", copied_owners: int = 3, keep: tuple[str, ...] | None = None,
) -> DataFrame:
    """The keep columns of docs (all if None) and secrets: array<struct<start, end, kind, value_sha256, n_repos, n_owners, verdict>>.

    verdict is `copied` if at least copied_owners owners hold the value, `live`
    if fewer do and it looks random, else `plain`.  Counts cover all rows of
    docs.  Null and empty texts have an empty array; repeated rows count once
    per owner; texts of any length are read whole.  A column of docs named
    secrets is replaced.  The patterns run once: the candidates of each row are
    written to the shared folder, and rows without any meet no other row.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() == "secrets"])
    kept = list(docs.columns if keep is None else keep)
    row, cands, repo, owner, arr = (fresh(docs, n) for n in ("_row", "_found", "_repo", "_owner", "_secrets"))
    text = text_or_empty(text_col)
    slim = lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), F.sha2(x["value"], 256).alias("v"), random_looking(x["value"]).alias("random"))
    array_t = "array<struct<start:int,end:int,kind:string,v:string,random:boolean>>"
    some = F.when(text.rlike(f"{HEX}|AKIA|[:=]|{OPAQUE}"), F.transform(candidates(text), slim)).otherwise(F.array().cast(array_t))
    scanned = Scratch(docs.sparkSession).keep(docs.select(
        *kept, F.monotonically_increasing_id().alias(row), F.struct(*repo_cols).alias(repo), F.col(owner_col).alias(owner), some.alias(cands)
    ))
    hit = scanned.where(F.size(cands) > 0)
    found = hit.select(row, repo, owner, F.inline(cands))
    counts = ownership(found, "v", repo, owner)
    verdict = F.when(F.col("n_owners") >= copied_owners, "copied").when(F.col("random"), "live").otherwise("plain")
    one = F.struct("start", "end", "kind", F.col("v").alias("value_sha256"), "n_repos", "n_owners", verdict.alias("verdict"))
    marked = found.select(row, "start", "end", "kind", "v", "random").join(counts, "v").groupBy(row).agg(F.sort_array(F.collect_list(one)).alias(arr))
    none = F.array().cast(marked.schema[arr].dataType)
    without = scanned.where(F.size(cands) == 0).select(*kept, none.alias("secrets"))
    return hit.select(*kept, row).join(marked, row).select(*kept, F.col(arr).alias("secrets")).unionByName(without)


def _line(x: Column) -> Column:
    return F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))


def _joined(arr: Column) -> Column:
    """kind:start:end by start, then kind as listed."""
    rank = {k: i for i, k in enumerate(KINDS)}
    order = F.create_map(*(F.lit(x) for kv in rank.items() for x in kv))
    keyed = F.array_sort(F.transform(arr, lambda x: F.struct(x["start"].alias("a"), F.element_at(order, x["kind"]).alias("b"), x["end"].alias("c"), _line(x).alias("s"))))
    return F.array_join(F.transform(keyed, lambda x: x["s"]), ",")


def op5_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents; owners are sources, repositories are (source, lang)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    s = scan_secrets(docs, keep=("doc_id",))
    one = F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("kind"))
    plain = lambda x, kind=None: F.struct(x["start"].alias("start"), x["end"].alias("end"), (x["kind"] if kind is None else kind).alias("kind"))
    s = s.select(
        "doc_id",
        F.transform(F.filter("secrets", lambda x: x["kind"].isin("assign", "access", "hex")), lambda x: plain(x)).alias("base"),
        F.transform(F.filter("secrets", lambda x: x["kind"] == "opaque"), lambda x: plain(x)).alias("opaque"),
        F.array_distinct(F.transform(F.filter("secrets", lambda x: x["verdict"] != "plain"), lambda x: plain(x, x["verdict"]))).alias("judged"),
    )
    n = lambda col, kind: F.size(F.filter(col, lambda x: x["kind"] == kind)).cast("long")
    return s.select(
        "doc_id", *(n("base", k).alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.concat("base", "opaque", "judged")).alias("spans"),
        n("judged", "live").alias("n_live"), n("judged", "copied").alias("n_copied"),
    )


QUERIES = {"op5_secret_ownership": op5_secret_ownership}


def _oracle() -> str:
    """Positions from the pieces between matches, verdicts from counts over all documents."""
    q = lambda p: "'" + p.replace("'", "''") + "'"
    found = []
    for rank, k in enumerate((*BASE, EXTRA)):
        value = f"regexp_extract_all(t, {q(k.pattern)}, {k.group})" if k.group else "w"
        found.append(f"SELECT r, '{k.name}' AS kind, {rank} AS rank, unnest(range(1, len(w) + 1)) AS i, w, {value} AS v, p FROM (SELECT r, t, regexp_extract_all(t, {q(k.pattern)}) AS w, string_split_regex(t, {q(k.pattern)}) AS p FROM d)")
    placed = "SELECT r, kind, rank, list_sum(list_transform(p[1:i], lambda x: len(x)))::BIGINT + coalesce(list_sum(list_transform(w[1:i - 1], lambda x: len(x))), 0)::BIGINT AS a, len(w[i]) AS n, v[i] AS v FROM f"
    least = " ".join(f"WHEN '{k.name}' THEN {k.least}" for k in (*BASE, EXTRA))
    spans = lambda cond, src: f"coalesce((SELECT string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank, b) FROM {src} x WHERE x.r = d.r AND {cond}), '')"
    count = lambda k, src: f"(SELECT count(*) FROM {src} x WHERE x.r = d.r AND kind = '{k}')"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, lang, coalesce(text, '') AS t FROM documents),
f AS ({' UNION ALL '.join(found)}), g AS ({placed}),
s AS (SELECT r, kind, rank, a, a + n AS b, v FROM g WHERE len(v) >= CASE kind {least} END AND (kind <> 'opaque' OR (regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[0-9]')))),
o AS (SELECT v, count(DISTINCT coalesce(source, chr(0))) AS owners FROM s JOIN d USING (r) GROUP BY v),
j AS (SELECT DISTINCT r, CASE WHEN owners >= 3 THEN 'copied' ELSE 'live' END AS kind, CASE WHEN owners >= 3 THEN 5 ELSE 4 END AS rank, a, b FROM s JOIN o USING (v)
  WHERE owners >= 3 OR (len(v) >= 16 AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND len(list_distinct(regexp_extract_all(v, '.'))) >= 8 AND NOT regexp_matches(v, '(?i)example|changeme|placeholder|x{{6}}|0123456|abcdef0'))),
e AS (SELECT r, kind, rank, a, b FROM s UNION ALL SELECT * FROM j)
SELECT doc_id, {', '.join(f"{count(k.name, 's')} AS n_{k.name}" for k in BASE)}, sha256({spans("kind IN ('assign', 'access', 'hex')", 's')}) AS base_sha256, {spans('true', 'e')} AS spans, {count('live', 'j')} AS n_live, {count('copied', 'j')} AS n_copied FROM d"""


ORACLE_SQL = {"op5_secret_ownership": _oracle()}
