"""Operator 7: toxicity by a lexicon that catches misspelled terms.

The lexicon is a trie of terms and stems, seeded with common insults and grown
from labelled documents.  A token that is no term itself is read by its
Levenshtein automaton, a bit-parallel one, along the trie's branches, which finds
all terms within one edit at once.  Every hit is weighed by its context window:
quotation marks and verbs of reporting weaken it, direct address strengthens it.
A logistic function of the sums gives the score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, fresh, small_batches, table

#: Labelled documents that a model is learned from: those of least hash. The lexicon and the weights come from them alone,
#: so this bounds what the driver and a model hold; nothing else does.
SAMPLE = 12_000
#: Natural logarithm of how much commoner a term must be in toxic texts.
STRENGTH = 3.0
#: Toxic documents that must hold a learned term.
SUPPORT = 4
STEM_LENGTHS = (4, 5, 6, 7)
#: Different words that must begin with a learned stem.
STEM_WORDS = 5
FUZZY_LENGTH = 5
WINDOW = 6
REJECT = 0.3
VOCABULARY = 500_000

# Common insults, verbs of reporting, words of direct address, and quotation marks.
SEED = ("idiot", "moron", "stupid", "imbecile", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "clown", "dumbass", "bastard", "asshole", "bitch")
REPORTING = frozenset("said says called calls wrote writes quoted quote word term slur phrase dit sagte dijo escribió schrieb écrit".split())
ADDRESS = frozenset("you your you're youre u yourself tu te du dich dir vous toi usted eres sie".split())
QUOTES = frozenset('"“”„«»')

_TOKEN = re.compile(r'\w+|["“”„«»]')
_WORD = r"[\p{L}\p{N}_]+"


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall((text or "").lower())


def _insert(root: dict, letters: str, term: str) -> None:
    for c in letters:
        root = root.setdefault(c, {})
    root[""] = term


def _along(root: dict, token: str, fixed: int) -> list[str]:
    """Terms of a trie within one edit of a token and with its first `fixed` letters.

    The token's automaton steps along the branches.  Bit i of a state set: the
    first i letters of the token are read; one set per number of edits so far.
    """
    masks: dict[str, int] = {}
    for i, c in enumerate(token):
        masks[c] = masks.get(c, 0) | 2 << i
    end, out, stack = 1 << len(token), [], [(root, 1, 3, 0)]
    while stack:
        node, r0, r1, depth = stack.pop()
        branches = node.items() if depth >= fixed else ((token[depth], node[token[depth]]),) if token[depth] in node else ()
        for c, child in branches:
            if not c:
                if (r0 | r1) & end:
                    out.append(child)
                continue
            m = masks.get(c, 0)
            n0 = (r0 << 1) & m
            n1 = ((r1 << 1) & m) | r0 | (r0 << 1) | (n0 << 1)
            if n0 | n1:
                stack.append((child, n0, n1, depth + 1))
    return out


class Trie:
    """Terms by length, each length as a trie of its terms and one of them reversed; a node is a dict, its term under the key ''.

    A term within one edit of a token has its first half as the token's
    beginning, or its second half as the token's end, and about its length: only
    the branches below such a half are walked.
    """

    def __init__(self, terms: list[str]) -> None:
        self.sizes: dict[int, tuple[dict, dict, set, set]] = {}
        for t in terms:
            front, back, heads, tails = self.sizes.setdefault(len(t), ({}, {}, set(), set()))
            _insert(front, t, t)
            _insert(back, t[::-1], t)
            heads.add(t[: len(t) // 2])
            tails.add(t[len(t) // 2 :])

    def within_one(self, token: str) -> list[str]:
        """All terms at edit distance 0 or 1."""
        n, out = len(token), []
        for size in (n - 1, n, n + 1):
            if size in self.sizes:
                front, back, heads, tails = self.sizes[size]
                half = size // 2
                if token[:half] in heads:
                    out += _along(front, token, half)
                if token[n - (size - half) :] in tails:
                    out += _along(back, token[::-1], size - half)
        return list(dict.fromkeys(out))


FEATURES = ("hits", "rate", "strongest", "fuzzy", "length")
#: Intercept and weights that labels move: with few labels, or none, a model stays near them.
PRIOR = (-4.0, 1.5, 1.0, 0.5, 0.5, 0.0)


@dataclass
class Model:
    terms: dict[str, float]
    stems: dict[str, float] = field(default_factory=dict)
    known: frozenset = frozenset()  # clean words near a term
    coef: tuple[float, ...] = PRIOR

    def trie(self) -> Trie:
        return Trie([t for t in self.terms if len(t) >= FUZZY_LENGTH])

    def matcher(self) -> Matcher:
        return Matcher(self)

    def score(self, f: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.coef[0] + f @ np.array(self.coef[1:]), -30, 30)))


class Matcher(dict):
    """token -> (weight, fuzzy) or None, remembered."""

    def __init__(self, model: Model) -> None:
        super().__init__()
        self.model, self.trie = model, model.trie()

    def __missing__(self, token: str) -> tuple[float, bool] | None:
        if len(self) >= VOCABULARY:
            self.clear()
        m, got = self.model, None
        weights = [m.terms[token]] if token in m.terms else []
        weights += [m.stems[token[:k]] for k in STEM_LENGTHS if token[:k] in m.stems]
        if weights:
            got = (max(weights), False)
        elif len(token) >= FUZZY_LENGTH - 1 and token not in m.known:
            near = self.trie.within_one(token)
            if near:
                got = (max(m.terms[t] for t in near), True)
        self[token] = got
        return got

    def features(self, text: str | None) -> list[float]:
        """hits: context-weighed sum of exact hits, rate per 100 tokens, the strongest, the fuzzy sum (logs of sums), and length."""
        t = tokens(text)
        exact = fuzzy = best = 0.0
        for i, token in enumerate(t):
            m = self[token]
            if m is None:
                continue
            w = m[0] * context(t, i)
            best = max(best, w)
            if m[1]:
                fuzzy += w
            else:
                exact += w
        n = max(len(t), 1)
        return [math.log1p(exact), math.log1p(100 * exact / n), best / 4, math.log1p(fuzzy), math.log1p(n) / 5]


def context(t: list[str], i: int) -> float:
    """Factor of a hit at token i: 0.4 in quotation or report, 1.3 in direct address, else 1."""
    before, after = t[max(0, i - WINDOW) : i], t[i + 1 : i + 1 + WINDOW]
    quoted = any(x in QUOTES for x in before) and any(x in QUOTES for x in after)
    if quoted or any(x in REPORTING for x in before[-3:]):
        return 0.4
    return 1.3 if any(x in ADDRESS for x in before[-4:]) or any(x in ADDRESS for x in after[:4]) else 1.0


def held_out(id_col: str):
    return F.pmod(F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "utf-8")), F.lit(4)) == 2


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(text, toxic) of at most SAMPLE labelled documents that aren't held out, one row each.

    Null ids, labels and texts are left out; labels of an id that disagree count
    as toxic; of several texts of an id, the one of least hash stands for it.
    """
    ids = labels.select(F.col(id_col).alias("id"), "toxic").where("id is not null and toxic is not null").where(~held_out("id"))
    ids = ids.groupBy("id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    own = own.join(F.broadcast(checkpointed(ids)), "id").groupBy("id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("s"), F.max("toxic").alias("toxic"))
    return checkpointed(own.select("s.text", "toxic"))


def _lexicon(sample: DataFrame) -> tuple[dict, dict, frozenset]:
    """Terms, stems, and clean words near a term, from word counts in the sample: all that are strong enough."""
    w = sample.select("toxic", F.monotonically_increasing_id().alias("r"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit(_WORD), F.lit(0))).alias("w"))
    w = w.groupBy("r", "w").agg(F.max("toxic").alias("x"), F.count("*").alias("n"))
    w = w.groupBy("w").agg(F.sum(F.when(F.col("x") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("x") == 0, F.col("n")).otherwise(0)).alias("c"), F.sum(F.col("x").cast("long")).alias("docs"))
    w = checkpointed(w)
    toxic, clean = (x or 0 for x in w.agg(F.sum("t"), F.sum("c")).first())
    strength = F.ln((F.col("t") + 0.5) / F.lit(toxic + 1.0)) - F.ln((F.col("c") + 0.5) / F.lit(clean + 1.0))
    terms = w.where((F.col("docs") >= SUPPORT) & (F.length("w") > 2)).withColumn("s", strength).where(F.col("s") >= STRENGTH)
    stems = w.select(F.explode(F.transform(F.array(*(F.lit(k) for k in STEM_LENGTHS)), lambda k: F.when(F.length("w") > k, F.substring("w", 1, k)))).alias("p"), "w", "t", "c", "docs").where("p is not null")
    stems = stems.groupBy("p").agg(F.sum("t").alias("t"), F.sum("c").alias("c"), F.sum("docs").alias("docs"), F.sum((F.col("docs") > 0).cast("int")).alias("words"))
    stems = stems.where((F.col("docs") >= 4 * SUPPORT) & (F.col("words") >= STEM_WORDS)).withColumn("s", strength).where(F.col("s") >= STRENGTH)
    learned, stem = ({r[c]: float(r["s"]) for r in df.select(c, "s").collect()} for df, c in ((terms, "w"), (stems, "p")))
    every = dict.fromkeys(SEED, STRENGTH) | learned
    trie = Trie([t for t in every if len(t) >= FUZZY_LENGTH])

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[[len(x) >= FUZZY_LENGTH - 1 and x not in every and bool(trie.within_one(x)) for x in pdf["w"]]]

    common = w.where((F.col("c") > 0) & (F.col("c") >= F.col("t"))).select("w").mapInPandas(near, "w string")
    known = frozenset(r["w"] for r in common.collect())
    return every, stem, known


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    """Logistic regression by Newton steps, from PRIOR and held near it by a ridge."""
    a, prior = np.c_[np.ones(len(x)), x], np.array(PRIOR)
    b = prior.copy()
    penalty = np.diag([ridge / 100] + [ridge] * x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        g = a.T @ (y - p) - penalty @ (b - prior)
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty, g)
        b += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in b)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from the labels; what they don't tell stays as the seed terms and PRIOR have it.

    Only labels outside the held-out quarter are read.  Counts are by word over
    at most SAMPLE documents; the driver gets the strong words of these and
    SAMPLE rows of five numbers.  Repeated rows and ids count once.
    """
    small_batches(docs.sparkSession)
    sample = _sample(docs, labels, id_col, text_col)
    model = Model(*_lexicon(sample))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model.matcher()
        for pdf in batches:
            out = pd.DataFrame([m.features(t) for t in pdf["text"]], columns=list(FEATURES))
            out["y"] = pdf["toxic"].astype(float).array
            yield out

    rows = sample.mapInPandas(run, ", ".join(f"{f} double" for f in (*FEATURES, "y"))).toPandas()
    rows = rows.sort_values(list(rows.columns))
    model.coef = _fit(rows[list(FEATURES)].to_numpy(), rows["y"].to_numpy())
    return model


def score_toxicity(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The keep columns of docs and score (0 to 1), a row for each row.

    Null and empty texts have the score of no hits; texts of any length are read
    whole; equal texts have equal scores.  A column score may not be kept; other
    columns of docs are not read.
    """
    if "score" in {c.lower() for c in keep}:
        raise ValueError("keep clashes with the result column score")
    small_batches(docs.sparkSession)
    src = docs.select(*keep, F.col(text_col).alias(fresh(docs, "_text")))
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.matcher()
        for b in batches:
            f = np.array([m.features(t) for t in b.column(n).to_pylist()]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(model.score(f), pa.float64())], names=[*keep, "score"])

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in src.schema.fields[:n])
    return src.mapInArrow(run, f"{kept}score double")


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", at: float = REJECT) -> DataFrame:
    """docs without the rows whose score is at or above `at`; all columns pass through whatever their names, no row is shuffled.

    Null and empty texts stay, as no hit tells against them; repeated rows stay or go together.
    """
    small_batches(docs.sparkSession)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.matcher()
        for b in batches:
            f = np.array([m.features(t) for t in b.column(place).to_pylist()]).reshape(-1, len(FEATURES))
            yield b.filter(pa.array(model.score(f) < at, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from the labels that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    model = learn(docs, table(spark, sf_dir, "labels"))
    scored = score_toxicity(docs, model, keep=("doc_id",))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= REJECT).cast("int").alias("predicted"))


QUERIES = {"op7_toxicity": op7_toxicity}
ORACLE_SQL: dict[str, str] = {}
