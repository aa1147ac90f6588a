"""Operator 10: language-model scoring by a weighted backoff automaton.

Its states are the contexts seen in training, the empty one among them; a state
has an arc for every token seen after it, weighted by the smoothed
log-probability, and a failure arc to the next shorter context.  With MU
pseudo-counts and a share KAPPA of every count given to the shorter context h',
p(w|h) = ((1 - KAPPA) c(hw) + (MU + KAPPA c(h)) p(w|h')) / (c(h) + MU), so the
failure arc weighs log10((MU + KAPPA c(h)) / (c(h) + MU)); the root has an arc
for every token, with the base probability.

The automaton of a whole corpus fits nowhere.  Documents are read once into
blocks of bounded size, kept as token numbers; some blocks make a unit.  A unit
sends the distinct n-grams of its blocks with their counts, packed by hash range;
each range is summed up over all units, and a block gets back the totals of those
n-grams that others hold as well.  With these it builds the states and arcs that
its texts can reach, and every text is traversed once from left to right: a
missing arc is replaced by the failure arc, the state is carried on.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, give_back, small_batches, table, text_or_empty

ORDER = 3
MU = 10.0
KAPPA = 0.6
#: Bytes of text in a block, in a unit of blocks, and tokens per hash range of n-grams: they bound what a worker holds at once.
BLOCK_BYTES = 7_000_000
UNIT_BYTES = 32_000_000
RANGE_TOKENS = 2_500_000
#: Bits that tell two n-grams apart beyond those that number all of them: one in 2**SPARE is mistaken for another.
SPARE = 24
#: Tokens that are walked one after the other; the pieces of a longer text are walked beside one another.
PIECE = 512

_U = np.uint64
_SPREAD = _U(0x9E3779B97F4A7C15)


class _Numbers(dict):
    """word -> number in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(27))


def _squeezed(x: np.ndarray, differences: bool = False) -> bytes:
    """Byte planes, highest first, of numbers or of the differences of sorted ones: planes that hardly change take no space."""
    x = x.astype(np.uint64)
    if differences and len(x):
        x = np.r_[x[:1], np.diff(x)]
    return zstandard.ZstdCompressor(level=1).compress(x.view(np.uint8).reshape(-1, 8).T[::-1].tobytes())


def _numbers(b: bytes, differences: bool = False) -> np.ndarray:
    x = np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(8, -1)[::-1].T).view(np.uint64).ravel()
    return np.cumsum(x, dtype=np.uint64) if differences else x


def tokenized(texts: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted hashes of the distinct tokens, each token's place among them, tokens per text).

    Every text ends with the end token, a space: no word holds one.  Only A-Z are
    lowered and only ASCII white space splits, which is what bytes do.
    """
    seen = _Numbers()
    get, out, lengths = seen.__getitem__, [], []
    for t in texts:
        words = t.lower().split()
        words.append(b" ")
        out.append(np.fromiter(map(get, words), np.int64, len(words)))
        lengths.append(len(words))
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, seen), np.uint64, len(seen))
    order = np.argsort(h)
    rank = np.empty(len(h), np.int64)
    rank[order] = np.arange(len(h))
    return h[order], rank[np.concatenate(out)], np.array(lengths, np.int64)


class Grams:
    """The n-grams of a block, by order k: sorted distinct hashes, and for each position the place of the one that ends there."""

    def __init__(self, vocabulary: np.ndarray, tokens: np.ndarray, lengths: np.ndarray, order: int, shift: int) -> None:
        self.tokens, self.shift, self.vocabulary = tokens, _U(shift), vocabulary
        starts = np.cumsum(lengths) - lengths
        self.place = np.arange(len(tokens)) - np.repeat(starts, lengths)
        self.hashes, self.at = [vocabulary], [tokens]
        self.first = [np.empty(0, np.int64)]  # a position of each
        for k in range(2, order + 1):
            ends = np.flatnonzero(self.place >= k - 1)
            x = self.extended(self.hashes[-1][self.at[-1][ends - 1]], tokens[ends])
            u, first, inverse = np.unique(x, return_index=True, return_inverse=True)
            at = np.full(len(tokens), -1, np.int64)
            at[ends] = inverse
            self.hashes.append(u)
            self.at.append(at)
            self.first.append(ends[first])

    def extended(self, context: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Hashes of contexts with one more token."""
        return _mix(context * _SPREAD + self.vocabulary[token]) >> self.shift

    def counts(self, train: np.ndarray) -> list[np.ndarray]:
        """How often the training texts hold each n-gram; train: for each position."""
        return [np.bincount(at[at >= 0], weights=train[at >= 0], minlength=len(u)).astype(np.int64) for u, at in zip(self.hashes, self.at, strict=True)]


class Automaton:
    """States and arcs for the texts of a block.

    Level k holds the states of k tokens of context.  arcs[k] are the sorted
    hashes of context and token for the arcs of level k, weight[k] their
    weights; an arc of level k leads to the state of the same place at level
    k + 1, those of the last level to `back`, the state without the first token.
    fails[k] and fail_weight[k] are the failure arcs of level k.
    """

    def __init__(self, grams: Grams, counts: list[np.ndarray], n: int, v: int, mu: float, kappa: float) -> None:
        self.grams, self.order = grams, len(counts)
        p = (counts[0] + 0.5) / (n + 0.5 * (v + 1))
        self.base = np.log10(p)
        self.known = counts[0] > 0
        # The root has an arc for every token; a token that training doesn't have leads back to the root.
        self.arcs, self.weight, self.state = [grams.vocabulary], [self.base], [np.where(self.known, np.arange(len(p)), -1)]
        self.fails, self.fail_weight = [np.empty(0, np.int64)], [np.empty(0)]
        self.back = np.empty(0, np.int64)
        place, count = self.state[0], counts[0]  # n-gram -> its state, its state -> count
        for k in range(1, self.order):
            self.fails.append(self.back if k > 1 else np.full(len(count), -1, np.int64))
            self.fail_weight.append(np.log10((mu + kappa * count) / (count + mu)))
            seen = np.flatnonzero(counts[k] > 0)
            ends = grams.first[k][seen]
            context, rest = place[grams.at[k - 1][ends - 1]], place[grams.at[k - 1][ends]]
            p = ((1 - kappa) * counts[k][seen] + (mu + kappa * count[context]) * p[rest]) / (count[context] + mu)
            self.arcs.append(grams.hashes[k][seen])
            self.weight.append(np.log10(p))
            self.back = rest
            place, count = np.full(len(counts[k]), -1, np.int64), counts[k][seen]
            place[seen] = np.arange(len(seen))

    def step(self, level: np.ndarray, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Weights of reading a token in each of several states, which are moved on in place."""
        total = np.zeros(len(token))
        to_level, to_state, left = np.zeros_like(level), np.full_like(state, -1), level >= 0
        for k in range(self.order - 1, 0, -1):
            on = np.flatnonzero(left & (level == k))
            if not len(on):
                continue
            own, arcs = state[on], self.arcs[k]
            x = self.grams.extended(self.arcs[k - 1][own], token[on])
            at = np.searchsorted(arcs, x)
            hit = arcs[np.minimum(at, len(arcs) - 1)] == x if len(arcs) else np.zeros(len(x), bool)
            took, arc = on[hit], at[hit]
            total[took] += self.weight[k][arc]
            to_level[took], to_state[took] = (k + 1, arc) if k + 1 < self.order else (k, self.back[arc])
            left[took] = False
            lost = on[~hit]
            total[lost] += self.fail_weight[k][own[~hit]]
            level[lost], state[lost] = k - 1, self.fails[k][own[~hit]]
        on = np.flatnonzero(left)
        total[on] += self.weight[0][token[on]]
        if self.order > 1:
            reached = self.state[0][token[on]]
            to_level[on], to_state[on] = (reached >= 0).astype(level.dtype), reached
        level[:], state[:] = to_level, to_state
        return total

    def walk(self, lengths: np.ndarray) -> np.ndarray:
        """The log-probability of every text, one traversal each.

        A piece behind a text's first starts in the state that the order - 1
        tokens before it lead to, which is all that a state can remember.
        """
        tokens, starts = self.grams.tokens, np.cumsum(lengths) - lengths
        pieces = -(-lengths // PIECE)
        text = np.repeat(np.arange(len(lengths)), pieces)
        lo = starts[text] + PIECE * (np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        size = np.minimum(PIECE, starts[text] + lengths[text] - lo)
        by_size = np.argsort(-size, kind="stable")
        text, lo, size = text[by_size], lo[by_size], size[by_size]
        level, state = np.zeros(len(lo), np.int64), np.full(len(lo), -1, np.int64)
        for back in range(self.order - 1, 0, -1):
            on = np.flatnonzero(lo - back >= starts[text])
            own_level, own_state = level[on], state[on]
            self.step(own_level, own_state, tokens[lo[on] - back])
            level[on], state[on] = own_level, own_state
        total = np.zeros(len(lo))
        open_pieces = len(lo) - np.searchsorted(size[::-1], np.arange(int(size.max(initial=0))), "right")
        for j, m in enumerate(open_pieces.tolist()):
            total[:m] += self.step(level[:m], state[:m], tokens[lo[:m] + j])
        return np.bincount(text, weights=total, minlength=len(lengths))


def _blocks(docs: DataFrame, id_col: str, text_col: str, train) -> DataFrame:
    """(unit, block, ids, train, lengths, vocabulary, tokens): a row for every block of texts, in the order in which they are read."""
    rows = docs.select(F.col(id_col).alias("id"), train.alias("train"), F.encode(text_or_empty(text_col), "utf-8").alias("text"))
    small_batches(docs.sparkSession)
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, block, held = TaskContext.get().partitionId() << 24, 0, 0
        ids, marks, texts, size = [], [], [], 0

        def made() -> pa.RecordBatch:
            vocabulary, tokens, lengths = tokenized(texts)
            columns = [
                pa.array([unit], pa.int64()), pa.array([block], pa.int32()), pa.ListArray.from_arrays([0, len(texts)], pa.concat_arrays(ids)), pa.array([marks], pa.list_(pa.bool_())),
                pa.array([lengths], pa.list_(pa.int64())), pa.array([_squeezed(vocabulary, True)], pa.binary()), pa.array([_squeezed(tokens)], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["unit", "block", "ids", "train", "lengths", "vocabulary", "tokens"])

        for b in batches:
            start = 0
            for i, t in enumerate(b.column(2).to_pylist()):
                marks.append(b.column(1)[i].as_py())
                texts.append(t)
                size += len(t) + 16
                if size >= BLOCK_BYTES:
                    ids.append(b.column(0).slice(start, i + 1 - start))
                    yield made()
                    start, block, held = i + 1, block + 1, held + size
                    if held >= UNIT_BYTES:
                        unit, held = unit + 1, 0
                    ids, marks, texts, size = [], [], [], 0
                    give_back()
            if start < b.num_rows:
                ids.append(b.column(0).slice(start))
        if texts:
            yield made()
        give_back()

    return rows.mapInArrow(run, f"unit long, block int, ids array<{id_type}>, train array<boolean>, lengths array<long>, vocabulary binary, tokens binary")


def _grams(row: dict, order: int, shift: int) -> tuple[Grams, np.ndarray, np.ndarray]:
    """(n-grams of a block, whether each position is one to learn from, tokens per text)."""
    lengths = np.array(row["lengths"], np.int64)
    train = np.repeat(np.array(row["train"], bool), lengths)
    return Grams(_numbers(row["vocabulary"], True), _numbers(row["tokens"]).astype(np.int64), lengths, order, shift), train, lengths


def _cuts(u: np.ndarray, bits: int, ranges: int) -> np.ndarray:
    """Where each of the ranges, equal spans of the hash space, begins and the last ends in sorted hashes."""
    top = (u >> _U(bits - 31)).astype(np.int64) * ranges >> 31
    return np.searchsorted(top, np.arange(ranges + 1))


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train=None, order: int = ORDER, mu: float = MU, kappa: float = KAPPA) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) of every row of docs.

    train is a Boolean column that marks the rows to learn from (null: not).
    A null text is empty and has the end token only.  Texts of any length are
    read whole; equal ones have equal scores.  Repeated rows are counted and
    scored each; extra columns are not read.  Without training rows every token
    has the base probability of an empty vocabulary, which is 1.
    """
    train = F.coalesce(train if train is not None else F.lit(True), F.lit(False))
    scratch = Scratch(docs.sparkSession)
    blocks = scratch.keep(_blocks(docs, id_col, text_col, train))
    tokens = blocks.agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x))).first()[0] or 0
    ranges = max(1, -(-tokens // RANGE_TOKENS))
    shift = max(0, 64 - SPARE - max(16, int(tokens).bit_length()))

    def bits(k: int) -> int:
        return 64 if k == 1 else 64 - shift

    def sent(unit: int, found: dict[tuple[int, int], list]) -> pa.RecordBatch:
        """A row for each order and range of a unit, with the slices of its blocks."""
        keys = list(found)
        return pa.RecordBatch.from_arrays([
            pa.array([k for k, _ in keys], pa.int32()), pa.array([r for _, r in keys], pa.int32()), pa.array([unit] * len(keys), pa.int64()),
            *(pa.array([[x[i] for x in found[key]] for key in keys], kind) for i, kind in enumerate((pa.list_(pa.int32()), pa.list_(pa.binary()), pa.list_(pa.binary())))),
        ], names=["k", "r", "unit", "blocks", "keys", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, found = None, {}
        for row in (row for b in batches for i in range(b.num_rows) for row in b.slice(i, 1).to_pylist()):
            if row["unit"] != unit and found:
                yield sent(unit, found)
                found = {}
            unit = row["unit"]
            g, own, _ = _grams(row, order, shift)
            for k, (u, c) in enumerate(zip(g.hashes, g.counts(own), strict=True), 1):
                cut = _cuts(u, bits(k), ranges)
                for r in np.flatnonzero(np.diff(cut)).tolist():
                    a, b = cut[r], cut[r + 1]
                    found.setdefault((k, r), []).append((row["block"], _squeezed(u[a:b], True), _squeezed(c[a:b])))
            del g
            give_back()
        if found:
            yield sent(unit, found)

    def total(tab: pa.Table) -> pa.Table:
        keys = [[_numbers(x, True) for x in xs] for xs in tab.column("keys").to_pylist()]
        counts = [[_numbers(x).astype(np.int64) for x in xs] for xs in tab.column("counts").to_pylist()]
        u, inverse = np.unique(np.concatenate([x for xs in keys for x in xs]), return_inverse=True)
        sums = np.bincount(inverse, weights=np.concatenate([c for cs in counts for c in cs]), minlength=len(u)).astype(np.int64)
        masks, totals, at = [], [], 0
        for cs in counts:
            masks.append([])
            totals.append([])
            for c in cs:
                mine = sums[inverse[at : at + len(c)]]
                at += len(c)
                other = mine != c
                masks[-1].append(np.packbits(other).tobytes())
                totals[-1].append(_squeezed(mine[other]))
        give_back()
        first = np.arange(tab.num_rows) == 0  # the range's sums, told once
        return pa.table({
            "k": tab.column("k"), "r": tab.column("r"), "unit": tab.column("unit"), "blocks": tab.column("blocks"), "masks": pa.array(masks, pa.list_(pa.binary())), "totals": pa.array(totals, pa.list_(pa.binary())),
            "n": pa.array(first * int(sums.sum()), pa.int64()), "v": pa.array(first * int((sums > 0).sum()), pa.int64()),
        })

    counted = blocks.mapInArrow(count, "k int, r int, unit long, blocks array<int>, keys array<binary>, counts array<binary>")
    totals = scratch.keep(counted.groupBy("k", "r").applyInArrow(total, "k int, r int, unit long, blocks array<int>, masks array<binary>, totals array<binary>, n long, v long"))
    scratch.free()
    n, v = (int(x) for x in totals.where("k = 1").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first())
    id_type = blocks.schema["ids"].dataType.elementType.simpleString()

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        fields = [("id", left.schema.field("ids").type.value_type), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]
        got: dict[int, dict] = {}
        for row in right.to_pylist():
            for block, mask, sums in zip(row["blocks"], row["masks"], row["totals"], strict=True):
                got.setdefault(block, {})[row["k"], row["r"]] = (mask, sums)
        out = []
        for i in range(left.num_rows):
            row = left.slice(i, 1).select(["block", "train", "lengths", "vocabulary", "tokens"]).to_pylist()[0]
            g, own, lengths = _grams(row, order, shift)
            counts = g.counts(own)
            for k, (u, c) in enumerate(zip(g.hashes, counts, strict=True), 1):
                cut = _cuts(u, bits(k), ranges)
                for r in np.flatnonzero(np.diff(cut)).tolist():
                    mask, sums = got[row["block"]][k, r]
                    other = np.unpackbits(np.frombuffer(mask, np.uint8), count=int(cut[r + 1] - cut[r])).astype(bool)
                    c[cut[r] + np.flatnonzero(other)] = _numbers(sums).astype(np.int64)
            a = Automaton(g, counts, n, v, mu, kappa)
            starts = np.cumsum(lengths) - lengths
            columns = [
                left.column("ids").chunk(0).slice(i, 1).flatten() if left.column("ids").num_chunks == 1 else left.column("ids").slice(i, 1).combine_chunks().flatten(),
                pa.array(lengths), pa.array(np.add.reduceat(a.known[g.tokens].astype(np.int64), starts)), pa.array(np.full(len(lengths), n, np.int64)),
                pa.array(np.add.reduceat(a.base[g.tokens], starts)), pa.array(a.walk(lengths)),
            ]
            out.append(pa.Table.from_arrays(columns, schema=pa.schema(fields)))
            del g, a
            give_back()
        return pa.concat_tables(out) if out else pa.schema(fields).empty_table()

    schema = f"id {id_type}, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return blocks.groupBy("unit").cogroup(totals.drop("n", "v").groupBy("unit")).applyInArrow(scored, schema)


def held_out(id_col: str):
    return F.pmod(F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "utf-8")), F.lit(5)) == 1


def op10_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by the model of those that aren't held out."""
    s = score_texts(table(spark, sf_dir, "documents"), train=~held_out("doc_id"))
    return s.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op10_backoff_lm": op10_backoff_lm}
ORACLE_SQL: dict[str, str] = {}
