"""Operator 4: benchmark decontamination by size-partitioned MinHash containment search.

Items are partitioned by size: an item of q shingles belongs to the level
u = 2**i >= q.  For every level, a document is the set of its overlapping windows
of two blocks of u shingles, so that an item inside it lies inside one window of
bounded size and their Jaccard similarity has a lower bound that doesn't depend
on the document's length.  A window that shares one of HASHES min-hashes with an
item of its level makes a candidate; exact containment of the item's shingles in
the whole document decides.  Items of up to BLOCK shingles, of which a document
must hold all, are sought by one of their shingles itself, which misses none.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import small_batches, table

K = 5
CONTAINMENT = 0.8
HASHES = 40
#: Shingles in the smallest block.
BLOCK = 4
#: Items and bytes of their texts that one pass over the documents looks for; more items take more passes.
PASS_ITEMS = 20_000
PASS_BYTES = 32_000_000
VOCABULARY = 500_000
_BITS = 20

_WORD = re.compile(r"\w+")
_U = np.uint64
_ODD = np.random.default_rng(41).integers(1, 2**63, HASHES, dtype=np.uint64) * _U(2) + _U(1)
_MAX = np.iinfo(np.uint64).max


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= VOCABULARY:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _shingle_hashes(words: list[str], seen: _Hashes) -> np.ndarray:
    n = len(words) - K + 1
    if n < 1:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))
    x = np.zeros(n, np.uint64)
    for j in range(K):
        x = x * _U(0x9E3779B97F4A7C15) + h[j : j + n]
    x = (x ^ (x >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(29))


def _ranks(x: np.ndarray) -> np.ndarray:
    return x[None, :] * _ODD[:, None]


def _folded(mins: np.ndarray, by: int) -> np.ndarray:
    """Minima of runs of `by` columns, a power of two."""
    while by > 1:
        if mins.shape[1] % 2:
            mins = np.concatenate([mins, np.full((len(mins), 1), _MAX)], axis=1)
        mins, by = np.minimum(mins[:, ::2], mins[:, 1::2]), by // 2
    return mins


def shingles(words: list[str]) -> set[tuple[str, ...]]:
    return set(zip(*(words[j:] for j in range(K)), strict=False))


def _probes(found: list[tuple]) -> tuple:
    """(bitmap, sorted keys, their items) of (item, keys) pairs."""
    keys = np.concatenate([m for _, m in found])
    at = np.repeat([i for i, _ in found], [len(m) for _, m in found])
    order = np.argsort(keys, kind="stable")
    bitmap = np.zeros(1 << _BITS, bool)
    bitmap[keys & _U((1 << _BITS) - 1)] = True
    return bitmap, keys[order], at[order]


def _probe(x: np.ndarray, probes: tuple, out: set[int]) -> None:
    """Add the items that have one of the values among their keys."""
    bitmap, keys, at = probes
    hit = x[bitmap[x & _U((1 << _BITS) - 1)]]
    if len(hit):
        lo, hi = np.searchsorted(keys, hit, "left"), np.searchsorted(keys, hit, "right")
        for a, b in zip(lo[lo < hi], hi[lo < hi], strict=True):
            out.update(at[a:b].tolist())


@dataclass
class Index:
    """Items with their min-hashes by level; numbers and texts only, so that a broadcast holds about twice the items' bytes."""

    items: list[tuple]  # (id, text, sorted hashes of its distinct shingles)
    levels: dict  # u -> (bitmap, sorted min-hashes, item positions)
    short: tuple | None  # the same of the least shingles of items of up to BLOCK shingles

    @staticmethod
    def of(rows: list[tuple]) -> Index:
        """rows: (id, text). Items of fewer than five words have no shingle and are left out."""
        items, by_level, short, seen = [], {}, [], _Hashes()
        for ident, text in rows:
            w = words_of(text)
            x = np.unique(_shingle_hashes(w, seen))
            if not len(x):
                continue
            if len(x) <= BLOCK:
                short.append((len(items), x[:1]))
                items.append((ident, text, x))
                continue
            u = BLOCK
            while u < len(w) - K + 1:
                u *= 2
            by_level.setdefault(u, []).append((len(items), _ranks(x).min(axis=1)))
            items.append((ident, text, x))
        return Index(items, {u: _probes(found) for u, found in sorted(by_level.items())}, _probes(short) if short else None)

    def candidates(self, x: np.ndarray) -> set[int]:
        """Positions of items that share a min-hash with a window of their level, and of short ones whose least shingle is there."""
        out: set[int] = set()
        if not len(x):
            return out
        if self.short is not None:
            _probe(x, self.short, out)
        if not self.levels:
            return out
        mins, size = _folded(_ranks(x), BLOCK), BLOCK
        for u, level in self.levels.items():
            mins, size = (_folded(mins, u // size), u) if u > size else (mins, size)
            w = np.minimum(mins[:, :-1], mins[:, 1:]) if mins.shape[1] > 1 else mins
            _probe(w, level, out)
        return out

    def hits(self, text: str | None, seen: _Hashes) -> list[tuple]:
        """(item id, shared shingles, item's shingles) of every item contained in a text."""
        w = words_of(text)
        x = _shingle_hashes(w, seen)
        found = self.candidates(x)
        if not found:
            return []
        # Equal shingles have equal hashes: what the hashes rule out is out, what they leave is decided by the words.
        x, own, out = np.unique(x), None, []
        for i in sorted(found):
            ident, item, hashes = self.items[i]
            at = np.minimum(np.searchsorted(x, hashes), len(x) - 1)
            if np.count_nonzero(x[at] == hashes) < CONTAINMENT * len(hashes):
                continue
            own, theirs = own or shingles(w), shingles(words_of(item))
            n = len(theirs & own)
            if n >= CONTAINMENT * len(theirs):
                out.append((ident, n, len(theirs)))
        return out


def _passes(items: DataFrame, id_col: str, text_col: str) -> Iterator[Index]:
    """Indexes of the distinct items, each of a bounded part of them."""
    rows = items.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null").distinct()
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(1, -(-n // PASS_ITEMS), -(-size // PASS_BYTES))
    for p in range(parts):
        got = rows if parts == 1 else rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == p)
        yield Index.of([(r["id"], r["text"]) for r in got.collect()])


def _over(df: DataFrame, index: Index, make: Callable, schema) -> DataFrame:
    small_batches(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, found = _Hashes(), sent.value
        for batch in batches:
            yield make(batch, found, seen)

    return df.mapInArrow(run, schema)


def find_contained(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, shared, item_shingles, containment) for every item of which a document holds 0.8 of the shingles.

    Null and short texts (fewer than five words) hold nothing, and such items
    are in nothing.  Items equal in id and text count once; repeated documents
    give repeated rows.  Extra columns are not read.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kinds = [src.schema["doc_id"].dataType.simpleString(), items.schema[item_id_col].dataType.simpleString()]
    kind = to_arrow_type(items.schema[item_id_col].dataType)
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, shared long, item_shingles long, containment double"

    def make(batch: pa.RecordBatch, index: Index, seen: _Hashes) -> pa.RecordBatch:
        at, rows = [], []
        for i, text in enumerate(batch.column(1).to_pylist()):
            for hit in index.hits(text, seen):
                at.append(i)
                rows.append(hit)
        ids, n, q = (list(c) for c in zip(*rows, strict=True)) if rows else ([], [], [])
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(at, pa.int64())), pa.array(ids, kind), pa.array(n, pa.int64()), pa.array(q, pa.int64()), pa.array([a / b for a, b in zip(n, q, strict=True)], pa.float64())],
            names=["doc_id", "item_id", "shared", "item_shingles", "containment"],
        )

    out = None
    for index in _passes(items, item_id_col, item_text_col):
        part = _over(src, index, make, schema)
        out = part if out is None else out.unionByName(part)
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """docs without the rows that contain an item; all columns pass through, no row is shuffled."""
    place = docs.columns.index(text_col)

    def make(batch: pa.RecordBatch, index: Index, seen: _Hashes) -> pa.RecordBatch:
        return batch.filter(pa.array([not index.hits(t, seen) for t in batch.column(place).to_pylist()], pa.bool_()))

    for index in _passes(items, item_id_col, item_text_col):
        docs = _over(docs, index, make, docs.schema)
    return docs


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of benchmark contained in documents."""
    return find_contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op4_decontaminate": op4_decontaminate}

ORACLE_SQL = {
    "op4_decontaminate": r"""
WITH w AS (SELECT DISTINCT item_id, text, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM benchmark),
i AS (SELECT DISTINCT item_id, text, array_to_string(w[k:k+4], ' ') AS s FROM (SELECT *, unnest(range(1, greatest(len(w) - 3, 1))) AS k FROM w)),
q AS (SELECT item_id, text, count(*) AS n FROM i GROUP BY ALL),
d AS (SELECT rowid AS r, doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM (SELECT row_number() OVER () AS rowid, * FROM documents)),
s AS (SELECT DISTINCT r, doc_id, array_to_string(w[k:k+4], ' ') AS s FROM (SELECT *, unnest(range(1, greatest(len(w) - 3, 1))) AS k FROM d)),
m AS (SELECT r, doc_id, item_id, text, count(*) AS shared FROM s JOIN i USING (s) GROUP BY ALL)
SELECT doc_id, item_id, shared, n AS item_shingles, shared / n::DOUBLE AS containment
FROM m JOIN q USING (item_id, text) WHERE shared >= 0.8 * n
""",
}
