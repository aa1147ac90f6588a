"""Operator 11: near-duplicates by SimHash, candidates pruned by pigeonring chains.

A text's fingerprint has a bit set if more than half of its shingles' hashes
have it set.  The 64 bits lie on a ring of 16 segments of four bits.  If two
fingerprints differ in at most three bits, then from some segment on the
differences of the first l segments stay within 3 * l / 16 for every l
(pigeonring): none in the first five segments, at most one in the first ten, at
most two in the first fifteen.  The first five segments from each of the 16
starts are the join key; the next bounds prune pairs before the full distance is
taken.  A bucket with too many fingerprints is divided by further bits, of which, by
the same bounds, one part of a few must agree.  What is still too large then holds
many fingerprints that differ in few bits; it is compared in blocks, every two of
which meet.  Nothing is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, join_on_hot_key, small_batches, table
from .components import connected_components

SHINGLE = 3
SEED = 42
DIFFERENT = 3
SEGMENTS, WIDTH = 16, 4
#: Segments after which a chain's budget grows: (segments, most differences until then).
CHAIN = ((5, 0), (10, 1), (15, 2), (16, 3))
#: Fingerprints of one bucket that one task compares with one another; larger buckets are divided.
BUCKET = 2048
#: Rows of whole buckets, and pairs, that numpy works on at once.
HELD = 1 << 16
CHUNK = 1 << 20

#: What the fingerprints of a bucket share: the chain's start, the bits that agree, and their values.
BUCKET_KEY = ["start", "mask", "part"]
CELL_KEY = [*BUCKET_KEY, "cell"]

_U = np.uint64
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)[:, ::-1].astype(np.int64)


def _ones(start: int, bits: int) -> int:
    """A mask of that many bits from bit start on, counted from the highest."""
    return ((1 << bits) - 1) << (64 - start - bits)


def shingle_hashes(words: list[bytes]) -> np.ndarray:
    """XXH64 of every run of SHINGLE words, space-joined; fewer words are one run, none has no hash."""
    if not words:
        return np.empty(0, np.uint64)
    line, h = b" ".join(words), xxhash.xxh64_intdigest
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-SHINGLE]]
    return np.fromiter((h(line[a : b - 1], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :] or ends[-1:])), np.uint64)


def fingerprint(text: bytes | None) -> int:
    """Unsigned 64-bit fingerprint of a text in UTF-8; 0 if it has no words."""
    x = shingle_hashes((text or b"").lower().split())  # bytes know ASCII letters and ASCII white space only
    if not len(x):
        return 0
    if len(x) < 256:
        ones = np.unpackbits(x.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        columns = x.astype("<u8").view(np.uint8).reshape(-1, 8).T
        ones = np.concatenate([np.bincount(c, minlength=256) @ _BITS for c in columns])
    return int(np.packbits(2 * ones > len(x), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) for every row of docs, fp as a signed long."""
    small_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py()) for t in b.column("text")), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(fp.view(np.int64))], names=["id", "fp"])

    return src.mapInArrow(run, T.StructType([T.StructField("id", src.schema["id"].dataType), T.StructField("fp", T.LongType())]))


def _divided(mask: int, parts: int) -> list[int]:
    """The set bits of mask, from the highest, in so many runs of nearly equal length."""
    bits = [1 << i for i in reversed(range(64)) if mask >> i & 1]
    return [sum(x) for x in np.array_split(np.array(bits, object), parts) if len(x)]


def masks() -> list[dict[int, list[int]]]:
    """For each step of a bucket's division, from a mask of a rotated fingerprint to those that divide its buckets.

    The chain's first five segments agree.  The next five hold at most one difference, so
    one of their halves agrees; with the five after these there are at most two,
    so one of three parts agrees.
    """
    first, second, third = (_ones(20 * i, 20) for i in range(3))
    halves = {first: [first | m for m in _divided(second, 2)]}
    return [halves, {m: [m | t for t in _divided(third, 3)] for m in halves[first]}]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def chain_pairs(r: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (x, y) of places in r, rotated fingerprints, whose chain stays within every budget."""
    for segments, most in CHAIN:
        mask = _U(_ones(0, segments * WIDTH))
        ok = np.bitwise_count((r[x] ^ r[y]) & mask) <= most
        x, y = x[ok], y[ok]
    return x, y


def least_reachable(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node that the links (x, y) lead to."""
    label = np.arange(n)
    while len(x):
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        while not np.array_equal(label, up := label[label]):
            label = up
        apart = label[x] != label[y]
        x, y = x[apart], y[apart]
    return label


def forest(key: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, root) for rows sorted by key: rows of one key that are linked, directly or by others, and their first one."""
    edge = np.r_[0, np.flatnonzero(key[1:] != key[:-1]) + 1, len(key)]
    size = np.diff(edge)
    behind = np.repeat(edge[1:], size) - np.arange(len(key)) - 1  # rows of its key behind each row
    total, label, lo = np.cumsum(behind), np.arange(len(key)), 0
    while lo < len(key):
        done = total[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, done + CHUNK, "right")))
        m = behind[lo:hi]
        x = np.repeat(np.arange(lo, hi), m)
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(m) - m, m)
        lo, new = hi, label[x] != label[y]
        x, y = chain_pairs(r, x[new], y[new])
        if len(x):
            join = least_reachable(len(key), label[x], label[y])
            label = join[label]
    at = np.flatnonzero(label != np.arange(len(key)))
    return at, label[at]


def _linked(rows: DataFrame) -> DataFrame:
    """(a, b): for rows (CELL_KEY, r), few of a key, pairs that join what the links of each key's rows join."""
    spread = rows.select(*CELL_KEY, "r").repartition(*CELL_KEY).sortWithinPartitions(*CELL_KEY)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, held_rows = [], 0

        def found(done: pd.DataFrame) -> pd.DataFrame:
            key = done.groupby(CELL_KEY, sort=False).ngroup().to_numpy()
            r, start = done["r"].to_numpy().view(np.uint64), done["start"].to_numpy().astype(np.uint64) * _U(WIDTH)
            at, root = forest(key, r)
            fp = (r >> start) | (r << ((_U(64) - start) % _U(64)))  # turned back
            fp = np.where(start == 0, r, fp).view(np.int64)
            return pd.DataFrame({"a": fp[at], "b": fp[root]})

        for pdf in batches:
            held.append(pdf)
            held_rows += len(pdf)
            if held_rows < HELD:
                continue
            pdf = pd.concat(held, ignore_index=True)
            last = pdf[CELL_KEY].iloc[-1]
            open_ = (pdf[CELL_KEY] == last).all(axis=1).to_numpy()
            if not open_.all():
                yield found(pdf[~open_])
            held, held_rows = [pdf[open_]], int(open_.sum())
        if held_rows:
            yield found(pd.concat(held, ignore_index=True))

    return spread.mapInPandas(run, "a long, b long")


def fingerprint_links(fps: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b): pairs of the distinct fingerprints fps (fp) that join exactly those which links of at most DIFFERENT bits join."""
    starts = fps.select("fp", F.explode(F.array(*(F.lit(i) for i in range(SEGMENTS)))).alias("start"))
    rotated = starts.select("start", F.expr(f"shiftleft(fp, start * {WIDTH}) | IF(start = 0, 0L, shiftrightunsigned(fp, 64 - start * {WIDTH}))").alias("r"))
    rows = rotated.withColumn("mask", F.lit(_signed(_ones(0, CHAIN[0][0] * WIDTH))))
    out = None
    for divided in (*masks(), None):
        rows = rows.withColumn("part", F.col("r").bitwiseAND(F.col("mask")))
        sizes = scratch.keep(rows.groupBy(BUCKET_KEY).agg(F.count("*").alias("size")).where("size > 1"))
        sized = scratch.keep(join_on_hot_key(rows, sizes, BUCKET_KEY, "size"))
        scratch.drop(sizes)
        links = scratch.keep(_linked(sized.where(F.col("size") <= BUCKET).withColumn("cell", F.lit(0))).distinct())
        out = links if out is None else out.unionByName(links)
        large = sized.where(F.col("size") > BUCKET)
        if large.isEmpty():
            return out
        if divided:
            by_mask = F.create_map(*(x for m, cs in divided.items() for x in (F.lit(_signed(m)), F.array(*(F.lit(_signed(c)) for c in cs)))))
            rows = large.select("start", "r", F.explode(by_mask[F.col("mask")]).alias("mask"))
    return out.unionByName(scratch.keep(_linked(_cells(large, out, scratch)).distinct()))


def _cells(large: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of large buckets whose fingerprints the links leave apart, dealt to cells of every two blocks of a bucket."""
    labels = connected_components(links, scratch=scratch).withColumnRenamed("node", "fp")
    turned = F.expr(f"shiftrightunsigned(r, start * {WIDTH}) | IF(start = 0, 0L, shiftleft(r, 64 - start * {WIDTH}))")
    known = large.withColumn("fp", turned).join(labels, "fp", "left").withColumn("c", F.coalesce("label", "fp"))
    apart = known.groupBy(BUCKET_KEY).agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("n")).where("lo <> hi")
    rows = join_on_hot_key(large, scratch.keep(apart), BUCKET_KEY, "n")
    blocks = F.ceil(F.col("size") * 2 / BUCKET).cast("int")  # two at least
    block = F.pmod(F.xxhash64("r"), blocks).cast("int")
    met = rows.select(*BUCKET_KEY, "r", block.alias("block"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other")).where("block <> other")
    return met.select(*BUCKET_KEY, "r", (F.greatest("block", "other").cast("long") * 2**31 + F.least("block", "other")).alias("cell"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id), a row for each row of docs.

    fingerprint has 16 lower-case hex digits, component_id is the least id among
    the rows that links of at most DIFFERENT bits lead to, the row itself included; equal
    fingerprints are linked.  Null texts and those without words have fingerprint
    zero, which links like any other.  Null ids are never the least, unless all are null.
    Repeated rows stay.  Texts are read whole.  Empty input gives an empty
    result; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession)
    rows = scratch.keep(fingerprints(docs, id_col, text_col))
    distinct = scratch.keep(rows.groupBy("fp").agg(F.count("*").alias("n"), F.min("id").alias("least")))
    links = fingerprint_links(distinct.select("fp"), scratch)
    labels = connected_components(links, scratch=scratch)
    labelled = distinct.join(labels, distinct["fp"] == labels["node"], "left").select("fp", "n", "least", F.coalesce("label", "fp").alias("c"))
    least = labelled.groupBy("c").agg(F.min("least").alias("component_id"))
    by_fp = scratch.keep(labelled.join(least, "c").select("fp", "n", "component_id"))
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return join_on_hot_key(rows, by_fp, ["fp"], "n").select("id", hexed.alias("fingerprint"), "component_id")


def op11_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash components of all documents."""
    return simhash_components(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


QUERIES = {"op11_simhash_pigeonring": op11_simhash_pigeonring}
ORACLE_SQL: dict[str, str] = {}
