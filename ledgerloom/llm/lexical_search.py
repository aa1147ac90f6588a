"""Operator 12: ranked lexical search as a blocked product of sparse integer matrices.

A: items x terms, how often an item has a term.  B: terms x documents, a term's
int64 impact in a document.  The rows of A*B are the scores.  Documents go
through in blocks; in a block numpy merges, for each item, the rows of B that the
item's row of A names (Gustavson), and only the best documents of an item leave it.
The best of all blocks are reduced task by task, then in two steps by item.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, small_batches, table

TOP = 10
#: Bytes of item texts that go through the documents together (a hash deals items to passes, so this holds on average).
PASS_BYTES = 32 << 20
#: Term occurrences of a block of documents, and rows of best documents that a task holds before it reduces them.
BLOCK = 1 << 20
HELD = 1 << 18
#: Groups in which an item's documents from all tasks are reduced first.
GROUPS = 256

_LETTERS = np.arange(256, dtype=np.uint8)
_LETTERS[:128] = [ord(chr(c).lower()) if chr(c).isalnum() else 32 for c in range(128)]
_TABLE = _LETTERS.tobytes()


def terms_of(text: bytes | None) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and non-ASCII characters of a text in UTF-8, with A-Z lower-cased."""
    return text.translate(_TABLE).split() if text else []


def _term_rows(items: DataFrame) -> DataFrame:
    """(item_id, text, term, times) for the distinct items; an item without terms has no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, terms, times = [], [], []
            for i, text in enumerate(b.column("text").cast(pa.binary()).to_pylist()):
                t, n = np.unique(np.array(terms_of(text), object), return_counts=True)
                at += [i] * len(t)
                terms += t.tolist()
                times += n.tolist()
            yield pa.RecordBatch.from_arrays([b.column("item").take(pa.array(at, pa.int64())), pa.array(terms, pa.binary()), pa.array(times, pa.int64())], names=["item", "term", "times"])

    return items.select("item", "text").mapInArrow(run, "item long, term binary, times long")


def sparse_documents(docs: DataFrame, vocabulary: list[bytes], id_col: str, text_col: str) -> DataFrame:
    """(id, n, terms, tf): number of terms, and of those in the vocabulary the places (ascending) and occurrences."""
    small_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {t: i for i, t in enumerate(sent.value)}
        for b in batches:
            n, ends, terms, tf = [], [0], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for text in b.column("text"):
                own = terms_of(text.as_py())
                found = np.fromiter((p for p in map(place.get, own) if p is not None), np.int64)
                t, c = np.unique(found, return_counts=True)
                n.append(len(own))
                ends.append(ends[-1] + len(t))
                terms.append(t)
                tf.append(c)
            ends = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x).astype(kind))) for x, kind in ((terms, np.int32), (tf, np.int64))]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n, pa.int64()), *lists], names=["id", "n", "terms", "tf"])

    schema = T.StructType([
        T.StructField("id", src.schema["id"].dataType), T.StructField("n", T.LongType()),
        T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("tf", T.ArrayType(T.LongType())),
    ])
    return src.mapInArrow(run, schema)


def weights(df: np.ndarray, documents: int) -> np.ndarray:
    """floor(1000 * ln((2 N + 2) / (2 df + 1))) of each term."""
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(d) + 1))) for d in df], np.int64)


def length_factors(n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """100 - 75 + (75 * n * N) div L of each document length n; exact also where 75 * n * N is above 64 bits."""
    if len(n) and 75 * int(n.max()) * documents >= 2**63:
        return np.array([25 + 75 * int(x) * documents // terms for x in n], np.int64)
    return 25 + 75 * n * documents // max(terms, 1)


class ItemMatrix:
    """Rows of A: of item i the terms at ptr[i]:ptr[i + 1], with times their occurrences."""

    def __init__(self, item: np.ndarray, term: np.ndarray, times: np.ndarray, items: int) -> None:
        order = np.lexsort((term, item))
        self.term, self.times = term[order], times[order]
        self.ptr = np.searchsorted(item[order], np.arange(items + 1))

    def product(self, ptr: np.ndarray, documents: np.ndarray, impact: np.ndarray, size: int) -> Iterator[tuple[int, np.ndarray]]:
        """(item, scores of the block's documents) for items with a term in the block.

        Row t of B has documents[ptr[t]:ptr[t + 1]], each once, and their impacts.
        """
        filled = np.diff(ptr) > 0
        for i in range(len(self.ptr) - 1):
            own = slice(self.ptr[i], self.ptr[i + 1])
            some = filled[self.term[own]]
            if not some.any():
                continue
            acc = np.zeros(size, np.int64)
            for t, times in zip(self.term[own][some], self.times[own][some]):
                row = slice(ptr[t], ptr[t + 1])
                acc[documents[row]] += times * impact[row]
            yield i, acc


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores above 0, equal ones by place."""
    at = np.flatnonzero(scores > 0)
    if len(at) > k:
        least = np.partition(scores[at], len(at) - k)[len(at) - k]
        at = at[scores[at] >= least]
    return at[np.argsort(-scores[at], kind="stable")[:k]]


def _reduced(t: pa.Table, k: int) -> pa.Table:
    """The k best rows of each item: highest score, then least id, nulls last."""
    t = t.take(pc.sort_indices(t, sort_keys=[("item", "ascending"), ("score", "descending"), ("id", "ascending")]))
    item = t.column("item").to_numpy()
    first = np.flatnonzero(np.r_[True, item[1:] != item[:-1]]) if len(item) else np.empty(0, np.int64)
    within = np.arange(len(item)) - np.repeat(first, np.diff(np.r_[first, len(item)]))
    return t.filter(pa.array(within < k))


def _best_of_blocks(sparse: DataFrame, a: tuple, number: np.ndarray, w: np.ndarray, documents: int, terms: int, k: int) -> DataFrame:
    """(item, id, score): of every task's documents the k best of each item; number names the rows of A."""
    sent = sparse.sparkSession.sparkContext.broadcast((a, number, w))
    schema = T.StructType([T.StructField("item", T.LongType()), sparse.schema["id"], T.StructField("score", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, names, weight = sent.value
        matrix, kept = ItemMatrix(*rows, len(names)), None

        def block(parts: list[pa.RecordBatch]) -> pa.Table:
            t = pa.Table.from_batches(parts).sort_by("id")  # places follow ids, nulls last
            t = t.combine_chunks()
            ids, lists = t.column("id"), t.column("terms").combine_chunks()
            lengths = lists.value_lengths().to_numpy()
            term, tf = lists.flatten().to_numpy(), t.column("tf").combine_chunks().flatten().to_numpy()
            doc = np.repeat(np.arange(t.num_rows), lengths)
            m = length_factors(t.column("n").to_numpy(), documents, terms)
            impact = weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
            order = np.argsort(term, kind="stable")
            ptr = np.searchsorted(term[order], np.arange(len(weight) + 1))
            item, place, score = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for i, acc in matrix.product(ptr, doc[order], impact[order], t.num_rows):
                at = best(acc, k)
                item.append(np.full(len(at), names[i]))
                place.append(at)
                score.append(acc[at])
            return pa.table({"item": np.concatenate(item), "id": ids.take(pa.array(np.concatenate(place))), "score": np.concatenate(score)})

        parts, size = [], 0
        for b in batches:
            parts.append(b)
            size += len(b.column("terms").flatten()) + b.num_rows
            if size >= BLOCK:
                kept, parts, size = (block(parts) if kept is None else pa.concat_tables([kept, block(parts)])), [], 0
                if kept.num_rows > HELD:
                    kept = _reduced(kept, k)
        if parts:
            kept = block(parts) if kept is None else pa.concat_tables([kept, block(parts)])
        if kept is not None:
            yield from _reduced(kept, k).to_batches()

    return sparse.mapInArrow(run, schema)


def lexical_top(
    items: DataFrame, docs: DataFrame, item_id: str = "item_id", item_text: str = "text", doc_id: str = "doc_id", doc_text: str = "text", k: int = TOP,
) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents with a score above 0, equal scores by ascending doc_id.

    Null and empty texts have no terms; they are never found and find nothing.
    Documents without terms don't count in the statistics.  Every row of docs is a
    document of its own, so repeated rows tie and take a rank each; a null doc_id
    comes last among equal scores.  Items equal in id and text are one item; items of one
    id with other texts, and null ids, are ranked on their own.  Texts are read whole.  Other
    columns are not read.  Items go through the documents in passes of about
    PASS_BYTES of text; the matrix of a pass and one pass's term counts are all that
    the driver holds.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    own = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).where("text is not null").distinct()
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(1, -(-int(size) // PASS_BYTES))
    own = scratch.keep(own.withColumn("pass", F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)).cast("int")).withColumn("item", F.monotonically_increasing_id()))
    terms = scratch.keep(_term_rows(own).join(own.select("item", "pass"), "item"))
    out, stats = None, None
    for p in range(passes):
        a = terms.where(F.col("pass") == p).select("item", "term", "times").toPandas()
        if a.empty:
            continue
        number, vocabulary = np.unique(a["item"].to_numpy()), sorted({bytes(t) for t in a["term"]})
        place = {t: i for i, t in enumerate(vocabulary)}
        rows = (np.searchsorted(number, a["item"].to_numpy()), np.array([place[bytes(t)] for t in a["term"]], np.int64), a["times"].to_numpy())
        sparse = scratch.keep(sparse_documents(docs, vocabulary, doc_id, doc_text).where("n > 0"))
        stats = stats or sparse.agg(F.count("*"), F.sum("n")).first()
        df = np.zeros(len(vocabulary), np.int64)
        for t, c in sparse.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
            df[t] = c
        found = scratch.keep(_best_of_blocks(sparse, rows, number, weights(df, stats[0]), stats[0], stats[1] or 0, k))
        scratch.drop(sparse)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], T.StructType([docs.select(F.col(doc_id).alias("id")).schema["id"], T.StructField("score", T.LongType()), T.StructField("item", T.LongType())]))
    order = [F.desc("score"), F.asc_nulls_last("id")]
    # What the tasks found meets in groups first, so that no item's rows of all tasks meet in one.
    part = Window.partitionBy("item", "part").orderBy(*order)
    out = out.withColumn("part", F.pmod(F.xxhash64("id", "score"), F.lit(GROUPS))).withColumn("r", F.row_number().over(part)).where(F.col("r") <= k)
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    return out.join(own.select("item", "item_id"), "item").select("item_id", "rank", F.col("id").alias("doc_id"), "score")


def op12_sparse_product_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all documents for each benchmark item."""
    return lexical_top(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


QUERIES = {"op12_sparse_product_search": op12_sparse_product_search}

ORACLE_SQL = {
    "op12_sparse_product_search": r"""
WITH t AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ts FROM documents),
i AS (SELECT item_id, row_number() OVER () AS i, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)),
a AS (SELECT i, item_id, term, count(*) AS times FROM i GROUP BY ALL),
d AS (SELECT r, doc_id, len(ts) AS n, ts FROM t WHERE len(ts) > 0),
s AS (SELECT count(*) AS nd, sum(n)::BIGINT AS l FROM d),
b AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(ts) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM b, s WHERE term IN (SELECT term FROM a) GROUP BY term, nd),
p AS (SELECT i, item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nd) // l))))::BIGINT AS score FROM a JOIN w USING (term) JOIN b USING (term), s GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score FROM p WHERE score > 0 QUALIFY rank <= 10
""",
}
