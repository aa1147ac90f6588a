"""Operator 2 [native]: weighted rendezvous sharding of stable record keys.

Every shard draws a hash-uniform number u for a key and bids -weight / ln(u);
the highest bid wins.  A key's bids for the old shards do not change when a
shard is added, so only rows that the new shard wins move.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, table, text_or_empty

#: Leading hex digits of a key's hash that name its counting bucket, and parts of it by the text's hash (16**3 * 16 per shard).
BUCKET_DIGITS = 3
PARTS = 16


def _bid(key: Column, shard: int, weight: float) -> Column:
    h = F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{shard}"))), 1, 13), 16, 10).cast("double")
    return F.lit(float(weight)) / -F.ln((h + F.lit(0.5)) / F.lit(float(2**52)))


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard (0-based int) that wins key (string) among the weighted shards.

    A weight of 0 never wins unless all are 0; equal bids go to the lowest
    shard.  The key must not be null.
    """
    if not weights or any(w < 0 for w in weights):
        raise ValueError("weights must be non-negative and at least one")
    bids = F.array(*(F.struct(_bid(key, s, w).alias("bid"), F.lit(-s).alias("s")) for s, w in enumerate(weights)))
    return (-F.array_max(bids)["s"]).cast("int")


def shard_documents(
    docs: DataFrame, weights: Sequence[float], id_col: str = "doc_id", text_col: str = "text", grown_weight: float = 1.0,
    names: tuple[str, str, str] = ("shard", "slot", "grown_shard"), tie: Column | None = None,
) -> DataFrame:
    """docs with three more columns: shard, slot (gapless from 0 in a shard) and grown_shard.

    shard depends on id_col and the weights alone; grown_shard is the shard
    after one more of grown_weight joins.  A null id is the key ''.  Slots
    follow (hash bucket of the key, part by tie, id, tie); tie is a long, by
    default the hash of the text, null texts being empty and long ones read
    whole.  Rows equal in all of these are interchangeable.  Slots come from
    counts per (shard, bucket, part), at most 16**3 * PARTS a shard, plus a rank
    inside a part, so that no shard is ever sorted in one task, nor are the
    different texts of one repeated key.  Empty input gives an empty result;
    extra columns pass through, and columns of docs named like a new one are
    replaced.
    """
    shard, slot, grown = names
    tie = F.xxhash64(text_or_empty(text_col)) if tie is None else tie
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    bucket, part, order, first = (fresh(docs, n) for n in ("_bucket", "_part", "_order", "_first"))
    own = {shard: shard_of(key, weights), bucket: F.substring(F.md5(key), 1, BUCKET_DIGITS), part: F.pmod(tie, F.lit(PARTS)).cast("int")}
    counted = docs.select(*(c.alias(n) for n, c in own.items())).groupBy(shard, bucket, part).agg(F.count("*").alias(first))
    # Computed before a column of docs that is named like a new one goes.
    placed = docs.select(*(c for c in docs.columns if c.lower() not in {n.lower() for n in names}), *(c.alias(n) for n, c in own.items()), shard_of(key, [*weights, grown_weight]).alias(grown), tie.alias(order))
    before = Window.partitionBy(shard).orderBy(bucket, part).rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.withColumn(first, F.coalesce(F.sum(first).over(before), F.lit(0)))
    inside = Window.partitionBy(shard, bucket, part).orderBy(id_col, order)
    return (
        placed.join(counted, [shard, bucket, part])
        .withColumn(slot, (F.col(first) + F.row_number().over(inside) - 1).cast("long"))
        .select(*(c for c in docs.columns if c.lower() not in {n.lower() for n in names}), shard, slot, grown)
    )


def op2_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into 16 equal shards under the law `key`."""
    t = text_or_empty()
    slim = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(F.encode(t, "utf-8")).alias("text_crc32"),
    )
    return shard_documents(slim, [1.0] * 16, tie=F.col("text_crc32")).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


QUERIES = {"op2_rendezvous_sharding": op2_rendezvous_sharding}

CRC32 = """
WITH crc AS (SELECT list(c ORDER BY n) AS tab FROM (SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) t(n))),
d AS (SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS k, octet_length(encode(coalesce(text, ''))) + 1 AS size, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS h FROM documents),
b AS (SELECT doc_id, k, size, xor(list_reduce(list_prepend(4294967295, list_transform(h, lambda x: ((instr('0123456789ABCDEF', x[1]) - 1) * 16 + instr('0123456789ABCDEF', x[2]) - 1)::BIGINT)), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32 FROM d, crc)"""

ORACLE_SQL = {
    "op2_rendezvous_sharding": CRC32 + """,
u AS (SELECT k, s, 1.0 / -ln((('0x' || substr(md5(k || ':' || s), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0) AS bid FROM (SELECT DISTINCT k FROM b), range(17) r(s)),
w AS (SELECT k, arg_max(s, (bid, -s)) FILTER (s < 16)::INTEGER AS shard, arg_max(s, (bid, -s))::INTEGER AS grown_shard FROM u GROUP BY k)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY substr(md5(k), 1, 3), text_crc32 % 16, doc_id NULLS FIRST, text_crc32) - 1 AS slot, grown_shard FROM b JOIN w USING (k)
""",
}
