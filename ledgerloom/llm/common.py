"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch handed to Python: bounds a worker's memory whatever the partition holds.
ARROW_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch, unless the session asks for fewer already."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def give_back() -> None:
    """Return memory that was freed to the system; a Python worker would keep it while idle."""
    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or where that is unset one of our own, in local mode only."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir", None)
        if not folder and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="loom-ckpt-"))
    return sc._jsc.sc().getCheckpointDir().get()


class Scratch:
    """Intermediate tables as compressed Parquet in the shared folder: they cut lineage and survive lost executors.

    What is not dropped before is deleted when the application ends.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.root = spark, f"{shared_folder(spark)}/loom-{uuid.uuid4().hex}"
        self.kept: list[tuple[DataFrame, str]] = []
        self.named: dict[str, str] = {}
        path, fs = self._place(self.root)
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def _place(self, name: str) -> tuple:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def keep(self, df: DataFrame) -> DataFrame:
        name = f"{self.root}/{len(self.kept)}"
        df.write.option("compression", "zstd").parquet(name)
        out = self.spark.read.schema(df.schema).parquet(name)
        self.kept.append((out, name))
        return out

    def keep_by(self, df: DataFrame, key: str) -> DataFrame:
        """Like keep(), in as many buckets by key as shuffles have partitions: joins on key leave these rows where they are."""
        name, n = f"{self.root}/{len(self.kept)}", int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        table = "loom_" + uuid.uuid4().hex
        df.repartition(n, key).write.format("parquet").option("compression", "zstd").option("path", name).bucketBy(n, key).sortBy(key).saveAsTable(table)
        out = self.spark.table(table)
        self.kept.append((out, name))
        self.named[name] = table
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        """Delete tables that keep() returned and that nothing reads any more."""
        for t in tables:
            for kept, name in self.kept:
                if t is kept:
                    if name in self.named:
                        self.spark.sql(f"DROP TABLE IF EXISTS {self.named.pop(name)}")
                    path, fs = self._place(name)
                    fs.delete(path, True)

    def free(self) -> None:
        """Let Spark delete the shuffle files of finished jobs that nothing refers to."""
        for _ in range(2):  # Python's references go first, then those of the JVM's plans
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
            time.sleep(0.3)


def checkpointed(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and read it from there.

    The folder is the session's spark.checkpoint.dir; only where that is unset
    (local tests) a folder of our own is made.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def text_or_empty(c: Column | str = "text") -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


#: Bits of one row of a bitmap.
BITMAP = 8 * 4096


def likely_in(rows: DataFrame, members: DataFrame, *key: str, bits: int = 16) -> DataFrame:
    """The rows whose key, columns that both tables have, is in members, and about one in `bits` of the others: those that a join would drop are not shuffled for it.

    Members set bits of a bitmap that is broadcast, `bits` of them for each member; members is read twice.
    """
    size = BITMAP * max(1, -(-members.count() * bits // BITMAP))
    at = F.pmod(F.xxhash64(*key), F.lit(size)) + 1
    at_name, bucket, found = fresh(rows, "_at"), fresh(rows, "_bucket"), fresh(rows, "_bits")
    maps = members.select(at.alias(at_name)).groupBy(F.bitmap_bucket_number(at_name).alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at_name)).alias(found))
    place = F.bitmap_bit_position(at_name)
    byte = F.conv(F.hex(F.substring(F.col(found), (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    met = rows.withColumn(at_name, at).withColumn(bucket, F.bitmap_bucket_number(at_name)).join(F.broadcast(maps), bucket)
    return met.where(F.getbit(byte, (place % 8).cast("int")) == 1).select(*rows.columns)


#: A key is hot if it has more than one in so many of all rows; there are fewer hot keys than this.
HOT = 1000


def join_on_hot_key(rows: DataFrame, values: DataFrame, key: list[str], count: str) -> DataFrame:
    """rows with the columns of values, which has one row a key and in count the number of its rows; both must be kept tables.

    Keys with more than one in HOT of all rows, fewer than HOT by this bound, are
    broadcast, so that their rows stay where they are; the others are shuffled.
    Rows whose key values lacks, and null keys, go.
    """
    total = values.agg(F.sum(count)).first()[0] or 0
    hot = values.where(F.col(count) * HOT > total)
    return rows.join(F.broadcast(hot), key).unionByName(
        rows.join(F.broadcast(hot.select(*key)), key, "left_anti").join(values.where(F.col(count) * HOT <= total), key)
    )
