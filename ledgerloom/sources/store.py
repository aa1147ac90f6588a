"""The project store as partitioned Parquet: ingest with duplicate detection, upsert, cascading delete, export and import."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables and the columns that name their rows and owners.
TABLES = {"documents": "id", "sections": "id", "records": "id"}


class Store:
    """Tables below one folder, partitioned by project.

    A write goes to a new version folder first.  What points to it is a file
    whose name is a number one above the last and that holds the folders of all
    tables; it is made last, complete and by one rename that fails if another
    writer was faster.  Readers take the file of the greatest number: they see
    the old or the new version of every table, never none, and a lost job leaves
    the old one in place.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _current(self) -> tuple[int, dict[str, str]]:
        """(number, table -> version) of the last commit."""
        fs, p = self._fs(f"{self.root}/_commits")
        names = [str(x.getPath().getName()) for x in fs.listStatus(p)] if fs.exists(p) else []
        numbers = [int(n) for n in names if n.isdigit()]
        if not numbers:
            return 0, {}
        return max(numbers), json.loads(self.spark.read.text(f"{self.root}/_commits/{max(numbers):012d}", wholetext=True).first()[0])

    def _version(self, table: str) -> str | None:
        return self._current()[1].get(table)

    def read(self, table: str, project: str | None = None) -> DataFrame | None:
        v = self._version(table)
        if v is None:
            return None
        df = self.spark.read.parquet(f"{self.root}/{table}/{v}")
        return df if project is None else df.where(F.col("project_id") == project)

    def write(self, table: str, df: DataFrame) -> None:
        """Replace a table by df, in one step for its readers."""
        self.write_all({table: df})

    def write_all(self, tables: dict[str, DataFrame]) -> None:
        """Replace several tables, in one step for their readers; fails if another writer committed meanwhile."""
        number, known = self._current()
        v = uuid.uuid4().hex
        for table, df in tables.items():
            df.write.partitionBy("project_id").parquet(f"{self.root}/{table}/{v}")
        fs, folder = self._fs(f"{self.root}/_commits")
        fs.mkdirs(folder)
        _, tmp = self._fs(f"{self.root}/_commits/.{v}")
        out = fs.create(tmp, True)
        out.write(bytearray(json.dumps(known | dict.fromkeys(tables, v)).encode()))
        out.close()
        _, now = self._fs(f"{self.root}/_commits/{number + 1:012d}")
        # A plain rename onto a file that exists is false or an error, depending on the file system.
        if fs.exists(now) or not fs.rename(tmp, now):
            fs.delete(tmp, False)
            raise RuntimeError(f"{self.root} was written by another job; read it again")

    def put(self, table: str, rows: DataFrame) -> None:
        """Insert rows or replace those of equal key."""
        key, old = TABLES[table], self.read(table)
        self.write(table, rows if old is None else rows.unionByName(old.join(rows.select(key), key, "left_anti"), allowMissingColumns=True))

    def remove_documents(self, ids: DataFrame) -> None:
        """Delete documents and all that belongs to them, in one step."""
        gone, left = ids.select("id").distinct(), {}
        for table in TABLES:
            t = self.read(table)
            col = "id" if table == "documents" else "document_id"
            if t is not None and col in t.columns:
                left[table] = t.join(gone.withColumnRenamed("id", col), col, "left_anti")
        if left:
            self.write_all(left)


def with_fingerprint(files: DataFrame, content_col: str = "content") -> DataFrame:
    return files.withColumn("fingerprint", F.sha2(content_col, 256))


def ingest_actions(incoming: DataFrame, known: DataFrame) -> DataFrame:
    """incoming (id, name, fingerprint) with action and existing id: skip (same content), replace (same name), import.

    Files repeated inside the batch are skipped after their first one.
    """
    k = known.groupBy("fingerprint").agg(F.min("id").alias("same_id"))
    n = known.groupBy("name").agg(F.min("id").alias("name_id"))
    first = incoming.groupBy("fingerprint").agg(F.min("id").alias("first_id"))
    j = incoming.join(k, "fingerprint", "left").join(n, "name", "left").join(first, "fingerprint")
    action = F.when(F.col("same_id").isNotNull(), "skip").when(F.col("first_id") != F.col("id"), "skip").when(F.col("name_id").isNotNull(), "replace").otherwise("import")
    return j.select("id", "name", "fingerprint", action.alias("action"), F.coalesce("same_id", F.when(F.col("first_id") != F.col("id"), F.col("first_id")), "name_id").alias("existing_id"))


def import_issues(tables: dict[str, DataFrame], project: str) -> DataFrame:
    """(table, issue, n) before an import: repeated ids, rows of other projects, sections of unknown documents."""
    out = None
    for name, df in tables.items():
        rows = [("repeated-id", df.groupBy("id").count().where("count > 1")), ("foreign-project", df.where(F.col("project_id") != project))]
        if name == "sections":
            rows.append(("unknown-document", df.join(tables["documents"].select(F.col("id").alias("document_id")), "document_id", "left_anti")))
        for issue, bad in rows:
            one = bad.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), F.lit(issue).alias("issue"), "n")
            out = one if out is None else out.unionByName(one)
    return out


def export_json(tables: dict[str, DataFrame], path: str) -> None:
    """One folder of JSON lines a table."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def import_json(spark: SparkSession, path: str, schemas: dict) -> dict[str, DataFrame]:
    return {name: spark.read.schema(schema).json(f"{path}/{name}") for name, schema in schemas.items()}


DOCUMENT_ROLES = [("drawing", r"drawing|plan|sheet|elevation"), ("specification", r"spec|section|division"), ("schedule", r"schedule|gantt|programme"), ("submittal", r"submittal|shop"), ("report", r"report|minutes|log")]


def document_role(name, category, explicit):
    """Explicit role, else by category, else by file name, else `document`."""
    by = lambda c: F.coalesce(*(F.when(F.lower(F.coalesce(c, F.lit(""))).rlike(p), r) for r, p in DOCUMENT_ROLES))
    return F.coalesce(F.when(explicit != "", explicit), by(category), by(name), F.lit("document"))
