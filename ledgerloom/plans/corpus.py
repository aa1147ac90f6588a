"""Records for queries: literal rows of known cases, and beside them rows made of the tables.

The tables don't hold sheets, clauses or requirements.  Records of such kinds are
made of them by SQL that Spark and DuckDB both read (`Rows.more`): each table row
gives a record, so that queries run over whole tables; the literal rows hold the
cases that tables don't.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


class Session:
    """A Spark session with the folder of the tables that a query reads."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str):
        return getattr(self.spark, name)


class Rows(list):
    """Literal rows, and a query for more of the same columns; {name} stands for a table, LIST[...] for an array."""

    def __init__(self, rows: list, more: str) -> None:
        super().__init__(rows)
        self.more = more


def _tables(query: str, spell) -> str:
    return re.sub(r"\{(\w+)\}", lambda m: spell(m[1]), query)


SECTION_SCHEMA = (
    "id string, document_id string, parent_id string, heading string, path array<string>, section_number string, level int, ord int, page_start int, page_end int, text string, cross_references array<string>"
)
SECTIONS = Rows([
    ("s1", "d1", None, "01 45 00 Quality Control", ["01 45 00 Quality Control"], "01 45 00", 1, 1, 10, 12, "The Contractor shall maintain quality control. Testing is required before acceptance.", ["01 91 00"]),
    ("s2", "d1", "s1", "1.1 Owner QC", ["01 45 00 Quality Control", "Owner QC"], "01 45 00", 2, 2, 10, 10, "Owner shall inspect the Work and document deficiencies. See 01 91 00. The Owner may not waive inspection.", ["01 91 00"]),
    ("s3", "d1", "s1", "1.2 Contractor QC", ["01 45 00 Quality Control", "Contractor QC"], "01 45 00", 2, 3, 10, 11, "Contractor shall perform testing before acceptance. The Contractor shall submit the test report within 14 days after testing unless the owner directs otherwise.", []),
    ("s4", "d1", "s3", "1.2.1 Reports", ["01 45 00 Quality Control", "Contractor QC", "Reports"], "01 45 00", 3, 4, 11, 12, "Inspection report and certificate must be provided prior to final acceptance. Work means the construction required by the contract.", ["02 10 00"]),
    ("s5", "d2", None, "01 91 00 General Commissioning Requirements", ["01 91 00 General Commissioning Requirements"], "01 91 00", 1, 1, 11, 13, "Commissioning records are required. Per Section 01.45.00. The commissioning agent shall verify startup during testing.", ["01 45 00", "09 99 99"]),
    ("s6", "d2", "s5", "1.1 Records", ["01 91 00 General Commissioning Requirements", "Records"], "01 91 00", 2, 2, 12, 12, "Contractor shall not energize equipment before the commissioning report is approved by the engineer. Training should be scheduled.", []),
    ("s7", "d2", "s5", "1.2 Closeout", ["01 91 00 General Commissioning Requirements", "Closeout"], "01 91 00", 2, 3, 13, 13, "The warranty and record drawing shall be delivered upon completion. Final acceptance requires a punch list.", ["01 45 00"]),
    ("s8", "d3", None, "02 10 00 Site Work", ["02 10 00 Site Work"], "02 10 00", 1, 1, 20, 25, "Contractor shall perform testing before acceptance of site work. The contractor may start when the schedule is approved.", []),
    ("s9", "d3", "s8", "1.1 Safety", ["02 10 00 Site Work", "Safety"], "02 10 00", 2, 2, 21, 21, "", []),
    ("s10", "d3", "s8", "1.2 Permits", ["02 10 00 Site Work", "Permits"], "02 10 00", 2, 3, None, None, None, ["s1"]),
], """
SELECT 'r' || CAST(r_regionkey AS STRING), 'doc' || CAST(r_regionkey AS STRING), CAST(NULL AS STRING), '5' || CAST(r_regionkey AS STRING) || ' 00 00 ' || r_name || ' Supply', LIST['5' || CAST(r_regionkey AS STRING) || ' 00 00 ' || r_name || ' Supply'], '5' || CAST(r_regionkey AS STRING) || ' 00 00',
  1, 1, r_regionkey * 40 + 1, r_regionkey * 40 + 39, 'The Contractor shall maintain records of suppliers in ' || r_name || '. Inspection is required before acceptance.', LIST['01 45 00', '5' || CAST((r_regionkey + 1) % 5 AS STRING) || ' 00 00']
FROM {region}
UNION ALL
SELECT 'n' || CAST(n_nationkey AS STRING), 'doc' || CAST(n_regionkey AS STRING), 'r' || CAST(n_regionkey AS STRING), '1.' || CAST(n_nationkey AS STRING) || ' ' || n_name, LIST['5' || CAST(n_regionkey AS STRING) || ' 00 00 ' || r_name || ' Supply', n_name], '5' || CAST(n_regionkey AS STRING) || ' 00 00',
  2, 2 + n_nationkey, n_regionkey * 40 + 1 + n_nationkey, n_regionkey * 40 + 3 + n_nationkey,
  CASE n_nationkey % 3 WHEN 0 THEN 'Owner shall review the submittal of each supplier in ' || n_name || '. See 01 91 00.' WHEN 1 THEN 'The contractor may not deliver to ' || n_name || ' before the owner accepts the schedule.' ELSE 'Training should be scheduled in ' || n_name || ' upon completion.' END, LIST['01 91 00']
FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
UNION ALL
SELECT 's_' || CAST(s_suppkey AS STRING), 'doc' || CAST(n_regionkey AS STRING), 'n' || CAST(n_nationkey AS STRING), '1.' || CAST(n_nationkey AS STRING) || '.' || CAST(s_suppkey AS STRING) || ' ' || s_name, LIST['5' || CAST(n_regionkey AS STRING) || ' 00 00 ' || r_name || ' Supply', n_name, s_name], '5' || CAST(n_regionkey AS STRING) || ' 00 00',
  3, 100 + s_suppkey, n_regionkey * 40 + 1 + n_nationkey, n_regionkey * 40 + 2 + n_nationkey,
  CASE s_suppkey % 5 WHEN 0 THEN 'Contractor shall perform testing of goods from ' || s_name || ' before acceptance.' WHEN 1 THEN 'The supplier shall submit the test report within ' || CAST(s_suppkey % 30 + 1 AS STRING) || ' days after testing unless the owner directs otherwise.'
    WHEN 2 THEN 'Owner shall inspect the work of ' || s_name || ' and document deficiencies.' WHEN 3 THEN 'Inspection report and certificate must be provided prior to final acceptance.' ELSE 'Shipment means the transfer of goods to the site by ' || s_name || '.' END
  || CASE s_suppkey % 3 WHEN 0 THEN ' Per Section 01 45 00.' WHEN 1 THEN ' Contractor shall not energize equipment before the commissioning report is approved by the engineer.' ELSE ' The warranty shall be delivered upon completion.' END, LIST['01 45 00']
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
""")


def literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, list):
        return "[" + ", ".join(map(literal, v)) + "]"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return repr(v)


def values(rows: list[tuple], schema: str) -> str:
    """A DuckDB subquery with the rows, typed by a Spark schema string."""
    kinds = {"string": "VARCHAR", "int": "INTEGER", "long": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP", "array<string>": "VARCHAR[]"}
    names = [c.split() for c in schema.split(", ")]
    cols = ", ".join(f"CAST({n} AS {kinds[k]}) AS {n}" for n, k in names)
    body = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)
    own = f"SELECT {cols} FROM (VALUES {body}) AS v({', '.join(n for n, _ in names)})"
    if isinstance(rows, Rows):
        own += f" UNION ALL SELECT {cols} FROM ({_tables(rows.more, str)}) AS m({', '.join(n for n, _ in names)})".replace("LIST[", "[")
    return f"({own})"


def frame(spark: SparkSession | Session, rows: list[tuple], schema: str) -> DataFrame:
    """The rows as a DataFrame; dates and timestamps are given as text.  A `Session` adds those of the tables."""
    plain = ", ".join(c.replace(" date", " string").replace(" timestamp", " string") for c in schema.split(", "))
    df = spark.createDataFrame(rows, plain)
    for c in schema.split(", "):
        name, kind = c.split()
        if kind in ("date", "timestamp"):
            df = df.withColumn(name, df[name].cast(kind))
    if isinstance(rows, Rows) and isinstance(spark, Session):
        query = re.sub(r"LIST\[([^\]]*)\]", r"array(\1)", _tables(rows.more, lambda t: f"parquet.`{spark.folder}/{t}.parquet`"))
        more = spark.sql(query).toDF(*df.columns)
        df = df.unionByName(more.select(*(more[f.name].cast(f.dataType) for f in df.schema)))
    return df


def sections(spark: SparkSession | Session) -> DataFrame:
    return frame(spark, SECTIONS, SECTION_SCHEMA)


SECTIONS_SQL = values(SECTIONS, SECTION_SCHEMA)
