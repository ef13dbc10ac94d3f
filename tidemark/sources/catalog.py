"""Databases, tables and their descriptions over the Spark session; ingest and external sources."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Declared attribute types and what holds them here.
TYPES = {"ID": "string", "String": "string", "Int": "int", "Long": "bigint", "Float": "double", "BigInt": "decimal(38,0)", "Boolean": "boolean", "Date": "timestamp", "Blob": "binary", "Bytes": "binary", "Any": "variant"}
DEFAULT = "data"


class Catalog:
    """db.table names over DataFrames, with a primary key and declared attributes for each."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tables = spark, {}

    def create(self, table: str, df: DataFrame | None = None, key: str = "id", database: str = DEFAULT, attributes: list[dict] | None = None, updated: str | None = None) -> DataFrame:
        """Registers a table, empty with the declared attributes if no rows are given."""
        if df is None:
            declared = {key: "string"} | {a["name"]: TYPES.get(a.get("type", "Any"), a.get("type", "string")) for a in attributes or []}
            df = self.spark.createDataFrame([], ", ".join(f"`{n}` {t}" for n, t in declared.items()))
        self.tables[database, table] = (df, key, updated)
        df.createOrReplaceTempView(self.view(table, database))
        return df

    def view(self, table: str, database: str = DEFAULT) -> str:
        return f"{database}__{table}"

    def table(self, table: str, database: str = DEFAULT) -> DataFrame:
        return self.tables[database, table][0]

    def key(self, table: str, database: str = DEFAULT) -> str:
        return self.tables[database, table][1]

    def drop(self, table: str, database: str = DEFAULT) -> None:
        self.tables.pop((database, table), None)
        self.spark.catalog.dropTempView(self.view(table, database))

    def replace(self, table: str, df: DataFrame, database: str = DEFAULT) -> DataFrame:
        """Puts other rows in a table's place; its key stays."""
        _, key, updated = self.tables[database, table]
        return self.create(table, df, key, database, updated=updated)

    def clear(self, table: str, database: str = DEFAULT) -> DataFrame:
        """Takes all rows out of a table, which stays with its attributes."""
        return self.replace(table, self.table(table, database).where("false"), database)

    def merge_schema(self, table: str, rows: DataFrame, database: str = DEFAULT) -> DataFrame:
        """Adds rows; attributes only grow."""
        df, key, updated = self.tables[database, table]
        return self.create(table, df.unionByName(rows, allowMissingColumns=True), key, database, updated=updated)

    def sql(self, text: str) -> DataFrame:
        """SQL with database.table names. Text in quotes stays as it is."""
        names = sorted(self.tables, key=lambda t: -len(".".join(t)))
        pieces = re.split(r"('(?:[^']|'')*')", text)
        for i in range(0, len(pieces), 2):
            for db, t in names:
                pieces[i] = re.sub(rf"(?<![\w.`]){re.escape(db)}\s*\.\s*{re.escape(t)}(?![\w`])", self.view(t, db), pieces[i])
        return self.spark.sql("".join(pieces))

    def describe_table(self, table: str, database: str = DEFAULT) -> DataFrame:
        """One row: database, table, hash_attribute, attributes, record_count, last_updated_record."""
        df, key, updated = self.tables[database, table]
        last = F.coalesce(F.max(F.unix_millis(F.col(updated).cast("timestamp")).cast("double")), F.lit(0.0)) if updated else F.lit(0.0)
        named = ",".join(f"{n}:{t}" for n, t in df.dtypes)
        return df.agg(F.count(F.lit(1)).alias("record_count"), last.alias("last_updated_record")).select(F.lit(database).alias("database"), F.lit(table).alias("table"), F.lit(key).alias("hash_attribute"), F.lit(named).alias("attributes"), "record_count", "last_updated_record")

    def describe_database(self, database: str = DEFAULT) -> DataFrame:
        out = None
        for db, t in sorted(self.tables):
            if db == database:
                one = self.describe_table(t, db)
                out = one if out is None else out.union(one)
        return out

    def describe_all(self) -> DataFrame:
        out = None
        for db in sorted({d for d, _ in self.tables}):
            one = self.describe_database(db)
            out = one if out is None else out.union(one)
        return out


def create_statements(described: DataFrame, managed=("__createdtime__", "__updatedtime__"), system: str = "system") -> DataFrame:
    """create_table operations for described tables, without server-managed attributes and system tables."""
    parts = F.filter(F.split("attributes", ","), lambda a: ~F.substring_index(a, ":", 1).isin(*managed))
    return described.where(F.col("database") != system).select("database", "table", F.col("hash_attribute").alias("primary_key"), F.array_join(parts, ",").alias("attributes"))


def high_water(described: DataFrame) -> DataFrame:
    """The largest last_updated_record of each database, 0 if none."""
    return described.groupBy("database").agg(F.coalesce(F.max("last_updated_record"), F.lit(0.0)).alias("high_water"))


def declared(sdl: str) -> dict[str, dict]:
    """Tables of a GraphQL schema: attributes with types and directives, the key, computed expressions and relationships.

    Directives that aren't known are kept by name.
    """
    out: dict[str, dict] = {}
    for name, head, body in re.findall(r"type\s+(\w+)\s*([^{]*)\{([^}]*)\}", re.sub(r"#[^\n]*", "", sdl)):
        attributes: dict[str, dict] = {}
        for line in re.finditer(r"(\w+)\s*:\s*(\[?)\s*(\w+)\s*!?\s*\]?\s*!?((?:\s*@\w+(?:\s*\([^)]*\))?)*)", body):
            attribute, many, kind, tail = line.groups()
            directives = {d: dict(re.findall(r"(\w+)\s*:\s*\"?([^\",)]+)\"?", args or "")) for d, args in re.findall(r"@(\w+)(?:\s*\(([^)]*)\))?", tail)}
            attributes[attribute] = {"type": kind, "array": bool(many), "directives": directives}
        key = next((a for a, d in attributes.items() if "primaryKey" in d["directives"]), None)
        out[name] = {"table": "@table" in head, "export": "@export" in head, "key": key, "attributes": attributes}
    return out


def struct_of(types: dict[str, dict], name: str) -> T.StructType:
    """The Spark schema of a declared type; related and computed attributes are not stored."""
    fields = []
    for attribute, d in types[name]["attributes"].items():
        if {"relationship", "computed"} & set(d["directives"]):
            continue
        kind = T._parse_datatype_string(TYPES[d["type"]]) if d["type"] in TYPES else struct_of(types, d["type"])
        fields.append(T.StructField(attribute, T.ArrayType(kind) if d["array"] else kind))
    return T.StructType(fields)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header; every attribute is text first."""
    return spark.read.option("header", True).csv(path)


def read_json(spark: SparkSession, path: str, schema=None) -> DataFrame:
    return spark.read.json(path, schema=schema)


def read_blobs(spark: SparkSession, path: str) -> DataFrame:
    """path, length and content of files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def parsed_documents(rows: DataFrame, text: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows that decode, rows that don't): undecodable records are kept apart and counted, never mixed in."""
    with_bad = rows.withColumn("_doc", F.from_json(text, f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    bad = F.col("_doc._corrupt").isNotNull() | F.col("_doc").isNull()
    return with_bad.where(~bad).withColumn("_doc", F.col("_doc").dropFields("_corrupt")), with_bad.where(bad).drop("_doc")


def read_through(wanted: DataFrame, stored: DataFrame, key: str, load) -> DataFrame:
    """Stored records of the wanted keys and, for those not stored, what `load` (pandas iterator to pandas iterator) finds."""
    misses = wanted.select(key).distinct().join(stored, key, "left_anti")
    return stored.join(wanted.select(key).distinct(), key, "left_semi").unionByName(misses.mapInPandas(load, stored.schema))


def process_rows(lines: DataFrame, line: str = "value") -> DataFrame:
    """pid, name, ppid, utime, stime, cutime, cstime from texts in the form of a process' stat file; others are dropped."""
    head, tail = F.regexp_extract(line, r"^(\d+) \(", 1), F.split(F.regexp_extract(line, r"^\d+ \(.*\) (.*)$", 1), " ")
    at = lambda i: F.try_element_at(tail, F.lit(i)).try_cast("bigint")
    return lines.select(head.try_cast("bigint").alias("pid"), F.regexp_extract(line, r"\((.*)\)", 1).alias("name"), at(2).alias("ppid"), at(12).alias("utime"), at(13).alias("stime"), at(14).alias("cutime"), at(15).alias("cstime")).where("pid is not null and ppid is not null")


def gpu_rows(lines: DataFrame, line: str = "value") -> DataFrame:
    """gpu, pid, sm of process-monitor lines; headings and idle rows (`-`) are dropped."""
    parts = F.split(F.trim(F.col(line)), r"\s+")
    at = lambda i: F.try_element_at(parts, F.lit(i)).try_cast("bigint")
    return lines.where(~F.col(line).startswith("#")).select(at(1).alias("gpu"), at(2).alias("pid"), at(4).alias("sm")).where("pid is not null and sm is not null")
