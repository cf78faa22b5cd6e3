"""Generations of tables as directories, with a manifest that is written last."""

from __future__ import annotations

import hashlib
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MANIFEST = "name string, contract string, seeded_at timestamp, tables map<string,bigint>"


def fingerprint(df: DataFrame, version: str = "1") -> str:
    """Hash of a table's shape and of the version of the rules that filled it."""
    return hashlib.sha256(f"{version}:{json.dumps(json.loads(df.schema.json()), sort_keys=True)}".encode()).hexdigest()


def write_generation(tables: dict[str, DataFrame], root: str, name: str, contract: str, seeded_at) -> dict[str, int]:
    """Write all tables, count what was written, and register the generation by its manifest row: readers see all or nothing."""
    spark = next(iter(tables.values())).sparkSession
    counts = {}
    for table, df in tables.items():
        path = f"{root}/gen={name}/{table}"
        df.write.mode("overwrite").parquet(path)
        counts[table] = spark.read.parquet(path).count()
    spark.createDataFrame([(name, contract, seeded_at, counts)], MANIFEST).write.mode("append").parquet(f"{root}/manifest")
    return counts


def generations(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{root}/manifest")


def read_generation(spark: SparkSession, root: str, table: str, contract: str) -> DataFrame:
    """A table of the newest generation of a contract."""
    newest = generations(spark, root).filter(F.col("contract") == contract).orderBy(F.desc("seeded_at"), F.desc("name")).first()
    if newest is None:
        raise LookupError(f"no generation of contract {contract}")
    return spark.read.parquet(f"{root}/gen={newest.name}/{table}")


def export_jsonl(rows: DataFrame, path: str, least: int) -> int:
    """Current rows as JSON lines without their lifecycle; fewer than ``least`` is an error and writes nothing."""
    current = rows.filter("lifecycle = 'current'").drop("lifecycle")
    n = current.count()
    if n < least:
        raise ValueError(f"{n} rows, at least {least} are wanted")
    current.write.mode("overwrite").json(path)
    return n


def table_or_empty(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """A staged table, or an empty one if it was never written."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def read_index(spark: SparkSession, root: str, contract: str, tables: list[str]) -> dict[str, DataFrame]:
    """Several tables of one and the same generation, the newest of a contract."""
    newest = generations(spark, root).filter(F.col("contract") == contract).orderBy(F.desc("seeded_at"), F.desc("name")).first()
    if newest is None:
        raise LookupError(f"no generation of contract {contract}")
    return {t: spark.read.parquet(f"{root}/gen={newest.name}/{t}") for t in tables}


def stamped(watermark: DataFrame | None, cursors: DataFrame) -> DataFrame:
    """The watermark (entity, cursor, contract) with what ``cursors`` says now; entities that it does not name stay."""
    if watermark is None:
        return cursors.select("entity", "cursor", "contract")
    kept = watermark.join(cursors.select("entity"), "entity", "left_anti")
    return kept.select("entity", "cursor", "contract").unionByName(cursors.select("entity", "cursor", "contract"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines by a schema; a line that is not JSON stops the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


ADDRESS = "id string, street string, house_number string, house_letter string, floor string, door string, postcode string, city string, sub_locality string"


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Exported addresses, without those that have no street, number, postcode and city at all."""
    rows = read_jsonl(spark, path, ADDRESS)
    return rows.filter(" or ".join(f"coalesce({c}, '') <> ''" for c in ("street", "house_number", "postcode", "city")))


def write_results(rows: DataFrame, facts: dict[str, object], path: str) -> None:
    """Rows of a run as JSON lines, then one line that says what it was run on; the last is written when the rows are there."""
    rows.write.mode("overwrite").json(f"{path}/rows")
    line = json.dumps(facts | {"rows": rows.sparkSession.read.text(f"{path}/rows").count()}, sort_keys=True, default=str)
    rows.sparkSession.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def read_table(spark: SparkSession, url: str, table: str, fetch: int = 10_000, partition: tuple[str, int, int, int] | None = None, **options: str) -> DataFrame:
    """A database table by JDBC, ``fetch`` rows a round trip; ``partition`` is (column, lowest, highest, readers)."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, fetchsize=str(fetch), **options)
    if partition:
        column, low, high, n = partition
        reader = reader.options(partitionColumn=column, lowerBound=str(low), upperBound=str(high), numPartitions=str(n))
    return reader.load()


def load_params(path: str, axes: tuple[str, ...]) -> tuple[dict[str, float], float, float]:
    """(weights, margin a, margin b) of a JSON file; an axis or a margin that is missing, or a weight that is no number, is an error."""
    with open(os.fspath(path), encoding="utf-8") as file:
        found = json.load(file)
    lacking = [a for a in axes if not isinstance(found.get("weights", {}).get(a), int | float)] + [m for m in ("margin_a", "margin_b") if not isinstance(found.get(m), int | float)]
    if lacking:
        raise ValueError(f"{path} lacks {', '.join(lacking)}")
    return {a: float(found["weights"][a]) for a in axes}, float(found["margin_a"]), float(found["margin_b"])
