"""Zipped CSV files with a header, as rows of text columns."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from typing import IO

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS = T.StructType().add("path", T.StringType()).add("line", T.IntegerType()).add("row", T.MapType(T.StringType(), T.StringType()))
BATCH, BATCH_CHARS = 5000, 20_000_000


#: Geometries make fields of any length.
MOST_FIELD = 1 << 30


def zip_rows(file: IO[bytes], path: str = "") -> Iterator[dict[str, str]]:
    """Rows of the first CSV member of a zip file, streamed; a header with more semicolons than commas is split at semicolons."""
    csv.field_size_limit(MOST_FIELD)
    with zipfile.ZipFile(file) as archive:
        member = next((n for n in archive.namelist() if n.lower().endswith(".csv")), None)
        if member is None:
            raise ValueError(f"{path}: no CSV file in the archive")
        with archive.open(member) as raw:
            text = io.TextIOWrapper(raw, "utf-8-sig", newline="")
            head = text.readline()
            if not head.strip():
                return
            mark = ";" if head.count(";") > head.count(",") else ","
            names = next(csv.reader([head], delimiter=mark))
            for values in csv.reader(text, delimiter=mark):
                yield dict(zip(names, values, strict=False))


def _opened(path: str) -> IO[bytes]:
    """A seekable file of any store that pyarrow knows; zip files are read by their directory, never as a whole."""
    from pyarrow import fs

    path = re.sub(r"^file:/+", "file:///", path).replace("s3a://", "s3://", 1)
    store, where = fs.FileSystem.from_uri(path)
    return store.open_input_file(where)


def _read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for path in frame["path"]:
            held: list[dict] = []
            size = 0
            with _opened(path) as file:
                for line, row in enumerate(zip_rows(file, path)):
                    held.append({"path": path, "line": line, "row": row})
                    size += sum(map(len, row.values()))
                    if len(held) == BATCH or size > BATCH_CHARS:
                        yield pd.DataFrame(held)
                        held, size = [], 0
            if held:
                yield pd.DataFrame(held)


def scan(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, line, row: map of header to text) of zipped CSV files, a task for some of them; only their names pass through Spark."""
    files = spark.read.format("binaryFile").load(paths).select("path")
    return files.repartition(max(1, min(files.count(), 1000)), "path").mapInPandas(_read, ROWS)


#: What a column of a kind holds, by the first characters of its values.
SHAPES = {"polygon": ("POLYGON", "MULTIPOLYGON"), "line": ("LINESTRING", "MULTILINESTRING"), "point": ("POINT",)}


def sniffed_headers(rows: DataFrame, row: str = "row") -> DataFrame:
    """(path, polygon, line, point, district_code): of each file the first header, in order of name, whose values have that shape, and the header that is a district's code."""
    each = rows.select("path", F.explode(row).alias("header", "value")).filter("value <> ''")
    start = F.upper(F.substring(F.ltrim("value"), 1, 20))

    def first(test: Column) -> Column:
        return F.min(F.when(test, F.col("header")))

    shape = {kind: first(F.lit(False) if not marks else F.concat(*[start.startswith(m).cast("string") for m in marks]).contains("true")) for kind, marks in SHAPES.items()}
    name = F.lower("header")
    return each.groupBy("path").agg(*[c.alias(kind) for kind, c in shape.items()], first(name.contains("ejerlav") & name.contains("kode")).alias("district_code"))


def typed(rows: DataFrame, spec: dict[str, tuple[tuple[str, ...] | str, str]], row: str = "row") -> DataFrame:
    """Rows by ``spec``: a name to (headers, the first present counts, or a shape that :func:`sniffed_headers` finds) and a kind.

    Kinds: text, number, time (UTC), geojson, point (``x y``), x, y. What is missing or unreadable is null.
    """
    from ..functions import geometry
    from ..functions.text import clean, to_float, utc_text

    sniffs = {h for h, _ in spec.values() if isinstance(h, str)}
    if sniffs:
        found = sniffed_headers(rows, row)
        rows = rows.join(found.select("path", *[F.col(c).alias(f"sniffed_{c}") for c in found.columns if c != "path"]), "path", "left")  # one row a file

    def shaped_as(raw: Column, kind: str) -> Column:
        if kind in ("x", "y", "point"):
            x, y = geometry.wkt_xy(raw)
            return {"x": x, "y": y, "point": geometry.point_text(raw)}[kind]
        return {"text": clean, "number": to_float, "time": utc_text, "geojson": geometry.geojson_from_wkt}[kind](raw)

    out = []
    for name, (headers, kind) in spec.items():
        raw = F.element_at(row, F.col(f"sniffed_{headers}")) if isinstance(headers, str) else F.coalesce(*[F.element_at(row, h) for h in headers])
        out.append(shaped_as(raw, kind).alias(name))
    return rows.select("path", "line", *out)


def baseline(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rows of a full file as they stage: whatever their state, but none with a null in a composite key."""
    return rows.dropna(subset=keys) if keys else rows


def shaped(rows: DataFrame, columns: dict[str, tuple[str, ...]], row: str = "row") -> DataFrame:
    """``columns`` maps a name to the headers that it may have; the first that a row has counts, cleaned."""
    from ..functions.text import clean

    def first(headers: tuple[str, ...]) -> Column:
        return F.coalesce(*[F.element_at(row, h) for h in headers])

    return rows.select(*[c for c in rows.columns if c != row], *[clean(first(h)).alias(name) for name, h in columns.items()])


def require_headers(rows: DataFrame, headers: list[str], row: str = "row") -> None:
    """Stop if any file lacks a header that folding needs."""
    missing = rows.groupBy("path").agg(*[F.max(F.map_contains_key(row, h)).alias(h) for h in headers]).filter(" or ".join(f"not `{h}`" for h in headers))
    bad = missing.first()
    if bad is not None:
        raise ValueError(f"{bad.path}: a header is missing of {', '.join(headers)}")


def in_bucket(id_: Column, buckets: int, below: int) -> Column:
    """A stable split by a hash of the id; the two sides of one cut never overlap."""
    return F.pmod(F.xxhash64(id_), F.lit(buckets)) < below
