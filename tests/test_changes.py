import datetime as dt
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from waymark.operators import build, changes
from waymark.sources import archives, store
from waymark.streaming.deltas import apply_deltas

SCHEMA = "id string, generation int, effect_from timestamp, effect_until timestamp, recorded_from timestamp, recorded_until timestamp, name string"


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def now():
    return F.lit("2024-01-10").cast("timestamp")


def fold(spark, rows):
    return {r.id: r for r in changes.fold_versions(spark.createDataFrame(rows, SCHEMA), "id", now()).collect()}


def test_versions(spark):
    got = fold(
        spark,
        [
            ("open", 1, day(0), None, day(0), None, "yes"), ("open", 1, day(0), None, day(1), day(2), "closed"), ("gone", 2, day(0), None, day(0), day(3), "closed"),
            ("future", 1, day(20), None, day(0), None, "later"), ("future", 1, day(1), None, day(0), None, "now"), ("late", 5, day(0), None, day(0), None, "new"), ("late", 3, day(5), None, day(5), None, "old"),
            (None, 1, day(0), None, day(0), None, "no key"),
        ],
    )
    assert got["open"].name == "yes" and got["gone"].deleted and got["gone"].name is None
    assert got["future"].name == "now" and got["late"].name == "new" and None not in got


def test_empty(spark):
    assert fold(spark, []) == {}


def test_zip_rows():
    def packed(text, name="a.CSV"):
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            z.writestr(name, text)
        return io.BytesIO(data.getvalue())

    assert list(archives.zip_rows(packed("﻿a;b\n1;2,3\n"))) == [{"a": "1", "b": "2,3"}]
    assert list(archives.zip_rows(packed("a,b\n1,2\n"))) == [{"a": "1", "b": "2"}]
    assert list(archives.zip_rows(packed(""))) == []
    assert list(archives.zip_rows(packed("a;b\n1;" + "x" * 200_000 + "\n")))[0]["b"] == "x" * 200_000
    with pytest.raises(ValueError):
        list(archives.zip_rows(packed("x", "a.txt")))


def test_typed(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "f.zip", "w") as z:
        z.writestr("f.csv", "id;shape;at;landsejerlavskode;when\n 7 ;POLYGON ((0 0, 1 0, 1 1, 0 0));POINT Z (3.50 4 1);12;2024-01-01T00:00:00+02:00\n8;;;;x\n")
    rows = archives.scan(spark, str(tmp_path / "*.zip"))
    assert archives.sniffed_headers(rows).select("polygon", "line", "point", "district_code").first() == ("shape", None, "at", "landsejerlavskode")
    spec = {"id": (("nr", "id"), "text"), "area": ("polygon", "geojson"), "xy": ("point", "point"), "x": ("point", "x"), "code": ("district_code", "number"), "time": (("when",), "time")}
    one, two = archives.typed(rows, spec).orderBy("line").collect()
    assert (one.id, one.xy, one.x, one.code, one.time) == ("7", "3.50 4", 3.5, 12.0, "2023-12-31T22:00:00+00:00") and one.area.startswith('{"type":"Polygon"')
    assert two.id == "8" and [two[c] for c in ("area", "xy", "x", "code", "time")] == [None] * 5


def test_scan(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "f_7.zip", "w") as z:
        z.writestr("f.csv", "id;Navn\n1; x \n2;\n")
    rows = archives.scan(spark, str(tmp_path))
    archives.require_headers(rows, ["id"])
    with pytest.raises(ValueError):
        archives.require_headers(rows, ["id", "missing"])
    got = archives.shaped(rows, {"id": ("id",), "name": ("navn", "Navn")}).select("id", "name", changes.file_generation(F.col("path"), F.lit(None).cast("string")).alias("g"))
    assert sorted(map(tuple, got.collect())) == [("1", "x", 7), ("2", None, 7)]


def test_generations(spark, tmp_path):
    root = str(tmp_path / "store")
    df = spark.range(3).withColumn("lifecycle", F.when(F.col("id") > 0, "current").otherwise("retired"))
    assert store.write_generation({"t": df}, root, "g1", "c", day(0)) == {"t": 3}
    store.write_generation({"t": df.limit(1)}, root, "g2", "c", day(1))
    assert store.read_generation(spark, root, "t", "c").count() == 1
    assert store.export_jsonl(df, str(tmp_path / "out"), 1) == 2
    with pytest.raises(ValueError):
        store.export_jsonl(df, str(tmp_path / "out2"), 10)
    assert store.table_or_empty(spark, str(tmp_path / "none"), "a int").count() == 0
    with pytest.raises(LookupError):
        store.read_generation(spark, root, "t", "other")


def test_stream_of_deltas(spark, tmp_path):
    source, staged, checkpoint = (str(tmp_path / x) for x in ("in", "staged", "checkpoint"))
    write = lambda rows: spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    write([("a", 1, day(0), None, day(0), None, "one"), ("b", 1, day(0), None, day(0), None, "two")])
    apply_deltas(spark, source, SCHEMA, staged, checkpoint, "id", ["name"], now()).awaitTermination()
    write([("a", 2, day(1), None, day(1), None, "new"), ("b", 2, day(0), None, day(0), day(2), "two")])
    apply_deltas(spark, source, SCHEMA, staged, checkpoint, "id", ["name"], now()).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(f"{staged}/version=1").select("id", "name").collect())) == [("a", "new")]


def test_chain(spark):
    units = spark.createDataFrame([("u1", "p", "a", "g1"), ("u2", None, "a", "g1"), ("u3", None, None, "g1"), ("u4", None, None, None)], "bfe string, point string, area string, ground string")
    buildings = spark.createDataFrame([("p", "b1", "g2"), ("a", "b2", None)], "id string, bfe string, ground string")
    grounds = spark.createDataFrame([("g1", "s1"), ("g2", "s2")], "id string, bfe string")
    got = {r.bfe: (r.parent, r.chain) for r in build.ownership_chain(units, buildings, grounds).collect()}
    assert got == {"u1": ("b1", ["u1", "b1", "s2"]), "u2": ("b2", ["u2", "b2", "s1"]), "u3": ("s1", ["u3", "s1"]), "u4": (None, ["u4"])}
