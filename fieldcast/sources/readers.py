"""Readers with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

Schema = StructType | str

ARCS = "array<array<array<double>>>"
TOPOLOGY = (
    f"type string, transform struct<scale:array<double>,translate:array<double>>, arcs {ARCS}, "
    "objects map<string,struct<geometries:array<struct<type:string,id:string,properties:map<string,string>,arcs:string>>>>"
)
FEATURES = "type string, features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"


def read_csv(spark: SparkSession, path: str, schema: Schema) -> DataFrame:
    """CSV with a header, UTF-8 (a byte-order mark is skipped), quotes doubled inside quotes."""
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).csv(path)


def read_nested_json(spark: SparkSession, path: str, schema: Schema) -> DataFrame:
    """One document for each file: an object, or an array with a row for each element."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_keyed_json(spark: SparkSession, path: str, value_schema: str) -> DataFrame:
    """Rows of a JSON object keyed by id: ``id`` and the value's fields."""
    whole = spark.read.text(path, wholetext=True)
    rows = whole.select(F.explode(F.from_json("value", f"map<string,struct<{value_schema}>>")).alias("id", "v"))
    return rows.select("id", "v.*")


def read_js_payload(spark: SparkSession, path: str, schema: Schema) -> DataFrame:
    """The JSON of ``window.NAME = {...};``, one row for each file."""
    whole = spark.read.text(path, wholetext=True)
    body = F.regexp_extract("value", r"(?s)^.*?=\s*([\[{].*[\]}])\s*;?\s*$", 1)
    return whole.select(F.from_json(body, schema).alias("v")).select("v.*")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """HTML files as ``url`` (the file's path) and ``html``."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("url"), F.col("value").alias("html"))


def read_page_lines(spark: SparkSession, path: str) -> DataFrame:
    """Pages of files that hold many each, as ``write_pages`` writes them: ``url``, ``html``."""
    return spark.read.schema("url string, html string").json(path)


def _rings(text: Column, many: Column, one: str, more: str) -> Column:
    """Parts > rings of nested JSON numbers: one level less for a Polygon."""
    return F.when(many, F.from_json(text, more)).otherwise(F.array(F.from_json(text, one)))


def read_topology(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(arc points, ring references) of TopoJSON files.

    Arc points: file, arc_id, pos, dx, dy (delta-coded) and the scale and translation of the
    file; references: file, code, name, part, ring, pos, arc_idx (negative: reversed).
    """
    doc = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", TOPOLOGY).alias("t")).select("file", "t.*").filter("type = 'Topology'")
    arcs = doc.select("file", "transform", F.posexplode("arcs").alias("arc_id", "a")).select("file", "arc_id", "transform", F.posexplode("a").alias("pos", "d"))
    arcs = arcs.select("file", "arc_id", "pos", F.get("d", 0).alias("dx"), F.get("d", 1).alias("dy"), F.col("transform.scale").alias("scale"), F.col("transform.translate").alias("translate"))
    g = doc.select("file", F.explode("objects").alias("layer", "o")).select("file", F.explode("o.geometries").alias("g")).select("file", "g.*")
    g = g.select(
        "file",
        F.coalesce("id", F.try_element_at("properties", F.lit("id")), F.try_element_at("properties", F.lit("dma"))).alias("code"),
        F.coalesce(F.try_element_at("properties", F.lit("name")), F.lit("")).alias("name"),
        _rings(F.col("arcs"), F.col("type") == "MultiPolygon", "array<array<int>>", "array<array<array<int>>>").alias("parts"),
    )
    refs = g.select("file", "code", "name", F.posexplode("parts").alias("part", "p")).select("file", "code", "name", "part", F.posexplode("p").alias("ring", "r"))
    return arcs, refs.select("file", "code", "name", "part", "ring", F.posexplode("r").alias("pos", "arc_idx"))


def read_boundaries(spark: SparkSession, path: str) -> DataFrame:
    """Rings of TopoJSON or GeoJSON files: poly, name, part, ring, pos, x, y.

    Other types, and coordinates that are no longitude and latitude, stop the job.
    """
    from ..jobs.boundaries import decode_topology

    whole = spark.read.text(path, wholetext=True).withColumn("type", F.get_json_object("value", "$.type"))
    known = whole.select(F.when(F.col("type").isin("Topology", "FeatureCollection"), F.col("type")).otherwise(F.raise_error(F.concat(F.lit("not a boundary file: "), F.coalesce("type", F.lit("no type"))))).alias("type"))
    if known.filter("type = 'Topology'").take(1):
        return decode_topology(*read_topology(spark, path))
    doc = whole.select(F.from_json("value", FEATURES).alias("t")).select(F.explode("t.features").alias("f")).select("f.*")
    g = doc.select(
        F.coalesce(F.try_element_at("properties", F.lit("dma")), F.try_element_at("properties", F.lit("id"))).alias("poly"),
        F.coalesce(F.try_element_at("properties", F.lit("name")), F.lit("")).alias("name"),
        _rings(F.col("geometry.coordinates"), F.col("geometry.type") == "MultiPolygon", ARCS, f"array<{ARCS}>").alias("parts"),
    )
    rings = g.select("poly", "name", F.posexplode("parts").alias("part", "p")).select("poly", "name", "part", F.posexplode("p").alias("ring", "r"))
    pts = rings.select("poly", "name", "part", "ring", F.posexplode("r").alias("pos", "c"))
    x, y = F.get("c", 0), F.get("c", 1)
    ok = (F.abs(x) <= 180) & (F.abs(y) <= 90)
    return pts.select("poly", "name", "part", "ring", "pos", F.when(ok, x).otherwise(F.raise_error(F.lit("coordinates are no longitude and latitude"))).cast("double").alias("x"), y.alias("y"))
