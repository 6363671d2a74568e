"""File scans and state tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scan_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, name, suffix, parent, size and modificationTime of every file below a folder; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).drop("content")
    name = F.substring_index("path", "/", -1)
    return found.select("path", name.alias("name"), F.regexp_extract(name, r"(\.[^.]*)$", 1).alias("suffix"), F.regexp_extract("path", r"([^/]*)/[^/]*$", 1).alias("parent"), F.col("length").alias("size"), "modificationTime")


def folder_summary(files: DataFrame) -> DataFrame:
    return files.groupBy("parent", "suffix").agg(F.count("*").alias("n_files"), F.sum("size").alias("bytes"))


def read_log(spark: SparkSession, path: str, required: list[str], schema: T.StructType | None = None) -> DataFrame:
    """A CSV log; raises if a required column is missing."""
    df = spark.read.schema(schema).csv(path, header=True) if schema else spark.read.csv(path, header=True)
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    return df


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A Parquet table, or an empty one of that schema where there is none."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def write_layer(df: DataFrame, path: str, layer: str) -> None:
    """Replaces one layer of a layered table and leaves the others."""
    df.withColumn("layer", F.lit(layer)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("layer").parquet(path)


def layers(spark: SparkSession, path: str) -> list[str]:
    """Names of the layers (folders, so few)."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName().split("=", 1)[1] for s in fs.listStatus(p) if s.getPath().getName().startswith("layer="))


def drop_layer(spark: SparkSession, path: str, layer: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/layer={layer}")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def rings(spark: SparkSession, path: str) -> DataFrame:
    """Outer rings of a GeoJSON file's polygons: feature, ring."""
    shape = "features array<struct<geometry:struct<type:string,coordinates:array<array<array<double>>>>>>"
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", shape).alias("g"))
    return doc.select(F.posexplode("g.features").alias("feature", "f")).filter("f.geometry.type = 'Polygon'").select("feature", F.col("f.geometry.coordinates")[0].alias("ring"))


def fingerprint(spark: SparkSession, path: str) -> str:
    """Of a file or of all files below a folder: how many there are, and a hash of their paths, lengths and times of change. Contents are not read."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    state = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p)
    if state.isFile():
        return f"{path}:{state.getModificationTime()}:{state.getLen()}"
    own = F.xxhash64("path", "size", F.col("modificationTime").cast("double"))
    row = scan_files(spark, path).agg(F.count("*").alias("n"), F.sum(F.pmod(own, F.lit(1 << 40))).alias("a"), F.bit_xor(own).alias("b")).first()
    return f"{path}:{row.n}:{row.a}:{row.b}"


def cached(spark: SparkSession, path: str, key: str, build) -> DataFrame:
    """A table kept under a fingerprint of what it was made from until the session ends; built once."""
    at = f"{path}/{key}"
    p, conf = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS"), spark.sparkContext._jsc.hadoopConfiguration()
    if not p.getFileSystem(conf).exists(p):
        build().write.mode("overwrite").parquet(at)
        p.getFileSystem(conf).deleteOnExit(p.getParent())
    return spark.read.parquet(at)
