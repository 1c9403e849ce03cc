"""Bundles: datasets in parts of a byte target, with a manifest that names rows, bytes and hashes (S-10 to S-16)."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.budget import split_parts

TARGET = 1_000_000


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def write_bundle(spark: SparkSession, tables: dict[str, DataFrame], folder: str, order: dict[str, str], target: int = TARGET, buckets: int = 1) -> None:
    """Write each table as JSON lines in parts of about `target` bytes, then the manifest, then move all in place.

    Rows are numbered into parts within `buckets` hash groups of their key, so the running sum is no single task on a
    large table. A record is never split. A failed run leaves an unfinished folder beside and the old bundle as it was.
    """
    stage = f"{folder.rstrip('/')}.{uuid.uuid4().hex[:8]}"
    written = {}
    for name, df in tables.items():
        key = order[name]
        text = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
        rows = df.select(F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).alias("bucket"), F.col(key).cast("string").alias("key"), text.alias("value"))
        rows = split_parts(rows.withColumn("size", F.octet_length("value").cast("long") + 1), "bucket", "key", "size", target)
        rows.select("bucket", "part", "value").repartition("bucket", "part").sortWithinPartitions("bucket", "part", "value").write.partitionBy("bucket", "part").text(f"{stage}/{name}")
        written[name] = df.schema
    manifest = _described(spark, stage, list(written))
    manifest.coalesce(1).write.json(f"{stage}/manifest")
    schema = [(json.dumps({"name": n, "schema": json.loads(s.json())}),) for n, s in written.items()]
    spark.createDataFrame(schema, "value string").coalesce(1).write.text(f"{stage}/schemas")
    swap(spark, stage, folder)


def swap(spark: SparkSession, stage: str, folder: str) -> None:
    """Move a finished folder in place. The old one steps aside first and goes last, so at each moment one of the two is
    whole, here or under its name with `.old`; where the new one can't be moved, the old one comes back."""
    fs, to = _fs(spark, folder.rstrip("/"))
    aside = _fs(spark, folder.rstrip("/") + ".old")[1]
    if fs.exists(to):
        if fs.exists(aside):
            fs.delete(aside, True)
        if not fs.rename(to, aside):
            raise OSError(f"{folder} can't be moved aside")
    elif not fs.exists(to.getParent()):
        fs.mkdirs(to.getParent())
    if not fs.rename(_fs(spark, stage)[1], to):
        if fs.exists(aside):
            fs.rename(aside, to)
        raise OSError(f"{stage} can't be moved to {folder}")
    if fs.exists(aside):
        fs.delete(aside, True)


def _described(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """dataset, file, rows, bytes, sha256 of every part."""
    out = None
    for name in names:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(f"{folder}/{name}")
        lines = F.size(F.split(F.col("content").cast("string"), "\n")) - 1
        one = files.select(F.lit(name).alias("dataset"), F.regexp_extract("path", rf"/{name}/(.*)$", 1).alias("file"), lines.cast("long").alias("rows"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
        out = one if out is None else out.unionByName(one)
    return out


def read_bundle(spark: SparkSession, folder: str, verify: bool = True) -> dict[str, DataFrame]:
    """The tables of a bundle; ValueError where a part's bytes or hash differ from the manifest, or parts are missing."""
    from pyspark.sql.types import StructType

    schemas = {d["name"]: StructType.fromJson(d["schema"]) for d in (json.loads(r.value) for r in spark.read.text(f"{folder}/schemas").collect())}
    if verify:
        said = spark.read.schema("dataset string, file string, rows long, bytes long, sha256 string").json(f"{folder}/manifest")
        found = _described(spark, folder, list(schemas))
        cols = ["dataset", "file", "rows", "bytes", "sha256"]
        odd = said.select(cols).exceptAll(found.select(cols)).unionByName(found.select(cols).exceptAll(said.select(cols))).limit(1).collect()
        if odd:
            raise ValueError(f"the bundle is not what its manifest says: {odd[0].dataset}/{odd[0].file}")
    read = lambda n, s: spark.read.schema(s).option("recursiveFileLookup", "true").json(f"{folder}/{n}")
    return {n: read(n, s) for n, s in schemas.items()}


def size_of(df: DataFrame) -> F.Column:
    """Bytes of a row as compact JSON, nulls written (F-27)."""
    return F.octet_length(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}))
