"""Fact envelopes: facts with what they exclude, their coverage and their time, and guarded writes."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .staging import delete

EPOCH = "1970-01-01T00:00:00.000Z"
SHAPE = "generated_at string, fact_count long, counters string, version string, number long"


def write_fact(facts: DataFrame, counters: DataFrame | Callable[[], dict], path: str, generated_at: str) -> bool:
    """Write facts and their counters below path; False, changing nothing, if facts fell from some to none.

    counters: one row, or a function that is called when the facts are written and tells what was counted on the way.
    The facts stay a table: an envelope never gathers them. They go to a folder of their own version; then a line
    added to the envelopes makes it the current one. A crash before that leaves the old fact whole, and readers of the
    old version keep its files until the next write but one.

    Several writers may write at once: each commits under a number of its own, which it claims by creating a file that
    must not exist, so none takes another's place and the last to claim is current.
    """
    spark = facts.sparkSession
    version = uuid.uuid4().hex
    folder = f"{path}/facts/{version}"
    facts.write.parquet(folder)
    now = spark.read.schema(facts.schema).parquet(folder).count()
    before = read_envelope(spark, path).first()
    if before["fact_count"] and not now:
        delete(spark, folder)
        return False
    number = claim(spark, f"{path}/claims", before["number"] + 1)
    stamps = {"generated_at": F.lit(generated_at), "fact_count": F.lit(now).cast("long"), "version": F.lit(version), "number": F.lit(number).cast("long")}
    if callable(counters):
        told = spark.range(1).select(F.lit(json.dumps(counters())).alias("counters"))
    else:
        told = counters.select(F.to_json(F.struct("*")).alias("counters"))
    told.withColumns(stamps).coalesce(1).write.json(f"{path}/envelope/{number:012d}")  # writers share no folder
    for old in envelopes(spark, path).where(F.col("number") == number - 2).select("version").collect():
        delete(spark, f"{path}/facts/{old['version']}")
    return True


def claim(spark: SparkSession, folder: str, number: int) -> int:
    """The first number from `number` on that no writer has taken, now taken."""
    while not take_number(spark, folder, number):
        number += 1
    return number


def take_number(spark: SparkSession, folder: str, number: int) -> bool:
    """Take a number by creating its file, which must not exist: of several writers one succeeds."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    hadoop = jvm.org.apache.hadoop.fs.Path(folder)
    system = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(hadoop)
    file = jvm.org.apache.hadoop.fs.Path(f"{folder}/{number:012d}")
    try:
        if system.getScheme() == "file":  # Hadoop's own local file system looks first and creates then
            plain = jvm.java.nio.file.Paths.get(file.toUri().getPath(), gateway.new_array(jvm.String, 0))
            jvm.java.nio.file.Files.createFile(plain, gateway.new_array(jvm.java.nio.file.attribute.FileAttribute, 0))
        else:
            system.create(file, False).close()
        return True
    except Py4JJavaError as error:
        if "FileAlreadyExists" not in error.java_exception.getClass().getName():
            raise
        return False


def lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All JSON lines below path, in whatever folders writers made."""
    return spark.read.schema(schema).option("recursiveFileLookup", "true").json(path)


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def envelopes(spark: SparkSession, path: str) -> DataFrame:
    """Every envelope ever written below path; lines that cannot be read are left out."""
    if not exists(spark, f"{path}/envelope"):
        return spark.createDataFrame([], SHAPE)
    return lines(spark, f"{path}/envelope", SHAPE).where("generated_at is not null and fact_count is not null and version is not null")


def read_envelope(spark: SparkSession, path: str) -> DataFrame:
    """The current envelope of a fact, or the empty one, dated to the epoch, where there is none or it cannot be read."""
    empty = spark.createDataFrame([(EPOCH, 0, "{}", None, 0)], SHAPE)
    return envelopes(spark, path).unionByName(empty).orderBy(F.desc("number"), F.desc("generated_at"), "version").limit(1)


def read_facts(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """The facts of the current envelope; none where there is none."""
    version = read_envelope(spark, path).first()["version"]
    return spark.createDataFrame([], schema) if version is None else spark.read.schema(schema).parquet(f"{path}/facts/{version}")


def read_count(spark: SparkSession, path: str) -> int:
    return read_envelope(spark, path).first()["fact_count"]
