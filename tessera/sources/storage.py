"""The folder that the driver and all executors share, and tables written there to end a lineage."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a new folder in local mode, an error on a cluster."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/tessera-{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """df by way of a table in the shared folder: its lineage ends here, and a lost executor costs no recompute."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_manifest(spark: SparkSession, paths: list[str]) -> dict:
    """What the files below some paths are: files, bytes, newest (microseconds), and a digest over each one's path, size and time.

    Spark lists them; contents aren't read. Any file that is added, removed or rewritten changes the digest.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select("path", "length", F.unix_micros("modificationTime").alias("at"))
    each = F.xxhash64("path", "length", "at").cast("decimal(38,0)")
    # The names are few and narrow beside what the files hold, so one task sums them, without a shuffle.
    found = files.coalesce(1).agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.max("at").alias("newest"), F.sum(each).cast("string").alias("digest")).first()
    return found.asDict()


def kept(spark: SparkSession, name: str, frames: Callable[[], dict[str, tuple[DataFrame, list[str]]]], paths: list[str]) -> dict[str, DataFrame]:
    """Frames as tables in the shared folder, each sorted by the columns given with it: made and written once for each state of
    the files below paths, then read by their stored schemas. A run that dies leaves no mark that its tables are whole, and the
    next one writes others."""
    named = hashlib.md5("\n".join([name, *paths, file_manifest(spark, paths)["digest"] or ""]).encode()).hexdigest()
    mark = f"{shared_folder(spark)}/{name}-{named}"
    try:
        said = json.loads(spark.read.text(mark).first().value)
    except AnalysisException:
        said = {"at": new_folder(spark, name), "schemas": {}}
        for table, (df, key) in frames().items():
            (df.repartitionByRange(*key).sortWithinPartitions(*key) if key else df).write.parquet(f"{said['at']}/{table}")
            said["schemas"][table] = df.schema.json()
        spark.range(1).select(F.lit(json.dumps(said))).write.mode("overwrite").text(mark)
    return {table: spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(f"{said['at']}/{table}") for table, schema in said["schemas"].items()}


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as there are cores at least, for narrow work on few files; a larger input stays where it lies."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
