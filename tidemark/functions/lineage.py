"""How rows are dealt: written tables in the shared folder, where they must come from one dealing, and small unsplittable inputs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or the one that the session was given; on one machine (tests) a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "written") -> DataFrame:
    """`df` as a Parquet table in the shared folder, read again."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def released(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing will read again."""
    for df in tables:
        spark = df.sparkSession
        shared = shared_folder(spark).rstrip("/").rsplit("/", 1)[-1]
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if folder.split("/")[-2] != shared:
                raise ValueError(f"not a written table: {folder}")
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """`df` dealt over all cores if it comes in fewer pieces than there are: rows of one file that can't be split would cost one core all the work per row.

    An input of many pieces, as large ones are, is left as it is, and isn't shuffled. Select the needed columns first.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
