"""Where jobs keep what they cut lineage with, and connected components of link tables."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir or that the session was given; on one machine (tests) a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def keep(df: DataFrame) -> DataFrame:
    """A checkpoint of `df` in the shared folder of spark.checkpoint.dir."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(_folder(spark))
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """`df` as a compressed Parquet table in the shared folder, read again."""
    spark = df.sparkSession
    path = f"{_folder(spark)}/written-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def released(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing will read again."""
    for df in tables:
        spark = df.sparkSession
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/written-" not in path:
                raise ValueError(f"not a written table: {path}")
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: Bits of a bitmap: 16 for each key, within these bounds (8 MB at most).
BITS = (1 << 16, 1 << 26)


def bitmap(keys: DataFrame) -> np.ndarray:
    """A bitmap of distinct 64-bit `key`s, by their lowest bits; summed by Spark word by word, so what reaches the driver is bounded by BITS."""
    n = keys.count()
    bits = min(BITS[1], max(BITS[0], 1 << (16 * max(1, n)).bit_length()))
    at = F.col("key").bitwiseAND(F.lit(bits - 1))
    words = keys.groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(key & 63 AS INT))")).alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[np.asarray(words["word"])] = np.asarray(words["bits"]).view(np.uint64)
    return out


def in_bitmap(known: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which 64-bit keys a bitmap may hold: all that it was made of, and few others."""
    at = keys & np.uint64(64 * len(known) - 1)
    return ((known[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)


def components(links: DataFrame) -> DataFrame:
    """The least node that each linked node reaches: rows (`node`, `root`) from links (`u`, `v`).

    Alternates large-star and small-star steps until nothing changes; rounds grow with the
    logarithm of the number of nodes. Each round is two aggregations and two joins of links,
    and is written; the driver sees a count and a sum for each round. Self-links and
    repeated links do no harm.
    """
    edges = written(links.filter("u <> v").select(F.greatest("u", "v").alias("v"), F.least("u", "v").alias("u")).distinct())
    last = None
    while True:
        both = edges.select(F.col("u").alias("a"), F.col("v").alias("b")).union(edges.select(F.col("v").alias("a"), F.col("u").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.filter("b > a").join(least, "a").filter("b <> m").select(F.col("m").alias("u"), F.col("b").alias("v"))
        large = large.distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        pulled = large.join(least, "v").filter("u <> m").select(F.col("m").alias("u"), F.col("u").alias("v"))
        new = written(pulled.union(least.select(F.col("m").alias("u"), "v")).distinct())
        state = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        released(edges)
        edges = new
        if state == last:
            return edges.select(F.col("v").alias("node"), F.col("u").alias("root")).union(edges.select(F.col("u").alias("node"), F.col("u").alias("root"))).distinct()
        last = state
