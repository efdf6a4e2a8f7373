"""Finding the files of a table that may hold a text, without opening them: a Bloom filter of trigrams for each file."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.binding import let
from tidemark.operators import store

#: Bits of a file's filter; a file with 100,000 distinct trigrams lets one foreign trigram in ten through.
BITS = 1 << 20
INDEX = "file string, word int, bits bigint"


def _places(grams):
    return F.pmod(F.xxhash64(grams), F.lit(BITS))


def _grams(text):
    # by an array of characters: substr() counts from the text's start each time
    return let(F.split(text, ""), lambda c: F.transform(F.sequence(F.lit(0), F.greatest(F.size(c) - 3, F.lit(0))), lambda i: F.concat(F.get(c, i), F.coalesce(F.get(c, i + 1), F.lit("")), F.coalesce(F.get(c, i + 2), F.lit("")))))


def index(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Rows (`file`, `word`, `bits`): of each file that `df` is read from, the words of its filter that have bits. Case doesn't count.

    Tasks combine the bits of what they read, so a file sends a row for each word at most.
    """
    all_ = F.concat(*(_grams(F.lower(F.coalesce(F.col(c).cast("string"), F.lit("")))) for c in columns))
    at = df.select(F.input_file_name().alias("file"), F.explode(F.array_distinct(all_)).alias("gram")).select("file", _places(F.col("gram")).alias("at"))
    return at.groupBy("file", F.shiftright("at", 6).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias("bits"))


def files_with(index_rows: DataFrame, search: str) -> list[str] | None:
    """The files that may hold `%search%`; None if the search has no trigram and all files may. `%` and `_` are wildcards, so no trigram spans them."""
    parts = [(x,) for x in re.split("[%_]", search) if len(x) > 2]
    if not parts:
        return None
    asked = index_rows.sparkSession.createDataFrame(parts, "part string").select(F.explode(_grams(F.lower("part"))).alias("gram")).select(_places(F.col("gram")).alias("at"))
    masks = asked.groupBy(F.shiftright("at", 6).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias("mask"))
    n = masks.count()
    held = index_rows.join(F.broadcast(masks), "word").filter(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"))  # a row for each trigram of the search at most
    return [r["file"] for r in held.groupBy("file").agg(F.count("*").alias("n")).filter(F.col("n") == n).select("file").collect()]


def search(spark: SparkSession, path: str, index_rows: DataFrame, text: str, **filters) -> DataFrame:
    """store.where(search=text) over the table at `path`, reading the files that may match."""
    files, table = files_with(index_rows, text), spark.read.parquet(path)
    if files is not None:
        table = spark.read.schema(table.schema).option("basePath", path).parquet(*files) if files else table.filter(F.lit(False))
    return store.where(table, search=text, **filters)
