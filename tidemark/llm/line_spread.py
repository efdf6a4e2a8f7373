"""Cross-site boilerplate removal by the spread of lines over sites, in DataFrame functions only.

A line's spread is the number of distinct sites with it. Occurrences are first aggregated
to one row for each line hash (128 bits) and site, with the first occurrence; this table is
written and read by all that follows. Each line hash gets a HyperLogLog sketch of its
sites; sketches merge by aggregation, before and after the exchange. A spread far from the
threshold is settled by the sketch. The lines near it (within NEAR standard errors, or one
site) get exact counts of their rows in the table of lines and sites, which has few for
each of them. Lines of `min_sites` sites or more are boilerplate: all occurrences but the
first (least document id, then place) go.

What goes is joined with its occurrences: broadcast if it has MOST_BROADCAST lines at most,
else over SALTS copies, so a line that a third of all documents hold is met by many tasks.

Defined results: null texts stay null, empty ones empty; blank lines always stay; lines
are compared without white space at their ends; a null site counts as one site; a null id
comes after all others; rows with the same id and text keep and lose the same lines; an
empty table gives an empty result; other columns pass through untouched, but for columns
named as the counts where these are asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import written

MIN_SITES = 3
#: Sketches of 2**LG registers have a relative standard error of about 1.04 / 2**(LG / 2).
LG, NEAR, SALTS = 8, 4, 16
MOST_BROADCAST = 200_000
_BLANKS = " \t\r\x0b\x0c"
_P = "__lines_"


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Adds null-safe row keys: the id as text, and a hash of the text."""
    return docs.withColumn(f"{_P}id", F.coalesce(F.col(id_col).cast("string"), F.lit("-"))).withColumn(f"{_P}text", F.xxhash64(F.col(text_col)))


def _lines(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """A row for each line that isn't blank: row key, place, site, and the line's two hashes."""
    at = F.posexplode(F.split(F.col(text_col), "\n")).alias("place", "line")
    df = _keyed(docs, id_col, text_col).select(f"{_P}id", f"{_P}text", F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(site_col).cast("string"), F.lit("")).alias("site"), at)
    df = df.withColumn("line", F.trim(F.col("line"), F.lit(_BLANKS))).filter("line <> ''")
    return df.select(f"{_P}id", f"{_P}text", "doc", "site", "place", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def spreads(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """Boilerplate lines: hashes (`h1`, `h2`), first occurrence (`doc`, `place`), and whether the sketch settled it (`by_sketch`)."""
    occurrence = F.struct(F.col("doc").isNull().alias("none"), "doc", "place")
    by_site = written(_lines(docs, id_col, text_col, site_col).groupBy("h1", "h2", "site").agg(F.min(occurrence).alias("first")))
    known = by_site.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", F.lit(LG)).alias("sketch"), F.min("first").alias("first"))
    width = max(1.0, NEAR * 1.04 / 2 ** (LG / 2) * min_sites)
    known = written(known.withColumn("spread", F.hll_sketch_estimate("sketch")).filter(F.col("spread") >= min_sites - width).drop("sketch"))
    near = known.filter(F.col("spread") <= min_sites + width).select("h1", "h2")
    exact = by_site.join(near, ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.count("*").alias("sites")).filter(F.col("sites") >= min_sites)
    settled = known.filter(F.col("spread") > min_sites + width).select("h1", "h2", "first", F.lit(True).alias("by_sketch"))
    counted = known.join(exact, ["h1", "h2"]).select("h1", "h2", "first", F.lit(False).alias("by_sketch"))
    return settled.unionByName(counted).select("h1", "h2", "first.doc", "first.place", "by_sketch")


def remove_boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, counts: bool = False) -> DataFrame:
    """The rows of `docs` without boilerplate lines; with `counts` also `n_lines` and `n_removed`."""
    gone = written(spreads(docs, id_col, text_col, site_col, min_sites).withColumnsRenamed({"doc": "first_doc", "place": "first_place"}))
    lines = _lines(docs, id_col, text_col, site_col)
    if gone.count() <= MOST_BROADCAST:
        again = lines.join(F.broadcast(gone), ["h1", "h2"])
    else:
        salted = gone.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        again = lines.withColumn("salt", F.pmod(F.xxhash64(f"{_P}id"), F.lit(SALTS)).cast("int")).join(salted, ["h1", "h2", "salt"])
    again = again.filter(~(F.col("doc").eqNullSafe(F.col("first_doc")) & (F.col("place") == F.col("first_place"))))
    places = again.groupBy(f"{_P}id", f"{_P}text").agg(F.collect_set("place").alias(f"{_P}places"))
    df = _keyed(docs, id_col, text_col).join(places, [f"{_P}id", f"{_P}text"], "left")
    rest = F.filter(F.split(F.col(text_col), "\n"), lambda _, i: ~F.array_contains(F.col(f"{_P}places"), i))
    text = F.when(F.col(f"{_P}places").isNull(), F.col(text_col)).otherwise(F.array_join(rest, "\n"))
    out = [text.alias(c) if c == text_col else F.col(c) for c in docs.columns if not counts or c not in ("n_lines", "n_removed")]
    if counts:
        out += [F.coalesce(F.size(F.split(F.col(text_col), "\n")), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size(f"{_P}places"), F.lit(0)).cast("long").alias("n_removed")]
    return df.select(*out)
