"""Quality rules by distribution divergence, in DataFrame functions only.

A document's histograms of character classes and of common words are compared with
its language's reference by the Jensen-Shannon distance (base 2, in [0, 1]). The
references are counted over the whole table: one row per known language and one for
all others, so the table that is broadcast has at most len(COMMON_WORDS) + 1 rows.
Short documents (`min_words`) are exempt from the distances and add nothing to the
references. Two base rules reject first: fewer than `least_words` words, or too
many words in repeated five-word windows.

The text is read twice (references, then verdicts) and never shuffled.

Defined results: null and empty texts have no words, so the base rules reject them;
an unknown or null language uses the row of all others; without a reference (an
empty table, or only short documents) the distances are 0; repeated rows are judged
alike; other columns pass through untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Frequent words of each known language.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "it", "on", "for", "was"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "que", "est", "pour"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "ist", "des", "auf"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un"],
}
WORD_BREAK = "[ \\t-\\r]+"
#: Character classes, in the order in which they are taken out of a text; what is left (letters beyond ASCII, other signs) is the last class.
CLASSES = {"lower": "[a-z]+", "space": WORD_BREAK, "upper": "[A-Z]+", "digit": "[0-9]+", "point": "[.,;:!?'\"()-]+", "symbol": "[#*$%&|<>]+"}
LEAST_WORDS, MOST_REPEATED_PERCENT, WINDOW = 10, 20, 5
#: A document of n words may be `most` + ALLOWANCE / sqrt(n) away from its reference, as short texts scatter more.
MIN_WORDS, MOST_CLASS_DISTANCE, MOST_WORD_DISTANCE, ALLOWANCE = 50, 0.25, 0.23, 0.5
_P = "__quality_"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once; Catalyst would copy it to each of its uses."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, WORD_BREAK), lambda w: w != "")


def _language(lang: Column) -> Column:
    return F.when(lang.isin(*COMMON_WORDS), lang).otherwise("other")


def class_counts(text: Column) -> Column:
    """Characters of each class; a class is taken out of what the ones before left."""
    def rest(left: Column, patterns: list[str]) -> Column:
        if not patterns:
            return F.array(F.length(left).cast("long"))
        return _let(F.regexp_replace(left, patterns[0], ""), lambda x: F.concat(F.array((F.length(left) - F.length(x)).cast("long")), rest(x, patterns[1:])))

    return rest(text, list(CLASSES.values()))


def word_counts(words: Column, language: Column) -> Column:
    """Counts of the language's common words, and of all others."""
    listed = reduce(lambda c, x: c.when(language == x[0], F.array(*map(F.lit, x[1]))), COMMON_WORDS.items(), F).otherwise(F.array().cast("array<string>"))

    def counts(known: Column) -> Column:
        common = F.filter(F.transform(words, F.lower), lambda w: F.array_contains(known, w))
        each = lambda c: F.concat(F.transform(known, lambda s: F.size(F.filter(c, lambda w: w == s)).cast("long")), F.array((F.size(words) - F.size(c)).cast("long")))
        return _let(common, each)

    return _let(listed, counts)


def repeated_words(words: Column) -> Column:
    """The number of words in windows of WINDOW words that the text has twice or more."""
    def windows(hashes: Column) -> Column:
        # get() reads one element; slice() would copy the whole array for every window
        n = F.size(hashes) - WINDOW
        at = lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(WINDOW)))
        return F.when(n >= 1, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), at)).otherwise(F.array().cast("array<bigint>"))

    def covered(places: Column) -> Column:
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach"))
        step = lambda a, p: F.struct((a["n"] + WINDOW - F.greatest(F.lit(0), a["reach"] - p)).alias("n"), (p + WINDOW).alias("reach"))
        return F.aggregate(places, start, step, lambda a: a["n"])

    def twice(ordered: Column) -> Column:
        beside = lambda j: F.get(ordered, j)["h"]
        found = F.filter(ordered, lambda e, j: F.coalesce(beside(j + 1) == e["h"], F.lit(False)) | F.when(j > 0, beside(j - 1) == e["h"]).otherwise(False))
        return _let(F.sort_array(F.transform(found, lambda e: e["i"])), covered)

    def count(h: Column) -> Column:
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), _let(ordered, twice)).otherwise(0)

    return _let(_let(F.transform(words, lambda w: F.xxhash64(w)), windows), count).cast("long")


def references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_words: int = MIN_WORDS) -> DataFrame:
    """The summed histograms of each known language, and of all others: `language`, `class_counts`, `word_counts`."""
    most = max(map(len, COMMON_WORDS.values())) + 1
    text, language = F.coalesce(F.col(text_col), F.lit("")), _language(F.col(lang_col))
    counted = _let(words_of(text), lambda w: F.when(F.size(w) >= min_words, F.struct(class_counts(text).alias("c"), word_counts(w, language).alias("w"))))
    df = docs.select(language.alias("language"), counted.alias("x"))
    sums = [F.sum(F.get(f"x.{k}", F.lit(i))).alias(f"{k}{i}") for k, n in (("c", len(CLASSES) + 1), ("w", most)) for i in range(n)]
    return df.groupBy("language").agg(*sums).filter("c0 IS NOT NULL").select(
        "language",
        F.array(*(f"c{i}" for i in range(len(CLASSES) + 1))).alias("class_counts"),
        F.filter(F.array(*(f"w{i}" for i in range(most))), lambda x: x.isNotNull()).alias("word_counts"),
    )


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two arrays of counts; 0 if either has no counts."""
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, b: a + b)
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)

    def distance(t: Column) -> Column:
        terms = F.zip_with(F.transform(p, lambda x: x / t["p"]), F.transform(q, lambda x: x / t["q"]), lambda x, y: (part(x, (x + y) / 2) + part(y, (x + y) / 2)) / 2)
        return F.when((t["p"] > 0) & (t["q"] > 0), F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, b: a + b))))

    return F.coalesce(_let(F.struct(total(p).alias("p"), total(q).alias("q")), distance), F.lit(0.0))


def assess(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    min_words: int = MIN_WORDS,
    most_class_distance: float = MOST_CLASS_DISTANCE,
    most_word_distance: float = MOST_WORD_DISTANCE,
    refs: DataFrame | None = None,
) -> DataFrame:
    """The rows of `docs`, each with a struct `quality` of its measures and its verdict (`kept`)."""
    refs = references(docs, text_col, lang_col, min_words) if refs is None else refs
    refs = refs.select(F.col("language").alias(f"{_P}lang"), F.col("class_counts").alias(f"{_P}ref_classes"), F.col("word_counts").alias(f"{_P}ref_words"))
    text, language = F.coalesce(F.col(text_col), F.lit("")), _language(F.col(lang_col))
    df = docs.withColumn(f"{_P}lang", language).join(F.broadcast(refs), f"{_P}lang", "left")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \\t-\\r]"))

    def verdict(m: Column) -> Column:
        failed = (m["n"] < LEAST_WORDS) | (100 * m["repeated"] > MOST_REPEATED_PERCENT * m["n"])
        slack = ALLOWANCE / F.sqrt(m["n"])
        near = (m["n"] < min_words) | ((m["by_class"] <= most_class_distance + slack) & (m["by_word"] <= most_word_distance + slack))
        return F.struct(
            m["n"].alias("n_words"), m["word_chars"].alias("word_chars"), m["symbols"].alias("n_symbols"), m["dup_lines"].alias("n_dup_lines"), m["repeated"].alias("n_repeat_words"),
            failed.alias("base_failed"), (~failed & near).alias("kept"), F.round(m["by_class"], 4).alias("class_distance"), F.round(m["by_word"], 4).alias("word_distance"),
        )

    def measures(w: Column, classes: Column) -> Column:
        of = list(CLASSES)
        dup = _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
        values = F.struct(
            F.size(w).cast("long").alias("n"), (F.length(text) - F.get(classes, F.lit(of.index("space")))).cast("long").alias("word_chars"), F.get(classes, F.lit(of.index("symbol"))).alias("symbols"),
            dup.cast("long").alias("dup_lines"), repeated_words(w).alias("repeated"), js_distance(classes, F.col(f"{_P}ref_classes")).alias("by_class"),
            _let(word_counts(w, F.col(f"{_P}lang")), lambda c: js_distance(c, F.col(f"{_P}ref_words"))).alias("by_word"),
        )
        return _let(values, verdict)

    judged = _let(words_of(text), lambda w: _let(class_counts(text), lambda c: measures(w, c)))
    return df.select(*docs.columns, judged.alias("quality" if "quality" not in docs.columns else f"{_P}out"))


def keep(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", **limits: float) -> DataFrame:
    """The rows of `docs` that the rules keep, with the columns of `docs` only."""
    judged = assess(docs, text_col, lang_col, **limits)
    return judged.filter(F.col(judged.columns[-1])["kept"]).select(*docs.columns)
