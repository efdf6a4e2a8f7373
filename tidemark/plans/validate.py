"""Validation of records of any origin against a class: typed fields, unknown fields, messages, coverage. Rows of a map of texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.plans.catalogue import CLASSES, FIELDS, required

# Fixed value: the field that holds what a class has no place for.
UNMAPPED = "unmapped"


def _of_class(class_uid: Column, value) -> Column:
    return reduce(lambda c, uid: c.when(class_uid == uid, value(uid)), CLASSES, F)


def validate(df: DataFrame, class_col: str, record_col: str, strict: bool = False, now_ms: int | None = None) -> DataFrame:
    """Adds `coerced` and `unmapped` (maps of texts), `errors`, `coverage` to records (`record_col`: map of texts).

    A field that the class hasn't goes to `unmapped`, or is an error if `strict`; `coverage` is the share of typed
    fields among typed and unmapped ones (1 if there are none).
    """
    uid, record = F.col(class_col), F.col(record_col)
    names = _of_class(uid, lambda u: F.array(*map(F.lit, sorted(CLASSES[u]))))
    needed = _of_class(uid, lambda u: F.array(*map(F.lit, required(u))).cast("array<string>"))
    df = df.withColumns({"__names": F.coalesce(names, F.array().cast("array<string>")), "__needed": F.coalesce(needed, F.array().cast("array<string>"))})
    kinds = F.create_map(*(F.lit(x) for kv in FIELDS.items() for x in kv))

    def typed(k: Column, v: Column) -> Column:
        kind = F.try_element_at(kinds, k)
        return reduce(lambda c, t: c.when(kind == t, S.coerce(v, t, now_ms).cast("string")), sorted(set(FIELDS.values())), F)

    known = F.map_filter(record, lambda k, v: F.array_contains("__names", k) & v.isNotNull())
    df = df.withColumn("__typed", F.transform_values(known, typed))
    unknown = F.map_filter(record, lambda k, v: ~F.array_contains("__names", k))
    wrong = F.transform(F.map_keys(F.map_filter("__typed", lambda k, v: v.isNull())), lambda k: F.concat(k, F.lit(": not a valid "), F.try_element_at(kinds, k)))
    missing = F.transform(F.filter("__needed", lambda n: ~F.coalesce(F.map_contains_key("__typed", n), F.lit(False))), lambda n: F.concat(n, F.lit(": required")))
    strange = F.transform(F.map_keys(unknown), lambda k: F.concat(k, F.lit(": not a field of the class"))) if strict else F.array().cast("array<string>")
    df = df.withColumns({
        "coerced": F.map_filter("__typed", lambda k, v: v.isNotNull()), "unmapped": F.create_map().cast("map<string,string>") if strict else unknown, "errors": F.array_sort(F.concat(wrong, missing, strange)),
    })
    total = F.size("coerced") + F.size("unmapped")
    return df.withColumn("coverage", F.when(total == 0, 1.0).otherwise(F.size("coerced") / total)).drop("__names", "__needed", "__typed")


def unknown_fields(names: Column, class_uid: int) -> Column:
    """The names that a class hasn't, in order."""
    return F.array_sort(F.array_except(names, F.array(*map(F.lit, [*CLASSES[class_uid], UNMAPPED]))))
