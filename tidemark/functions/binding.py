"""Binding of an intermediate value, so that a large expression is built and evaluated once; and expressions that are built once for a session."""

from __future__ import annotations

from collections.abc import Callable, Hashable
from weakref import WeakKeyDictionary

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

_BUILT: WeakKeyDictionary[SparkContext, dict[Hashable, Column]] = WeakKeyDictionary()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once: Catalyst would copy it to each of its uses."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def built(key: Hashable, make: Callable[[], Column]) -> Column:
    """make(), once for each key and session: an expression over columns' names can be used in any plan, and building a large one takes the driver some time."""
    known = _BUILT.setdefault(SparkContext._active_spark_context, {})
    if key not in known:
        known[key] = make()
    return known[key]
