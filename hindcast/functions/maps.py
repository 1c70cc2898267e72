"""Expressions on the nested form of the feature store: ``{date: {feature: value}}``."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from hindcast.functions.types import as_column


def latest_snapshot(snapshots: Column | str, date: Column | str) -> Column:
    """Inner map of the newest key not after ``date``; NULL when there is none.

    Keys are ``yyyy-MM-dd`` strings, whose text order is their date order.
    """
    snapshots = as_column(snapshots)
    limit = F.date_format(as_column(date), "yyyy-MM-dd")
    known = F.filter(F.map_keys(snapshots), lambda k: k <= limit)
    return F.try_element_at(snapshots, F.array_max(known))


def merge_maps(maps: Sequence[Column | str]) -> Column:
    """One map out of several; for a key found twice the later map wins. NULL maps are skipped."""
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))
    cols = [F.coalesce(as_column(m), empty) for m in maps]

    def overlay(base: Column, top: Column) -> Column:
        kept = F.map_filter(base, lambda k, _: ~F.map_contains_key(top, k))
        return F.map_concat(kept, top)

    return reduce(overlay, cols)


def map_to_vector(values: Column | str, names: Sequence[str]) -> Column:
    """Array with one value per name, 0 where the map is NULL or has no such key."""
    values = as_column(values)
    keys = F.array(*[F.lit(n) for n in names])
    return F.transform(keys, lambda n: F.coalesce(F.try_element_at(values, n), F.lit(0)))


def vector_to_columns(vector: Column | str, names: Sequence[str]) -> list[Column]:
    """One named column per array element, for a single ``select``."""
    vector = as_column(vector)
    return [F.coalesce(F.get(vector, F.lit(i)), F.lit(0)).alias(n) for i, n in enumerate(names)]
