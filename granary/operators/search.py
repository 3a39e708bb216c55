"""Faceted search, unions by key, plans, and edits of plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def matches(needle: str, fields: list[Column], facets: list[tuple[Column, str]] = (), within: list[tuple[Column, str]] = ()) -> Column:
    """The trimmed needle as a substring of the lower-cased fields that are not empty, every facet equal, and every array
    with its wanted value ("all": any)."""
    text = F.lower(F.array_join(F.filter(F.array(*fields), lambda x: x.isNotNull() & (x != "")), " "))
    out = F.contains(text, F.lit(needle.strip().lower()))
    for column, wanted in facets:
        if wanted != "all":
            out = out & F.coalesce(column == wanted, F.lit(False))
    for array, wanted in within:
        if wanted != "all":
            out = out & F.coalesce(F.array_contains(array, wanted), F.lit(False))
    return out


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key, with first_at, the place of its first."""
    spec = Window.partitionBy(key)
    numbered = rows.withColumn("first_at", F.min(order).over(spec)).withColumn("_nth", F.row_number().over(spec.orderBy(F.col(order).desc())))
    return numbered.where("_nth = 1").drop("_nth")


def first_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_nth = 1").drop("_nth")


def next_position(items: DataFrame, group: str, order: str) -> DataFrame:
    """Positions from 0 in each group."""
    return items.withColumn("position", (F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1).cast("long"))


def first_in_order(rows: DataFrame, order: list, n: int) -> DataFrame:
    """The first n rows in an order; never the first that happen to be read."""
    return rows.orderBy(*order).limit(n)


def in_order_of(rows: DataFrame, inputs: DataFrame, key: str, place: str) -> DataFrame:
    """rows with the place of their key among the inputs, sorted by it; unknown keys come last."""
    return rows.join(inputs.select(key, place), key, "left").orderBy(F.col(place).asc_nulls_last(), key)


def collated(rows: DataFrame, column: str) -> DataFrame:
    """rows sorted as readers expect it: by the Unicode collation, not by code points."""
    return rows.orderBy(F.collate(F.col(column), "UNICODE"), column)


def collated_places(rows: DataFrame, group: str, column: str) -> DataFrame:
    """rows with place: from 1 within each group, in collated()'s order."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(F.collate(F.col(column), "UNICODE"), column)))


def utf16_key(text: Column) -> Column:
    """A key that sorts texts by UTF-16 code units: characters beyond U+FFFF come before those from U+E000 on."""
    return F.encode(text, "UTF-16BE")
