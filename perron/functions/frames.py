"""Frames compared and shown without regard to the order of rows and columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Types that have no order.
UNORDERED = ("map", "variant")


def sorted_columns(df: DataFrame) -> DataFrame:
    """``df`` with its columns in the order of their names."""
    return df.select(*[F.col(f"`{c}`") for c in sorted(df.columns)])


def sortable_columns(df: DataFrame, lists: bool = False) -> list[str]:
    """The columns that rows can be sorted by, by type; lists only if wanted."""
    return [c for c, t in df.dtypes if not t.startswith(UNORDERED) and (lists or not t.startswith("array"))]


def in_order(df: DataFrame) -> DataFrame:
    """``df`` sorted by all its columns that are not lists, and columns by name."""
    by_name = sorted_columns(df)
    keys = sortable_columns(by_name)
    return by_name.orderBy(*[F.col(f"`{c}`") for c in keys]) if keys else by_name


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that the frames hold unequally often, with ``times_a`` and ``times_b``; columns by name.

    A row is compared by the JSON of its values, so lists and structs take part; one aggregation,
    no sort and nothing on the driver.
    """
    if sorted(a.dtypes) != sorted(b.dtypes):
        raise ValueError(f"{sorted(a.dtypes)} and {sorted(b.dtypes)}")
    told = lambda df, x, y: sorted_columns(df).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("row"), F.lit(x).alias("x"), F.lit(y).alias("y"))
    both = told(a, 1, 0).unionByName(told(b, 0, 1))
    return both.groupBy("row").agg(F.sum("x").alias("times_a"), F.sum("y").alias("times_b")).where("times_a <> times_b")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two frames hold the same rows as often, in any order."""
    return sorted(a.dtypes) == sorted(b.dtypes) and not difference(a, b).limit(1).count()
