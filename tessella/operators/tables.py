"""Reading keyed tables: by id, in order, for an owner, with chosen metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def by_ids(table: DataFrame, key: str, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with the wanted keys, wanted keys that aren't there)."""
    w = wanted.select(F.col(key)).distinct()
    return table.join(w, key, "left_semi"), w.join(table.select(key), key, "left_anti")


def listed(table: DataFrame, key: str, **equal) -> DataFrame:
    """Rows in the order of the key, with equality filters on columns that are given."""
    for column, value in equal.items():
        if value is not None:
            table = table.where(F.col(column) == value)
    return table.orderBy(key)


def owned(table: DataFrame, user: str, column: str = "owner") -> DataFrame:
    """Rows of one owner; rows without an owner are nobody's."""
    return table.where(F.col(column) == user)


def owned_view(spark: SparkSession, table: DataFrame, user: str, name: str, column: str = "owner") -> None:
    """A view that shows the rows of one owner only."""
    owned(table, user, column).createOrReplaceTempView(name)


def projected(metadata: Column, keys: list[str]) -> Column:
    """The listed keys of a map that have a value."""
    return F.map_filter(metadata, lambda k, v: k.isin(*keys) & v.isNotNull())


def partitions_agree(whole: DataFrame, parts: list[DataFrame], key: str) -> DataFrame:
    """(key, problem): keys in no part, in more than one, or in a part but not in the whole."""
    tagged = None
    for part in parts:
        own = part.select(key).distinct()
        tagged = own if tagged is None else tagged.unionByName(own)
    n = tagged.groupBy(key).agg(F.count("*").alias("n"))
    j = whole.select(F.col(key), F.lit(1).alias("w")).distinct().join(n, key, "full_outer")
    problem = F.when(F.col("n").isNull(), "in_no_part").when(F.col("w").isNull(), "not_in_whole").when(F.col("n") > 1, "in_many_parts")
    return j.select(key, problem.alias("problem")).where("problem is not null")
