"""Joins in which one key may hold any share of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: A key is hot where it has more than one of so many rows; so there are fewer than that many hot keys.
SHARE = 1000


def unique_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left with the columns of right, whose key does not repeat, as by a left join.

    right's rows for hot keys of left are sent to all tasks, fewer than SHARE of them; other keys meet in a shuffle. Where many rows
    of left have no key, they are not shuffled at all. left is read several times, so it should be stored or cheap.
    """
    added = [f for f in right.schema.fields if f.name != key]
    counts, total = left.groupBy(key).count(), left.count()
    found = counts.where(F.col("count") * SHARE > total).select(key).collect()
    if not found:
        return left.join(right, key, "left").select(*left.columns, *(f.name for f in added))
    hot = F.broadcast(left.sparkSession.createDataFrame([r for r in found if r[0] is not None], StructType([StructField("_hot", left.schema[key].dataType)])))
    own = F.col(key) == F.col("_hot")
    parts = [
        left.join(hot, own, "left_semi").join(F.broadcast(right.join(hot, own, "left_semi")), key, "left"),
        left.where(F.col(key).isNotNull()).join(hot, own, "left_anti").join(right.join(hot, own, "left_anti"), key, "left"),
        left.where(F.col(key).isNull()).select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in added)),
    ]
    return reduce(DataFrame.unionByName, parts).select(*left.columns, *(f.name for f in added))
