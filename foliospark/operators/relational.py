"""General relational operators that Spark has no single method for, and the reports over the star schema.

These are additions beyond document structure.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, right_at: str, columns: list[str]) -> DataFrame:
    """Each left row with the columns of the key's latest right row that isn't later; nulls if there is none.

    One sort of both sides together by key and time, no pairs: the last right row
    seen is carried along. Of right rows at one time, the largest columns count.
    """
    row = F.struct(*(F.col(c) for c in columns))
    a = left.select(F.col(key).alias("_k"), F.col(at).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_left"), F.lit(None).cast(right.select(row.alias("r")).schema["r"].dataType).alias("_right"))
    b = right.select(F.col(key).alias("_k"), F.col(right_at).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_left"].dataType).alias("_left"), row.alias("_right"))
    order = Window.partitionBy("_k").orderBy("_t", "_side", "_right").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = a.unionByName(b).withColumn("_last", F.last("_right", ignorenulls=True).over(order)).where("_side = 1")
    return found.select("_left.*", *(F.col(f"_last.{c}").alias(f"asof_{c}") for c in columns))


def in_interval(points: DataFrame, intervals: DataFrame, key: str, at: str, start: str, end: str, width: int) -> DataFrame:
    """Points with the intervals of their key that hold them, start included, end not.

    Both sides are dealt out by key and bin of ``width``; an interval stands in each bin it touches.
    """
    left = points.withColumn("_bin", F.floor(F.col(at) / width))
    right = intervals.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))))
    return left.join(right, [key, "_bin"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_bin")


def exact_sum(value: Column, scale: int = 4) -> Column:
    """A sum that doesn't depend on the order of its rows."""
    return F.sum(value.cast(f"decimal(28,{scale})")).cast("double")


def reachable(edges: DataFrame, start: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(node): all that edges (src, dst) lead to from ``start`` (node), itself included; a round joins and writes only what is new."""
    found = fresh = start.select("node").distinct().checkpoint()
    for _ in range(max_rounds):
        fresh = edges.join(fresh, edges["src"] == fresh["node"]).select(F.col("dst").alias("node")).distinct().join(found, "node", "left_anti").checkpoint()
        if fresh.isEmpty():
            return found
        found = found.unionByName(fresh)
    raise RuntimeError("the search did not settle")
