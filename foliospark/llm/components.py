"""Connected components of a graph that is held as a DataFrame of edges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, gathered


def least_linked(n: int, batches) -> np.ndarray:
    """For each of n places the least place that links (batches of pairs) lead to, itself included."""
    label = np.arange(n)
    for a, b in batches:
        while True:
            x, y = label[a], label[b]
            apart = x != y
            if not apart.any():
                break
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            # Each component hooks onto one with a smaller label.
            top, at = np.unique(np.maximum(x, y), return_index=True)
            label[top] = np.minimum(x, y)[at]
            while (flat := label[label]).tobytes() != label.tobytes():
                label = flat
    return label


#: Edges that a task contracts at a time.
CONTRACTED = 1 << 20


def _contract(batches):
    """For mapInArrow over edges (a, b) of integers: as few as connect the same nodes, each to the least of its component here."""

    def out(held: list[np.ndarray]):
        ends = np.concatenate(held, axis=1)
        nodes, at = np.unique(ends, return_inverse=True)
        a, b = at.reshape(ends.shape)
        least = least_linked(len(nodes), [(a, b)])
        own = np.nonzero(least != np.arange(len(nodes)))[0]
        return pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[least[own]])], names=["a", "b"])

    held, size = [], 0
    for batch in batches:
        held.append(np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(2)]))
        size += batch.num_rows
        if size >= CONTRACTED:
            yield out(held)
            held, size = [], 0
    if size:
        yield out(held)


def _measure(edges: DataFrame) -> tuple[int, int]:
    """A count and an order-free sum of hashes: equal for equal sets of edges."""
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], int(row["h"] or 0)


def stars(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Rows (a, b) with b the smallest node of a's component, for each node a that isn't itself the smallest.

    ``edges``: columns a, b of one ordered type; direction, repeats and loops don't
    matter. Alternates large-star and small-star steps. A step groups by a node and
    takes a minimum, which combines before its shuffle, then joins it back; no
    neighbour list is ever held together, so a node with very many neighbours is
    no more than a skewed join. Each round is checkpointed, in as many partitions as
    its edges need; only two numbers a round reach the driver. Before the first round,
    each task contracts the edges that it has, if their nodes are integers. No edges: no
    rows.
    """
    edges = checkpointed(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _measure(edges)
    kind = dict(edges.dtypes)["a"]
    if before[0] and kind in ("int", "bigint"):
        edges = checkpointed(gathered(edges, before[0]).mapInArrow(_contract, f"a {kind}, b {kind}"))
        before = _measure(edges)
    for _ in range(max_rounds):
        if not before[0]:
            return edges
        n = before[0]
        edges = gathered(edges, n)
        both = gathered(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), 2 * n)
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # Large star: each node hands its larger neighbours its smallest one. The edge
        # (a, b) has a > b, so b's smallest is what reaches a.
        large = edges.join(least.withColumnRenamed("a", "b"), "b").select("a", F.col("m").alias("b")).where("a != b")
        # Small star: each node ties itself and its smaller neighbours to the smallest of these.
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        tied = large.join(lower, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        fresh = gathered(tied.unionByName(lower.select("a", F.col("m").alias("b"))).where("a != b"), 2 * n).distinct()
        edges = checkpointed(gathered(fresh, 2 * n))
        after = _measure(edges)
        if after == before:
            return edges
        before = after
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
