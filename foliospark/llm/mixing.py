"""Mixing sources to target weights by systematic sampling, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, checkpointed, narrow, text_or_empty

#: Rows that a window of prefix sums takes at once, about.
CHUNK_ROWS = 4096


def word_count(text: Column) -> Column:
    """Words between white space; null has none."""
    return F.size(F.array_remove(F.split(text_or_empty(text), SPACE), "")).cast("long")


def _placed(rows: DataFrame) -> DataFrame:
    """``place``: each source's rank from 1 in code-point order, null last, without a task that sees all sources.

    Sources are dealt out by range; the driver adds up the ranges' sizes.
    """
    order = [F.col("source").isNull(), F.col("source")]
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = checkpointed(rows.repartitionByRange(width, *order).withColumn("part", F.spark_partition_id()))
    before, total = [], 0
    for row in parts.groupBy("part").count().orderBy("part").collect():  # a row a range
        before += [F.lit(row["part"]), F.lit(total)]
        total += row["count"]
    start = F.create_map(*before)[F.col("part")] if before else F.lit(0)
    return parts.withColumn("place", start + F.row_number().over(Window.partitionBy("part").orderBy(*order))).drop("part")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), ceiling: int = 3) -> DataFrame:
    """(source, source_size, target) for rows (source, source_size), one a source.

    Sources in code-point order, null last, weigh ``weights`` over and over and share
    the sum of all sizes. A target stops at ``ceiling`` times its source's size; the
    excess is shared anew by weight among the others, until none is above.
    """
    shares = F.array(*(F.lit(float(w)) for w in weights))
    rows = _placed(sizes).withColumn("weight", F.element_at(shares, ((F.col("place") - 1) % len(weights) + 1).cast("int"))).drop("place")
    rows = checkpointed(rows.withColumn("cap", ceiling * F.col("source_size").cast("double")))
    total = float(rows.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:
        full = F.col("cap") <= level * F.col("weight")
        row = rows.agg(F.sum(F.when(full, F.col("cap")).otherwise(0.0)).alias("cap"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("weight")).first()
        if not row["weight"]:
            break
        higher = (total - row["cap"]) / row["weight"]
        if higher <= level * (1 + 1e-12):
            break
        level = higher
    return rows.select("source", "source_size", F.least("cap", F.lit(level) * F.col("weight")).alias("target"))


def _uniform(*seed: Column) -> Column:
    """A number in [0, 1) that depends on the seed alone."""
    return F.shiftrightunsigned(F.xxhash64(*seed), 11) / F.lit(float(1 << 53))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), ceiling: int = 3, seed: int = 0, tries: int = 32) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken), a row for each row of ``docs``.

    Each document of a source expects target / source_size copies. The documents of a
    source stand in a fixed random order, by a hash, in chunks; expected
    copies are summed along it, chunk sums first, so that no task holds a source. One
    random offset a source is added, and a copy is taken for each integer boundary
    that a document's span crosses. Of ``tries`` candidate offsets, a source has the
    one whose taken words come nearest its target.

    Reruns agree. Null text has size 0; rows of size 0 may be copied, and take no
    words. A null source is a source, and the last. Null ids and repeated rows are
    rows like any other. Texts of any length count whole; other columns play no part.
    No rows: no rows.
    """
    rows = narrow(docs, doc_id=id_col, text=text_col, source=source_col)
    rows = checkpointed(rows.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("doc_id", "text").alias("tie")))
    return _mixed(rows, weights, ceiling, seed, tries).select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _mixed(rows: DataFrame, weights: tuple[int, ...], ceiling: int, seed: int, tries: int) -> DataFrame:
    """Columns source_size, target, copies for rows (source, size, tie, ...)."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    goal = targets(sizes.select("source", "source_size"), weights, ceiling)
    # Chunks by hash, so that each is small and none holds a source.
    shares = sizes.select(F.col("source").alias("s"), F.ceil(F.col("source_rows") / CHUNK_ROWS).alias("parts"))
    rows = rows.join(shares, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("tie", F.lit(seed)), F.col("parts"))).drop("parts")
    chunks = rows.groupBy("source", "part").agg(F.count(F.lit(1)).alias("rows"))
    order = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = chunks.select("source", "part", F.coalesce(F.sum("rows").over(order), F.lit(0)).alias("before"))
    before = before.join(goal.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    inside = Window.partitionBy("source", "part").orderBy("tie", "size")
    rows = rows.withColumn("n", F.row_number().over(inside))
    before = before.select(*(F.col(c).alias(f"_{c}") if c in ("source", "part") else F.col(c) for c in before.columns))
    rows = rows.join(before, F.col("source").eqNullSafe(F.col("_source")) & (F.col("part") == F.col("_part"))).drop("_source", "_part")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = checkpointed(rows.withColumn("place", F.col("before") + F.col("n")).withColumn("rate", rate).drop("before", "n", "part"))

    def copies(offset: Column) -> Column:
        crossed = F.floor(F.col("place") * F.col("rate") + offset) - F.floor((F.col("place") - 1) * F.col("rate") + offset)
        return F.least(crossed, F.ceil("rate"))  # a sum of doubles may round up to a boundary

    name = F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))
    offsets = [_uniform(name, F.lit(seed), F.lit(k)) for k in range(tries)]
    sums = rows.groupBy("source").agg(F.first("target").alias("target"), *(F.sum(copies(x) * F.col("size")).alias(f"t{k}") for k, x in enumerate(offsets)))
    best = F.array_min(F.array(*(F.struct(F.abs(F.col(f"t{k}") - F.col("target")).alias("d"), offsets[k].alias("offset")) for k in range(tries))))
    chosen = sums.select(F.col("source").alias("s"), best["offset"].alias("offset"))
    return rows.join(chosen, F.col("source").eqNullSafe(F.col("s"))).withColumn("copies", copies(F.col("offset"))).drop("s", "tie", "place", "rate", "offset")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), ceiling: int = 3, seed: int = 0, tries: int = 32) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as ``mixed`` takes it, with all its columns.

    Rows that share id and text share their copies as evenly as whole copies go. Null
    sources are one source, null texts have no words, and null ids and texts of any
    length are taken like others; columns of any name are kept as they are. No rows: no
    rows.
    """
    rows = narrow(docs, doc_id=id_col, text=text_col, source=source_col)
    rows = checkpointed(rows.select("source", word_count(F.col("text")).alias("size"), F.xxhash64("doc_id", "text").alias("tie"), F.xxhash64("doc_id", "text").alias("key")))
    taken = _mixed(rows, weights, ceiling, seed, tries).groupBy("key").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows")).where("copies > 0")
    keyed = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), F.xxhash64(docs[id_col], docs[text_col]).alias("key"))
    found = keyed.join(taken, "key").withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy("key")))
    copies = F.floor(F.col("copies") / F.col("rows")) + (F.col("rank") <= F.col("copies") % F.col("rows")).cast("long")
    found = found.select("row", copies.alias("copies")).where("copies > 0")
    return found.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")
