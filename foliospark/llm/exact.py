"""Exact deduplication through an extendible-hash index on shared files.

Pass 1 makes a narrow entry of each row (hash, digest, id), natively. Entries of one
key are merged before they are shuffled, so a text that fills a third of the table
is a few entries. The directory starts with one bucket and doubles while a bucket of
distinct keys is overfull; it is made from counts of hash prefixes, at most
2 ** max_depth numbers, whatever the table. Keys that occur once need no more.

Pass 2 takes the texts whose keys recur (a bitmap of fixed largest size lets the
rest pass by), merges equal bytes inside each map task, and writes them into the
shared folder by bucket. A bucket's owner reads its records in key order, chains
those with the same hash and compares their bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, checkpointed, narrow, text_or_empty, utf8

#: Bits of the bitmap of recurring keys at most: 16 MiB.
BITMAP_BITS = 1 << 27
#: Bytes of text that a map task merges before it hands them on.
MERGE_BYTES = 32 << 20


def normalised(text: Column) -> Column:
    """Each run of white space becomes one space; null is empty."""
    return F.regexp_replace(text_or_empty(text), SPACE, " ")


class Bitmap:
    """Which of a set's 64-bit keys may be there, in a bounded number of bits; held by the driver and each worker."""

    def __init__(self, keys: DataFrame, column: str):
        spark, n = keys.sparkSession, keys.count()
        self.bits = min(BITMAP_BITS, max(1 << 15, 1 << (16 * n).bit_length()))
        at = F.col(column).bitwiseAND(F.lit(self.bits - 1)) + 1
        parts = keys.groupBy(F.bitmap_bucket_number(at).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bitmap"))
        whole = np.zeros(self.bits // 8, dtype=np.uint8)
        for row in parts.collect():  # 4 KiB each, 16 MiB in all at most
            whole[(row["part"] - 1) * 4096 : row["part"] * 4096] = np.frombuffer(row["bitmap"], dtype=np.uint8)
        self.shared = spark.sparkContext.broadcast(whole)

    def test(self, keys: np.ndarray) -> np.ndarray:
        at = keys & (self.bits - 1)
        return (self.shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)

    def column(self, key: Column) -> Column:
        shared, bits = self.shared, self.bits

        @F.pandas_udf("boolean")
        def there(keys):
            import pandas as pd

            at = keys.to_numpy(dtype=np.int64) & (bits - 1)
            return pd.Series((shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool))

        return there(key)


def directory(counts: dict[int, int], capacity: int, max_depth: int) -> tuple[int, list[int]]:
    """(global depth, the bucket of each directory entry) for counts of keys by their first ``max_depth`` bits.

    One bucket of local depth 0 at first. An overfull bucket splits on its next bit;
    if its local depth is the global depth, the directory doubles first. A bucket of
    local depth ``max_depth`` stays as it is: its keys chain.
    """
    prefix = np.zeros(1 << max_depth, dtype=np.int64)
    for at, n in counts.items():
        prefix[at] = n
    depth, entries, local, size = 0, [0], [0], [int(prefix.sum())]
    span = {0: (0, 1 << max_depth)}
    todo = [0]
    while todo:
        bucket = todo.pop()
        if size[bucket] <= capacity or local[bucket] == max_depth:
            continue
        if local[bucket] == depth:
            entries = [x for x in entries for _ in range(2)]
            depth += 1
        low, high = span[bucket]
        middle, new = (low + high) // 2, len(local)
        local[bucket] += 1
        local.append(local[bucket])
        span[bucket], span[new] = (low, middle), (middle, high)
        size[bucket] = int(prefix[low:middle].sum())
        size.append(int(prefix[middle:high].sum()))
        scale = max_depth - depth
        for i in range(middle >> scale, high >> scale):
            entries[i] = new
        todo += [bucket, new]
    return depth, entries


def _merge(test):
    """For mapInArrow over (doc_id, h, norm): the rows that pass the bitmap, equal bytes merged within the task."""

    def run(batches):
        schema = None
        held: dict[tuple[int, bytes], list] = {}
        size = 0

        def out():
            rows = [(h, norm, first, n) for (h, norm), (first, n) in held.items()]
            held.clear()
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.binary()), pa.array(columns[2], schema.field(0).type), pa.array(columns[3], pa.int64())], names=["h", "norm", "first_id", "n"])

        for batch in batches:
            schema = batch.schema
            batch = batch.filter(pa.array(test(batch.column(1).to_numpy(zero_copy_only=False))))
            for doc_id, h, norm in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2)), strict=True):
                if (own := held.get((h, norm))) is None:
                    held[h, norm] = [doc_id, 1]
                    size += len(norm)
                    if size > MERGE_BYTES:
                        yield out()
                        size = 0
                else:
                    own[0] = doc_id if own[0] is None else own[0] if doc_id is None else min(own[0], doc_id)
                    own[1] += 1
        if held:
            yield out()

    return run


def _chain(batches):
    """For mapInArrow over a bucket owner's (h, norm, first_id, n) in order of h: a row for each different text."""
    key, chain = None, []

    def out(kind):
        return pa.RecordBatch.from_arrays([pa.array([key] * len(chain), pa.int64()), pa.array([hashlib.sha256(norm).digest() for norm, _, _ in chain], pa.binary()), pa.array([first for _, first, _ in chain], kind), pa.array([n for _, _, n in chain], pa.int64())], names=["h", "sha", "keep_id", "group_size"])

    kind = None
    for batch in batches:
        kind = batch.schema.field(2).type
        for h, norm, first, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if h != key:
                if chain:
                    yield out(kind)
                key, chain = h, []
            for link in chain:
                if link[0] == norm:
                    link[1] = first if link[1] is None else link[1] if first is None else min(link[1], first)
                    link[2] += n
                    break
            else:
                chain.append([norm, first, n])
    if chain:
        yield out(kind)


def _index(docs: DataFrame, id_col: str, text_col: str, capacity: int, max_depth: int) -> tuple[DataFrame, DataFrame, Bitmap | None]:
    """(entries, classes, the bitmap of recurring keys or None if there are none)."""
    rows = narrow(docs, doc_id=id_col, text=text_col).select("doc_id", normalised(F.col("text")).alias("norm"))
    rows = rows.select("doc_id", F.xxhash64("norm").alias("h"), "norm")
    entries = checkpointed(rows.select("doc_id", "h", F.unhex(F.sha2("norm", 256)).alias("sha")).groupBy("doc_id", "h", "sha").agg(F.count(F.lit(1)).alias("copies")))
    keys = checkpointed(entries.groupBy("h", "sha").agg(F.min("doc_id").alias("keep_id"), F.sum("copies").alias("group_size")))
    many = keys.where("group_size > 1")
    lone = keys.where("group_size = 1")
    prefix = F.expr(f"shiftrightunsigned(h, {64 - max_depth})")
    counts = {r["at"]: r["count"] for r in many.groupBy(prefix.alias("at")).count().collect()}  # 2 ** max_depth rows at most
    if not counts:
        return entries, keys, None
    depth, buckets = directory(counts, capacity, max_depth)
    bitmap = Bitmap(many.select("h").distinct(), "h")
    kind = dict(entries.dtypes)["doc_id"]
    texts = rows.mapInArrow(_merge(bitmap.test), f"h long, norm binary, first_id {kind}, n long")
    spark = docs.sparkSession
    if depth:
        table = spark.createDataFrame(list(enumerate(buckets)), "at long, bucket long")  # 2 ** max_depth rows at most
        placed = texts.withColumn("at", F.expr(f"shiftrightunsigned(h, {64 - depth})")).join(F.broadcast(table), "at").drop("at")
    else:
        placed = texts.withColumn("bucket", F.lit(0))
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), len(set(buckets)))
    files = checkpointed(placed.repartition(width, "bucket").sortWithinPartitions("bucket", "h").select("h", "norm", "first_id", "n"))
    # Lone texts come along if the bitmap or a hash can't tell them from others; they are known already.
    checked = files.mapInArrow(_chain, f"h long, sha binary, keep_id {kind}, group_size long").where("group_size > 1")
    return entries, lone.unionByName(checked), bitmap


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1_000, max_depth: int = 16) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), a row for each row of ``docs``.

    Texts are equal when their normalised bytes are. keep_id is the smallest id of
    the equal texts (null only if none has an id), group_size their number of rows.
    kept is true for one row of each group: the one whose id is keep_id, and only
    one of rows that repeat it. Null text is the empty text. Texts of any length are
    compared whole; other columns play no part. No rows: no rows.
    """
    entries, classes, _ = _index(docs, id_col, text_col, capacity, max_depth)
    found = entries.join(classes, ["h", "sha"])
    found = found.select("doc_id", "keep_id", "group_size", F.lower(F.hex("sha")).alias("text_sha256"), F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    return found.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1_000, max_depth: int = 16) -> DataFrame:
    """The rows of ``docs`` that ``exact_duplicates`` keeps, with all their columns.

    Texts that don't recur aren't shuffled. Null text is the empty text. Of rows that
    share id and text, any one stays, even if they differ elsewhere; of texts without
    any id, one row stays. Texts of any length are compared whole; columns of any name
    are kept as they are. No rows: no rows.
    """
    entries, classes, bitmap = _index(docs, id_col, text_col, capacity, max_depth)
    if bitmap is None:
        return docs
    keyed = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs[id_col].alias("id"), normalised(docs[text_col]).alias("norm"))
    keyed = keyed.select("row", "id", F.xxhash64("norm").alias("h"), "norm").withColumn("recurs", bitmap.column(F.col("h")))
    alone = keyed.where(~F.col("recurs")).select("row.*")
    keep = classes.select("h", "sha", "keep_id")
    rest = keyed.where("recurs").select("row", "id", "h", F.unhex(F.sha2("norm", 256)).alias("sha"))
    rest = rest.join(keep, (rest["h"] == keep["h"]) & (rest["sha"] == keep["sha"]) & rest["id"].eqNullSafe(keep["keep_id"]), "left_semi")
    return alone.unionByName(rest.dropDuplicates(["h", "sha"]).select("row.*"))
