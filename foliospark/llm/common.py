"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that ends a word in every contract of this package: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, so that neither its lineage nor its rows depend on one executor.

    The folder is ``spark.checkpoint.dir``; only where a session has none (tests on
    one machine) a temporary folder takes its place.
    """
    context = df.sparkSession.sparkContext
    if not df.sparkSession.conf.get("spark.checkpoint.dir", None) and context.getCheckpointDir() is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="foliospark-checkpoint-"))
    return df.checkpoint(eager=True)


def shuffle_width(df: DataFrame, rows: int, per_task: int) -> int:
    """Partitions for about ``per_task`` rows each, no fewer than the session's own number."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_task))


def gathered(df: DataFrame, rows: int, per_task: int = 1 << 16) -> DataFrame:
    """``df``, of about that many narrow rows, in as many partitions as they need and no more.

    A small table over many partitions costs each step that follows as many tasks and
    files; in a single one, joins and groups need no shuffle. What ``df`` reads must be
    as small: give it what comes from a checkpoint or a shuffle, not from a scan.
    """
    return df.coalesce(max(1, -(-rows // per_task)))


def text_or_empty(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def narrow(docs: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names: other columns can't clash with them."""
    return docs.select(*(docs[source].alias(name) for name, source in columns.items()))


def held_out(doc_id: Column, modulus: int, remainder: int = 1) -> Column:
    """Whether crc32(doc_id as text) mod ``modulus`` is ``remainder``; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def arrow_rows(function: Callable[[pa.RecordBatch], pa.RecordBatch], text: int | None = None, size: int = 1 << 20) -> Callable[[Iterable], Iterator]:
    """For mapInArrow: ``function`` on each batch that has rows.

    With ``text``, the number of a string column: on parts of a batch with about
    ``size`` bytes of that column, so that a worker's memory doesn't grow with the batch.
    """

    def run(batches):
        for batch in batches:
            for part in [batch] if text is None else parts(batch, text, size):
                if part.num_rows:
                    yield function(part)

    return run


def parts(batch: pa.RecordBatch, text: int, size: int) -> Iterator[pa.RecordBatch]:
    lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(lengths, dtype=np.int64) // size
    cuts = [0, *(np.nonzero(np.diff(group))[0] + 1).tolist(), batch.num_rows]
    for start, stop in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(start, stop - start)


def utf8(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()
