"""Documents from files and payloads, snapshots of pages, and guarded sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A page of a snapshot; files of another version are refused.
SNAPSHOT_VERSION = 2
GLYPH = "ch string, box struct<x:double,y:double,x2:double,y2:double>, visual_box struct<x:double,y:double,x2:double,y2:double>, font_id string, font_size double, render_order long, sub_render_order long"
PARAGRAPH = "debug_id string, layout_label string, layout_id int, vertical boolean, text string, box struct<x:double,y:double,x2:double,y2:double>, font_size double"


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content) of the regular files with a PDF mark in their first 1,024 bytes."""
    files = spark.read.format("binaryFile").load(path)
    return files.where(F.instr(F.substring("content", 1, 1024).cast("string"), "%PDF") > 0).select("path", "length", "content")


def inline_pdf(payload: Column) -> Column:
    """The bytes of a base64 payload, which must start with the PDF mark; an error otherwise."""
    content = F.unbase64(payload)
    return F.when(F.substring(content, 1, 4) == F.lit(b"%PDF"), content).otherwise(F.raise_error(F.lit("not a PDF")).cast("binary"))


def json_records(rows: DataFrame, column: str, schema: str) -> DataFrame:
    """The column's JSON by an explicit schema; a record that doesn't fit stops the query instead of becoming null."""
    return rows.withColumn(column, F.from_json(column, schema, {"mode": "FAILFAST"}))


def typed_record(text: Column, schemas: dict[str, str]) -> Column:
    """A struct with a field for each type of ``schemas``: a tagged record ``{"type": ..., "fields": {...}}`` fills its own; an error for any other type."""
    kind = F.get_json_object(text, "$.type")
    known = F.when(kind.isin(*schemas), F.get_json_object(text, "$.fields")).otherwise(F.raise_error(F.concat(F.lit("unknown type: "), F.coalesce(kind, F.lit("none")))).cast("string"))
    return F.struct(*(F.when(kind == name, F.from_json(known, schema, {"mode": "FAILFAST"})).alias(name) for name, schema in schemas.items()), F.when(known.isNotNull(), kind).alias("type"))


def save_snapshot(pages: DataFrame, path: str, folders: int = 64) -> None:
    """Pages as Parquet, a row a page, with the version; it appears whole or not at all, and overwrites nothing.

    Documents are dealt out to a fixed number of folders, however many there are, and sorted within.
    """
    marked = pages.withColumn("version", F.lit(SNAPSHOT_VERSION)).withColumn("folders", F.lit(folders)).withColumn("folder", F.pmod(F.xxhash64("doc_id"), F.lit(folders)).cast("int"))
    marked.repartition(folders, "folder").sortWithinPartitions("folder", "doc_id", "page_index").write.partitionBy("folder").mode("errorifexists").parquet(path)


def load_snapshot(spark: SparkSession, path: str, doc_id: int | None = None, longest: int | None = None) -> DataFrame:
    """The pages of one document or all; an error for another version, or a document of more than ``longest`` pages. One document's folder alone is read for it."""
    pages = spark.read.parquet(path)
    if doc_id is not None:
        sample = pages.select("folders").first()
        own = F.pmod(F.xxhash64(F.lit(doc_id).cast(pages.schema["doc_id"].dataType)), F.lit(sample["folders"] if sample else 1)).cast("int")
        pages = pages.where((F.col("folder") == own) & (F.col("doc_id") == doc_id))
    good = F.assert_true(F.col("version") == SNAPSHOT_VERSION, F.lit("another snapshot version"))
    pages = pages.withColumn("_ok", good).where("_ok is null").drop("_ok", "version", "folder", "folders")
    if longest is None:
        return pages
    sizes = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).withColumn("_ok", F.assert_true(F.col("_n") <= longest, F.lit("too many pages")))
    return pages.join(sizes.where("_ok is null").select("doc_id"), "doc_id", "left_semi")


def persist(spark: SparkSession, source: str, destination: str, resources: DataFrame) -> None:
    """Copies a snapshot, once its resources (sha256, content) have their digests; an error before anything is written otherwise."""
    sound = resources.withColumn("_ok", F.assert_true(F.sha2("content", 256) == F.col("sha256"), F.lit("corrupt resource"))).where("_ok is null").drop("_ok").dropDuplicates(["sha256"])
    export(sound, f"{destination}/resources", [source])
    save_snapshot(load_snapshot(spark, f"{source}"), f"{destination}/pages")


def export(rows: DataFrame, path: str, inputs: list[str]) -> None:
    """Write where nothing is yet, and never over an input."""
    if any(path.rstrip("/") == i.rstrip("/") or i.startswith(path.rstrip("/") + "/") for i in inputs):
        raise ValueError("the output would replace an input")
    rows.write.mode("errorifexists").parquet(path)


def written(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of an export's files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


READERS = {"parquet": {}, "csv": {"header": "true"}, "json": {}, "orc": {}, "text": {}}


def read(spark: SparkSession, path: str, kind: str = "parquet", schema: T.StructType | str | None = None, **options: str) -> DataFrame:
    """Any of the built-in file formats; text formats take their schema from the caller, never by a scan."""
    if kind not in READERS:
        raise ValueError(f"unknown format {kind}")
    if schema is None and kind in ("csv", "json"):
        raise ValueError(f"{kind} needs a schema")
    reader = spark.read.format(kind).options(**(READERS[kind] | options))
    return (reader.schema(schema) if schema is not None else reader).load(path)
