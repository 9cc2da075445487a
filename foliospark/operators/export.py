"""Exported blocks, page replacement, and the parts and manifests of resumable runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .pages import by_group

PAGE = ["doc_id", "page_index"]


def selected_pages(spec: Column, count: Column) -> Column:
    """'18-22,300-305' as sorted distinct places from 0; an empty one means all; an error for anything else."""
    parts = F.transform(F.split(spec, ","), lambda p: F.trim(p))
    good = F.forall(parts, lambda p: p.rlike("^[0-9]+(?: *- *[0-9]+)?$"))

    def run(p: Column) -> Column:
        ends = F.transform(F.split(p, "-"), lambda x: F.trim(x).cast("int"))
        first, last = ends[0], F.element_at(ends, -1)
        bad = F.raise_error(F.concat(F.lit("pages out of range: "), p)).cast("array<int>")
        return F.when((first >= 1) & (first <= last) & (last <= count), F.sequence(first - 1, last - 1)).otherwise(bad)

    some = F.array_sort(F.array_distinct(F.flatten(F.transform(parts, run))))
    every = F.sequence(F.lit(0), count - 1)
    return F.when(F.trim(F.coalesce(spec, F.lit(""))) == "", every).when(good, some).otherwise(F.raise_error(F.concat(F.lit("not a page list: "), spec)).cast("array<int>"))


def replaced_pages(source: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    """Each source page, with the new one's columns where there is a new one."""
    fresh = new.select(*PAGE, *(F.col(c).alias(f"_{c}") for c in columns), F.lit(True).alias("_there"))
    found = source.join(fresh, PAGE, "left")
    picked = [F.when(F.col("_there"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in columns]
    return found.select(*PAGE, *picked, F.coalesce("_there", F.lit(False)).alias("replaced"))


def assembled_pages(source: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    """``replaced_pages``; an error for two new pages of one place, or one of a place that the document hasn't."""
    counts = new.groupBy(*PAGE).agg(F.count(F.lit(1)).alias("_n"))
    places = source.select(*PAGE, F.lit(True).alias("_place"))
    check = F.assert_true((F.col("_n") == 1) & F.coalesce("_place", F.lit(False)), F.lit("invalid recovery page"))
    sound = counts.join(places, PAGE, "left").withColumn("_ok", check).where("_ok is null").select(*PAGE)
    return replaced_pages(source, new.join(sound, PAGE, "left_semi"), columns)


def missing_links(source: DataFrame, output: DataFrame) -> DataFrame:
    """Source links without an equal one in the output: same page, kind and rect."""
    return source.join(output, [*PAGE, "kind", "rect"], "left_anti")


def scoped_fonts(pages: DataFrame, forms: DataFrame) -> DataFrame:
    """Fonts by page and form scope: a form's own font of a name comes before its page's."""
    scopes = forms.select(*PAGE, "xobj_id").distinct().join(pages.select(*PAGE, "font_id", F.col("name").alias("page_name")), PAGE)
    own = forms.select(*PAGE, "xobj_id", "font_id", F.col("name").alias("form_name"))
    return scopes.join(own, [*PAGE, "xobj_id", "font_id"], "full").select(*PAGE, "xobj_id", "font_id", F.coalesce("form_name", "page_name").alias("name"))


def export_blocks(paragraphs: DataFrame, sources: DataFrame, entries: DataFrame) -> DataFrame:
    """Blocks (source, translation, kind) of each page in order, entries once in the place of the paragraphs they cover.

    paragraphs: debug_id, pos, text. sources: debug_id, source. entries: entry_id,
    parents (of debug_id), source, text, kind. Without a source, a paragraph's own
    text stands for it.
    """
    covers = entries.select(*PAGE, "entry_id", F.explode("parents").alias("debug_id"))
    plain = paragraphs.join(covers, [*PAGE, "debug_id"], "left_anti").join(sources, [*PAGE, "debug_id"], "left")
    plain = plain.select(*PAGE, F.col("pos").cast("long").alias("pos"), F.coalesce("source", "text").alias("source"), F.col("text").alias("translation"), F.lit("body").alias("kind"))
    places = covers.join(paragraphs.select(*PAGE, "debug_id", "pos"), [*PAGE, "debug_id"], "left").groupBy(*PAGE, "entry_id").agg(F.min("pos").cast("long").alias("pos"))
    placed = entries.join(places, [*PAGE, "entry_id"], "left")
    placed = placed.select(*PAGE, F.coalesce("pos", F.lit(1 << 40)).alias("pos"), "source", F.col("text").alias("translation"), "kind")
    return plain.unionByName(placed)


def export_pages(blocks: DataFrame) -> DataFrame:
    """(doc_id, page_index, blocks): a page's blocks in order, as one array."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "source", "translation", "kind")))
    return blocks.groupBy(*PAGE).agg(F.transform(ordered, lambda b: F.struct(b["source"].alias("source"), b["translation"].alias("translation"), b["kind"].alias("kind"))).alias("blocks"))


def exported_pages(snapshot: DataFrame) -> DataFrame:
    """``export_pages`` of a snapshot's pages: arrays paragraphs (debug_id, pos, text), sources (debug_id, source) and entries (entry_id, parents, source, text, kind)."""
    paragraphs, sources, entries = (snapshot.select(*PAGE, F.inline(c)) for c in ("paragraphs", "sources", "entries"))
    return export_pages(export_blocks(paragraphs, sources, entries))


def il_regions(documents: DataFrame) -> DataFrame:
    """Body and inline-formula regions of documents in either naming: doc_id, page_index, kind, box, text.

    documents: doc_id, json. The schema names both spellings; the one that is there
    counts.
    """
    shape = "box struct<x:double,y:double,x2:double,y2:double>"
    formula = f"struct<{shape.replace(' ', ':', 1)},latex:string>"
    item = f"struct<pdfFormula:{formula},pdf_formula:{formula}>"
    paragraph = f"struct<{shape.replace(' ', ':', 1)},unicode:string,pdfParagraphComposition:array<{item}>,pdf_paragraph_composition:array<{item}>>"
    schema = f"page array<struct<pageNumber:int,page_number:int,pdfParagraph:array<{paragraph}>,pdf_paragraph:array<{paragraph}>>>"
    pages = documents.select("doc_id", F.explode(F.from_json("json", schema, {"mode": "FAILFAST"})["page"]).alias("p"))
    paras = pages.select("doc_id", F.coalesce("p.pageNumber", "p.page_number").alias("page_index"), F.explode(F.coalesce("p.pdfParagraph", "p.pdf_paragraph")).alias("q"))
    body = paras.select("doc_id", "page_index", F.lit("body").alias("kind"), F.col("q.box").alias("box"), F.col("q.unicode").alias("text"))
    parts = paras.select("doc_id", "page_index", F.explode(F.coalesce("q.pdfParagraphComposition", "q.pdf_paragraph_composition")).alias("c"))
    inline = parts.select("doc_id", "page_index", F.coalesce("c.pdfFormula", "c.pdf_formula").alias("f")).where("f is not null")
    return body.unionByName(inline.select("doc_id", "page_index", F.lit("inline").alias("kind"), F.col("f.box").alias("box"), F.col("f.latex").alias("text")))


def one_of_each(resources: DataFrame) -> DataFrame:
    """Resources by content: a row for each digest, with how many there were."""
    return resources.groupBy(F.sha2("content", 256).alias("sha256")).agg(F.first("content").alias("content"), F.count(F.lit(1)).alias("copies"))


def verified_parts(parts: DataFrame, contents: DataFrame, counts: DataFrame) -> DataFrame:
    """Parts (doc_id, first, last, sha256) within their document (counts: doc_id, page_count) whose content has their digest; an error for any other.

    contents: doc_id, first, content.
    """
    found = parts.join(contents.select("doc_id", "first", F.sha2("content", 256).alias("_sha")), ["doc_id", "first"], "left").join(counts.select("doc_id", "page_count"), "doc_id", "left")
    good = (F.col("first") >= 0) & (F.col("first") <= F.col("last")) & (F.col("last") < F.col("page_count")) & F.col("_sha").eqNullSafe(F.col("sha256"))
    return found.withColumn("_ok", F.assert_true(F.coalesce(good, F.lit(False)), F.lit("invalid part"))).where("_ok is null").select(*parts.columns)


def overlapping_parts(parts: DataFrame) -> DataFrame:
    """Parts (doc_id, first, last) that start before an earlier one of their document ends."""
    earlier = Window.partitionBy("doc_id").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("_end", F.max("last").over(earlier)).where("first <= _end").drop("_end")


def uncovered_pages(selected: DataFrame, parts: DataFrame) -> DataFrame:
    """Selected pages in no part."""
    inside = parts.select("doc_id", F.explode(F.sequence("first", "last")).alias("page_index"))
    return selected.join(inside, PAGE, "left_anti")


def manifest(selected: DataFrame, parts: DataFrame, longest: int = 16) -> DataFrame:
    """(doc_id, n_parts, n_pages, parts) of the documents whose parts are sound and cover all selected pages; no others."""
    long = parts.where(F.col("last") - F.col("first") + 1 > longest).select("doc_id")
    bad = long.unionByName(overlapping_parts(parts).select("doc_id")).unionByName(uncovered_pages(selected, parts).select("doc_id")).distinct()
    good = parts.join(bad, "doc_id", "left_anti")
    return good.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_parts"), F.sum(F.col("last") - F.col("first") + 1).alias("n_pages"), F.array_sort(F.collect_list(F.struct("first", "last", "sha256"))).alias("parts"))


def chunks(pages: DataFrame, limit: int = 16, focus: int | None = None) -> DataFrame:
    """Parts of ``limit`` pages from a document's first on, where it has any; ``turn`` is the order of work, the part with the focus page first."""
    ends = pages.groupBy("doc_id").agg(F.min("page_index").alias("_low"), F.max("page_index").alias("_high"))
    parts = pages.join(ends, "doc_id").select("doc_id", "_high", (F.col("_low") + F.floor((F.col("page_index") - F.col("_low")) / limit) * limit).alias("first")).distinct()
    parts = parts.select("doc_id", "first", F.least("_high", F.col("first") + limit - 1).alias("last"))
    ahead = F.lit(False) if focus is None else F.lit(focus).between(F.col("first"), F.col("last"))
    return parts.withColumn("turn", F.row_number().over(Window.partitionBy("doc_id").orderBy(~ahead, "first")))


def admitted_parts(first: int, last: int, admitted: int, focus: int | None = None) -> list[tuple[int, int]]:
    """A part cut down to runs of at most ``admitted`` pages, in the order of work: the run round the focus page, what is before it, what is behind."""
    if last - first + 1 <= admitted:
        return [(first, last)]
    start = max(first, min(focus, last - admitted + 1)) if focus is not None and first <= focus <= last else first
    rest = [x for low, high in ((first, start - 1), (start + admitted, last)) if low <= high for x in admitted_parts(low, high, admitted, focus)]
    return [(start, start + admitted - 1), *rest]


def worked(pages: DataFrame, work: Callable[[list], list], kind: str, fatal: tuple[type[BaseException], ...] = (ImportError, FileNotFoundError, PermissionError)) -> DataFrame:
    """(doc_id, page_index, result, error): ``work`` on the rows of each part (doc_id, part), a value a row.

    A part that fails is halved again and again, down to the page that fails by itself:
    its result is null, and ``error`` says why. Errors that no page is to blame for, and
    memory errors of a single page, stop the task.
    """

    def halves(rows: list):
        try:
            return [(r.doc_id, r.page_index, value, None) for r, value in zip(rows, work(rows), strict=True)]
        except fatal:
            raise
        except Exception as error:  # noqa: BLE001
            if len(rows) == 1:
                if isinstance(error, MemoryError):
                    raise
                return [(rows[0].doc_id, rows[0].page_index, None, f"{type(error).__name__}: {error}")]
        middle = len(rows) // 2
        return halves(rows[:middle]) + halves(rows[middle:])

    return by_group(pages, ["doc_id", "part"], ["page_index"], halves, f"doc_id long, page_index int, result {kind}, error string")


def compared(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two versions page by page; an error where a document's page counts differ."""
    a, b = left.select(*PAGE, F.col("text").alias("left_text")), right.select(*PAGE, F.col("text").alias("right_text"))
    both = a.withColumn("_a", F.lit(1)).join(b.withColumn("_b", F.lit(1)), PAGE, "full")
    check = F.assert_true(F.col("_a").isNotNull() & F.col("_b").isNotNull(), F.lit("page counts differ"))
    return both.withColumn("_ok", check).where("_ok is null").select(*PAGE, "left_text", "right_text")


def evicted(cache: DataFrame, limit: int) -> DataFrame:
    """Cached files (path, bytes, used_at) past ``limit`` bytes, the most recent kept first; the newest always stays.

    Per cache folder (``root``), as a file system's own limit is.
    """
    order = Window.partitionBy("root").orderBy(F.desc("used_at"), "path")
    total = F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return cache.withColumn("_sum", total).withColumn("_n", F.row_number().over(order)).where(F.col("_n") > 1).where(F.col("_sum") > limit).drop("_sum", "_n")


def cache_key(*parts: Column) -> Column:
    """The digest that names a cached file: of its source, page, scale and the version of what made it."""
    return F.sha2(F.concat_ws(":", *(p.cast("string") for p in parts)), 256)


def isolated(pages: DataFrame, work, schema: str) -> DataFrame:
    """``work`` on each row dict, in ``result``; a row that fails has null and its ``error`` instead, and stops no other.

    Memory errors still stop the task.
    """
    import pandas as pd

    def run(batches):
        for batch in batches:
            results, errors = [], []
            for row in batch.to_dict("records"):
                try:
                    results.append(work(row))
                    errors.append(None)
                except MemoryError:
                    raise
                except Exception as e:  # noqa: BLE001
                    results.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield batch.assign(result=pd.Series(results, index=batch.index, dtype=object), error=pd.Series(errors, index=batch.index, dtype=object))

    fields = ", ".join(f"{n} {t}" for n, t in pages.dtypes)
    return pages.mapInPandas(run, f"{fields}, result {schema}, error string")
