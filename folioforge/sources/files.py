"""Files as sources: validation, page ranges, reading in shards, and text or HTML blocks."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import text as T

MAX_BYTES = 200 * 1024 * 1024


def read_files(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """(path, length, content) of binary files; only the columns used are read. Spark's file scans pass over files of no bytes."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)


def reject_reason(length: Column, head: Column, pages: Column | None = None, first: Column | None = None, last: Column | None = None, max_bytes: int = MAX_BYTES, max_pages: int | None = None) -> Column:
    """Why a PDF is refused, or null: empty, too large, no PDF mark, too many pages, or a page range that isn't inside 1..pages."""
    reason = F.when(F.coalesce(length, F.lit(0)) <= 0, "empty").when(length > max_bytes, "too large").when(F.substring(head, 1, 5) != F.encode(F.lit("%PDF-"), "UTF-8"), "not a pdf")
    if pages is not None:
        if first is not None and last is not None:
            ranged = first.isNotNull()
            reason = reason.when(ranged & ~((first >= 1) & (first <= last) & (last <= pages)), "bad range")
            if max_pages:
                reason = reason.when(ranged & (last - first + 1 > max_pages), "range too long")
        else:
            ranged = F.lit(False)
        if max_pages:
            reason = reason.when(~ranged & (pages > max_pages), "too many pages")
    return reason


def page_ranges(docs: DataFrame, pages_col: str = "n_pages", size: int = 50) -> DataFrame:
    """One row per range [first, last] of at most ``size`` pages; documents without pages give none."""
    start = F.explode(F.sequence(F.lit(1), F.col(pages_col), F.lit(size)))
    return docs.where(F.col(pages_col) >= 1).withColumn("first_page", start).withColumn("last_page", F.least(F.col("first_page") + size - 1, F.col(pages_col))).withColumn("shard", F.expr(f"cast((first_page - 1) div {size} as int)"))


def read_shards(ranges: DataFrame, parse: Callable[[dict], list[dict]], block_type: pa.StructType, skip: tuple[type[Exception], ...] = (ValueError,)) -> DataFrame:
    """``ranges`` with ``blocks`` (what ``parse`` gave for the row) and ``error``.

    Errors of the kinds ``skip`` are kept as the row's error; others end the job. ``require_some`` refuses a document of which
    every shard failed.
    """
    from pyspark.sql.pandas.types import from_arrow_type, to_arrow_schema
    from pyspark.sql.types import StructType

    fields = ranges.columns
    out = to_arrow_schema(ranges.schema).append(pa.field("blocks", pa.list_(block_type))).append(pa.field("error", pa.string()))

    def run(batches):
        for b in batches:
            blocks, errors = [], []
            for row in b.to_pylist():
                try:
                    blocks.append(parse(row))
                    errors.append(None)
                except skip as e:
                    blocks.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in fields], pa.array(blocks, pa.list_(block_type)), pa.array(errors, pa.string())], schema=out)

    schema = StructType(list(ranges.schema.fields))
    schema = schema.add("blocks", from_arrow_type(pa.list_(block_type))).add("error", "string")
    return ranges.mapInArrow(run, schema)


def require_some(shards: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, failed_shards, problem): the failed shards of each document as a comma list; a problem if none was read."""
    failed = F.array_join(F.array_sort(F.collect_list(F.when(F.col("error").isNotNull(), F.col("shard")))).cast("array<string>"), ",")
    return shards.groupBy(*keys).agg(failed.alias("failed_shards"), F.when(F.count_if(F.col("error").isNull()) == 0, "every shard failed").alias("problem"))


def line_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ord, block_type, text): the lines of plain texts that aren't blank or rules, as paragraphs."""
    lines = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text_col, "\r\n|\r|\n")).alias("ord", "text"))
    return lines.where((T.strip(F.col("text")) != "") & ~T.is_noise(F.col("text"))).select("doc_id", "ord", F.lit("paragraph").alias("block_type"), T.strip(F.col("text")).alias("text"))


def html_blocks(pages: DataFrame, id_col: str = "doc_id", html_col: str = "html") -> DataFrame:
    """(doc_id, ord, block_type, heading_level, text): headings, paragraphs and list items of HTML, scripts and styles left out."""
    bare = F.regexp_replace(F.col(html_col), r"(?is)<(script|style|head)\b.*?</\1\s*>|<!--.*?-->", " ")
    found = F.regexp_extract_all(bare, F.lit(r"(?is)<(?:h[1-6]|p|li)\b[^>]*>.*?(?=<(?:h[1-6]|p|li)\b|</(?:h[1-6]|p|li|ul|ol|div|body)\b|$)"), F.lit(0))
    cut = pages.select(F.col(id_col).alias("doc_id"), F.posexplode(found).alias("ord", "raw"))
    tag = F.lower(F.regexp_extract("raw", r"(?i)^<([a-z]+[1-6]?)", 1))
    text = T.strip(T.collapse(F.regexp_replace("raw", "<[^>]*>", " ")))
    kind = F.when(tag == "li", "list_item").when(tag == "p", "paragraph").otherwise("heading")
    return cut.select("doc_id", "ord", kind.alias("block_type"), F.when(kind == "heading", F.substring(tag, 2, 1).try_cast("int")).alias("heading_level"), text.alias("text")).where("text <> ''")


def linked_captions(elements: DataFrame) -> DataFrame:
    """Elements (doc_id, ref, captions, footnotes, text) without those that others name as caption or footnote, with the first
    non-blank text of each element's captions as ``caption``."""
    refs = elements.select("doc_id", F.col("ref").alias("owner"), F.posexplode(F.coalesce("captions", F.array().cast("array<string>"))).alias("nth", "target"))
    notes = elements.select("doc_id", F.explode(F.coalesce("footnotes", F.array().cast("array<string>"))).alias("target"))
    linked = refs.select("doc_id", "target").unionByName(notes).distinct()
    texts = elements.select("doc_id", F.col("ref").alias("target"), T.strip(F.coalesce("text", F.lit(""))).alias("t")).where("t <> ''")
    captions = refs.join(texts, ["doc_id", "target"]).groupBy("doc_id", F.col("owner").alias("ref")).agg(F.min_by("t", "nth").alias("caption"))
    return elements.join(linked.withColumnRenamed("target", "ref"), ["doc_id", "ref"], "left_anti").join(captions, ["doc_id", "ref"], "left")


def grid_table(cells: Column) -> Column:
    """struct<headers, body_rows, caption> of a grid array<array<struct<text, column_header>>>.

    Rows with a header cell are headers, folded per column with spaces, blanks skipped; without any there are no headers.
    """
    heads = F.filter(cells, lambda r: F.exists(r, lambda c: F.coalesce(c["column_header"], F.lit(False))))
    body = F.filter(cells, lambda r: ~F.exists(r, lambda c: F.coalesce(c["column_header"], F.lit(False))))
    text = lambda c: T.strip(F.coalesce(c["text"], F.lit("")))
    width = F.coalesce(F.array_max(F.transform(heads, lambda r: F.size(r))), F.lit(0))
    fold = F.transform(F.filter(F.sequence(F.lit(0), width), lambda i: i < width), lambda i: F.array_join(F.filter(F.transform(heads, lambda r: F.coalesce(text(F.get(r, i)), F.lit(""))), lambda t: t != ""), " "))
    return F.struct(F.when(F.size(heads) > 0, fold).otherwise(F.array().cast("array<string>")).alias("headers"), F.transform(body, lambda r: F.transform(r, text)).alias("body_rows"), F.lit(None).cast("string").alias("caption"))
