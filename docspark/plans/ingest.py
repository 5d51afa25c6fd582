"""Ingest plans: routing, text fallback, page results, job rollup."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docspark.functions.textfeat import FOOTER_MARKS
from docspark.operators import chunking
from docspark.operators.pagefold import fold

MODES = ("auto", "text_only", "ocr_only")


@dataclass(frozen=True)
class Options:
    mode: str = "auto"
    dpi: int = 200
    merge_across_pages: bool = False
    reset_sections_per_page: bool = True
    strip_repeated: bool = True
    min_text_chars: int = 40
    ocr_hybrid_pages: bool = False
    #: For the preprocessing of page images, by the caller's OCR.
    grayscale: bool = False
    contrast: float = 1.0
    sharpen: bool = False
    #: Mark pages that fell back to OCR, and find them in the cache again; off, as in the reference.
    fix_fallback: bool = False
    keep_headings: bool = False
    footer_marks: tuple[str, ...] = FOOTER_MARKS

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")


@dataclass(frozen=True)
class PipelineConfig:
    """Options of the older whole-document entry point."""

    dpi: int = 200
    grayscale: bool = False
    contrast: float = 1.0
    sharpen: bool = False
    strip_repeated: bool = True

    def to_options(self) -> Options:
        return Options(dpi=self.dpi, strip_repeated=self.strip_repeated, grayscale=self.grayscale, contrast=self.contrast, sharpen=self.sharpen)


def route(status: Column, method: Column, options: Options) -> Column:
    if options.mode == "text_only":
        return F.lit("text")
    if options.mode == "ocr_only":
        return F.lit("ocr")
    ocr = (method == "ocr") | status.isin("text_broken", "scanned") | (method == "hybrid") & F.lit(options.ocr_hybrid_pages)
    return F.when(status == "empty", "text").when(ocr, "ocr").otherwise("text")


def needs_fallback(status: Column, text: Column, options: Options) -> Column:
    """Text pages that came out too short and go to OCR after all."""
    return F.lit(options.mode == "auto") & (F.length(F.coalesce(text, F.lit(""))) < options.min_text_chars) & status.isin("text_ok", "text_plus_visual")


def page_layout(blocks: DataFrame, width: float, height: float, source_method: str, options: Options = Options()) -> DataFrame:
    """Regions of pages from blocks. Text blocks are normalized before layout; of OCR blocks the text as it was read
    decides, and the normalized one makes the regions."""
    regions = fold(blocks, width, height, "regions", noise=True, source=source_method, keep_headings=options.keep_headings, marks=options.footer_marks)
    return regions.withColumn("source_method", F.lit(source_method))


def ingest(routed: DataFrame, text_blocks: DataFrame, width: float, height: float, ocr: Callable[[DataFrame], DataFrame] | None = None, options: Options = Options()) -> DataFrame:
    """Regions of all routed pages (document_id, page_number, route); ``ocr`` maps pages to blocks, and only its pages reach it."""
    page = ["document_id", "page_number"]
    text = page_layout(text_blocks.join(routed.filter("route = 'text'").select(*page), page, "left_semi"), width, height, "text", options)
    if ocr is None:
        return text
    return text.unionByName(page_layout(ocr(routed.filter("route = 'ocr'")), width, height, "ocr", options))


def chunk_pages(regions: DataFrame, options: Options = Options()) -> DataFrame:
    """Chunks page by page, numbered through the document: a job never merges pages."""
    keyed = regions.withColumn("document_id", F.concat_ws("\x1f", "document_id", F.format_string("%09d", "page_number")))
    made = chunking.chunk_regions(keyed, False, options.reset_sections_per_page)
    parts = F.split("document_id", "\x1f")
    rows = made.withColumn("_key", F.col("document_id")).withColumn("document_id", parts[0])
    rows = rows.withColumn("chunk_index", F.row_number().over(Window.partitionBy("document_id").orderBy("_key", "chunk_index")) - 1)
    return rows.withColumn("chunk_id", F.format_string("%s-c%04d", "document_id", "chunk_index")).drop("_key")


def job_rollup(results: DataFrame, job: str = "job_id", method: str = "route") -> DataFrame:
    """pages_done and the maps of method and status by page: one row a job, whose pages its row holds."""

    def by_page(name: str) -> Column:
        return F.map_from_entries(F.array_sort(F.collect_list(F.struct("page_number", name))))

    return results.groupBy(job).agg(F.count("*").alias("pages_done"), by_page(method).alias("method_per_page"), by_page("status").alias("status_per_page"))
