"""Whole runs: diagnosed pages in, page results and chunks out, by way of cache, text layer, fallback and OCR."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docspark import staging
from docspark.operators import cache as caching
from docspark.operators import chunking
from docspark.operators.layout import PAGE, repeated_texts, stripped_regions, with_texts
from docspark.operators.pagefold import LINE_COLUMNS, REGION_COLUMNS, fold
from docspark.plans.ingest import Options, chunk_pages, job_rollup, needs_fallback, route

RESULT = (*PAGE, "status", "source_method", "text", "cache_hit", "fallback_used")


@dataclass(frozen=True)
class Run:
    """``pages``: RESULT columns, a row for each page that was served; ``regions`` and ``lines`` of those laid out."""

    pages: DataFrame
    regions: DataFrame
    lines: DataFrame | None = None


@dataclass(frozen=True)
class PipelineRun:
    """A whole-document run: ``run``, its ``chunks``, and the ``repeated`` texts (document_id, text) that were left out."""

    run: Run
    chunks: DataFrame
    repeated: DataFrame


@dataclass(frozen=True)
class Job:
    """A unit of ingest work, as a queue holds it."""

    document_id: str
    pages: tuple[int, ...] = ()
    mode: str = "auto"
    dpi: int = 200
    merge_across_pages: bool = False
    checksum_sha256: str = ""


def page_text(regions: DataFrame) -> DataFrame:
    """Text of each page: its regions with text in order, a blank line between."""
    ordered = F.filter(F.transform(F.array_sort(F.collect_list(F.struct("region_idx", "text"))), lambda x: x["text"]), lambda t: t != "")
    return regions.groupBy(*PAGE).agg(F.array_join(ordered, "\n\n").alias("text"))


def _looked_up(routed: DataFrame, cache: DataFrame, options: Options) -> DataFrame:
    """The cache is asked for the routed method; with ``fix_fallback`` also for a text page's OCR."""
    found = caching.lookup(routed, cache)
    if not options.fix_fallback or options.mode != "auto":
        return found
    late = caching.lookup(routed.filter("source_method = 'text' AND status IN ('text_ok', 'text_plus_visual')").withColumn("source_method", F.lit("ocr")), cache)
    late = late.filter("cache_hit").select(*PAGE, F.lit(True).alias("_late"), F.col("cached_text").alias("_text"))
    both = found.join(late, list(PAGE), "left")
    fell = F.coalesce("_late", F.lit(False)) & ~F.col("cache_hit")
    return both.withColumns({"source_method": F.when(fell, "ocr").otherwise(F.col("source_method")), "cached_text": F.when(fell, F.col("_text")).otherwise(F.col("cached_text")), "cache_hit": F.col("cache_hit") | fell}).drop("_late", "_text")


def run_pages(pages: DataFrame, blocks: DataFrame, width: float, height: float, cache: DataFrame | None = None, ocr: Callable[[DataFrame], DataFrame] | None = None, options: Options = Options(), stage: Callable[[DataFrame], DataFrame] = staging.stage) -> Run:
    """One pass over ``pages`` (document_id, page_number, checksum_sha256, status, method) and their text ``blocks``.

    Cached pages are served as they are; empty ones give an empty text, under the method ``ocr``, unless all go to OCR;
    text pages that come out too short go to OCR after all (marked in fallback_used with ``fix_fallback`` only).
    ``ocr`` maps pages to blocks; without it, pages routed there give no row. Pages, lines and regions are used many
    times, so they are staged.
    """
    pages = stage(pages.select(*PAGE, "checksum_sha256", "status", "method"))  # read many times below
    routed = pages.withColumn("source_method", route(F.col("status"), F.col("method"), options)).withColumns({"page_no": F.col("page_number"), "dpi": F.lit(options.dpi), "engine_version": F.lit(chunking.ENGINE_VERSION)})
    found = _looked_up(routed, cache, options) if cache is not None else routed.withColumns({"cache_hit": F.lit(False), "cached_text": F.lit(None).cast("string")})
    keys = [*PAGE, "status", "source_method"]
    no = F.lit(False).alias("fallback_used")
    hits = found.filter("cache_hit").select(*keys, F.coalesce("cached_text", F.lit("")).alias("text"), "cache_hit", no)
    todo = found.filter("NOT cache_hit")
    if options.mode != "ocr_only":
        empty = todo.filter("status = 'empty'").select(*PAGE, "status", F.lit("ocr").alias("source_method"), F.lit("").alias("text"), "cache_hit", no)
        hits, todo = hits.unionByName(empty), todo.filter("status != 'empty'")
    laid = _laid_out(todo.select(*keys), blocks, width, height, ocr, options, stage)
    return Run(hits.unionByName(laid.pages), laid.regions, laid.lines)


def _laid_out(todo: DataFrame, blocks: DataFrame, width: float, height: float, ocr: Callable[[DataFrame], DataFrame] | None, options: Options, stage: Callable[[DataFrame], DataFrame]) -> Run:
    """Text pages, those of them that come out too short, and OCR pages of ``todo`` (PAGE, status, source_method)."""
    keys = [*PAGE, "status", "source_method"]
    no = F.lit(False).alias("fallback_used")

    def laid_out(these: DataFrame, method: str) -> DataFrame:
        return stage(fold(these, width, height, "all", noise=True, source=method, keep_headings=options.keep_headings, marks=options.footer_marks))

    def parts(every: DataFrame, method: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Page texts, regions and lines of ``every``."""
        regions = every.filter("kind = 'region'").select(*PAGE, *REGION_COLUMNS).withColumn("source_method", F.lit(method))
        lines = every.filter("kind = 'line'").withColumn("clean", F.col("clean" if method == "ocr" else "text")).select(*PAGE, "clean", *LINE_COLUMNS)
        return every.filter("kind = 'page'").select(*PAGE, "text"), regions, lines

    asked = todo.filter("source_method = 'text'")
    texts, regions, lines = parts(laid_out(blocks.join(asked.select(*PAGE).hint("shuffle_hash"), list(PAGE), "left_semi"), "text"), "text")
    texts = asked.join(texts, list(PAGE), "left").withColumn("text", F.coalesce("text", F.lit("")))
    short = needs_fallback(F.col("status"), F.col("text"), options)
    good = texts.filter(~short).select(*keys, "text", F.lit(False).alias("cache_hit"), no)
    others = stage(texts.withColumn("short", short).filter("short IS NULL OR short").select(*PAGE, "status", "short"))  # few: keys instead of all good pages decide below
    regions, lines = (df.join(others.select(*PAGE), list(PAGE), "left_anti") for df in (regions, lines))
    if ocr is None:
        return Run(good, regions, lines)
    late = others.filter("short").select(*PAGE, "status", F.lit("ocr").alias("source_method"), F.lit(options.fix_fallback).alias("fallback_used"))
    scans = todo.filter("source_method = 'ocr'").select(*keys, no).unionByName(late)
    read, seen, found = parts(laid_out(ocr(scans.select(*PAGE)), "ocr"), "ocr")
    done = scans.join(read, list(PAGE), "left").select(*keys, F.coalesce("text", F.lit("")).alias("text"), F.lit(False).alias("cache_hit"), "fallback_used")
    return Run(good.unionByName(done), regions.unionByName(seen), lines.unionByName(found))


def run_document(pages: DataFrame, blocks: DataFrame, width: float, height: float, ocr: Callable[[DataFrame], DataFrame] | None = None, options: Options = Options(), stage: Callable[[DataFrame], DataFrame] = staging.stage) -> Run:
    """The pass that whole documents are made of: no cache, and empty pages are left out whatever the mode."""
    pages = stage(pages.select(*PAGE, "status", "method"))  # read many times below
    todo = pages.filter("status != 'empty'").withColumn("source_method", route(F.col("status"), F.col("method"), options))
    return _laid_out(todo.select(*PAGE, "status", "source_method"), blocks, width, height, ocr, options, stage)


def run_pipeline(pages: DataFrame, blocks: DataFrame, width: float, height: float, ocr: Callable[[DataFrame], DataFrame] | None = None, options: Options = Options(), stage: Callable[[DataFrame], DataFrame] = staging.stage) -> PipelineRun:
    """Whole documents without the lines that repeat through documents of 4 pages or more, and their chunks.

    With ``strip_repeated`` off, it is run_document and its chunks.
    """
    run = run_document(pages, blocks, width, height, ocr, options, stage)
    if not options.strip_repeated:
        return PipelineRun(run, document_chunks(run, options), repeated_texts(run.lines.select(*PAGE, F.col("clean").alias("text"))).limit(0))
    repeated = stage(repeated_texts(run.lines.select(*PAGE, F.col("clean").alias("text"))))
    # only pages that hold a repeated line are made again
    touched = stage(with_texts(run.lines.filter("region_idx IS NOT NULL"), repeated, "clean").select(*PAGE).distinct())
    left = stripped_regions(run.lines.join(touched, list(PAGE), "left_semi"), repeated).join(run.pages.select(*PAGE, "source_method"), list(PAGE))
    left = stage(left.select(*run.regions.columns))
    new = stage(touched.join(page_text(left), list(PAGE), "left").select(*PAGE, F.coalesce("text", F.lit("")).alias("_new")))
    pages = run.pages.join(new, list(PAGE), "left").withColumn("text", F.coalesce("_new", "text")).select(*run.pages.columns)
    run = Run(pages, run.regions.join(touched, list(PAGE), "left_anti").unionByName(left), run.lines)
    return PipelineRun(run, document_chunks(run, options), repeated)


def selected(pages: DataFrame, jobs: DataFrame) -> DataFrame:
    """The pages that ``jobs`` (document_id, pages) ask for; of a document with no such page, or with none named, all."""
    asked = pages.join(jobs.select("document_id", F.col("pages").alias("_pages")), "document_id").withColumn("_in", F.coalesce(F.array_contains("_pages", F.col("page_number")), F.lit(False)))
    some = F.max("_in").over(Window.partitionBy("document_id"))
    return asked.withColumn("_some", some).filter("_in OR NOT _some").drop("_pages", "_in", "_some")


def run_jobs(jobs: DataFrame, pages: DataFrame, blocks: DataFrame, width: float, height: float, cache: DataFrame | None = None, ocr: Callable[[DataFrame], DataFrame] | None = None, options: Options = Options()) -> tuple[Run, DataFrame, DataFrame]:
    """(run, chunks, rollup) of many jobs, one a document, under the same options.

    Chunks are made page by page and numbered through the job. The rollup has a row a job: pages_done, the methods and
    statuses by page, chunk_count.
    """
    run = run_pages(selected(pages, jobs), blocks, width, height, cache, ocr, options)
    chunks = job_chunks(run, options)
    counts = chunks.groupBy("document_id").agg(F.count("*").alias("chunk_count"))
    rollup = job_rollup(run.pages, "document_id", "source_method").join(counts, "document_id", "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))
    return run, chunks, rollup


def run_job(job: Job, pages: DataFrame, blocks: DataFrame, width: float, height: float, cache: DataFrame | None = None, ocr: Callable[[DataFrame], DataFrame] | None = None, options: Options | None = None) -> tuple[Run, DataFrame, DataFrame]:
    """One job; its options and checksum hold unless others are given."""
    options = options or Options(mode=job.mode, dpi=job.dpi, merge_across_pages=job.merge_across_pages)
    jobs = pages.sparkSession.createDataFrame([(job.document_id, list(job.pages))], "document_id string, pages array<int>")
    if job.checksum_sha256:
        pages = pages.withColumn("checksum_sha256", F.lit(job.checksum_sha256))
    return run_jobs(jobs, pages, blocks, width, height, cache, ocr, options)


def cache_rows(run: Run, pages: DataFrame, options: Options = Options()) -> DataFrame:
    """What a run adds to the page cache: pages that were laid out or read, not those served from it or empty."""
    new = run.pages.filter("NOT cache_hit AND status != 'empty'").join(pages.select(*PAGE, "checksum_sha256"), list(PAGE))
    return new.select("document_id", F.col("page_number").alias("page_no"), "text", "checksum_sha256", F.lit(options.dpi).alias("dpi"), "source_method")


def job_chunks(run: Run, options: Options = Options()) -> DataFrame:
    """Chunks page by page, numbered through the document."""
    return chunk_pages(run.regions, options)


def document_chunks(run: Run, options: Options = Options()) -> DataFrame:
    """Chunks of whole documents; they may span pages and keep sections if the options say so."""
    return chunking.chunk_regions(run.regions, options.merge_across_pages, options.reset_sections_per_page)


def documents(run: Run, chunks: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """document_id, pages, chunks, method_per_page: one nested row per document, ready for the JSON sink.

    A row holds its document, as the sink's format has it; ``run.pages`` and ``chunks`` are the same without nesting.
    """
    rows, fields = run.pages, ["page_number", "status", "source_method", "cache_hit", "fallback_used", "char_count", "text"]
    if blocks is not None:
        each = blocks.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("block_idx", "text", "score", "l", "t", "r", "b"))).alias("blocks"))
        rows, fields = rows.join(each, list(PAGE), "left"), [*fields, "blocks"]
    pages = rows.withColumn("char_count", F.length("text")).groupBy("document_id").agg(
        F.array_sort(F.collect_list(F.struct(*fields))).alias("pages"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("page_number").cast("string"), "source_method")))).alias("method_per_page"),
    )
    fields = [c for c in chunks.columns if c not in ("document_id", "chunk_index")]
    made = chunks.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", *fields)), lambda a, b: a["chunk_index"] - b["chunk_index"]).alias("chunks"))
    return pages.join(made, "document_id", "left")
