"""Registered queries of the engine on the test tables, and the same in DuckDB SQL.

The tables hold no Persian, so INJECTED puts Persian, broken and decorative lines before or behind some whole texts,
in both engines.
Blocks are made from lines wrapped at ten words: one line a band of the page, every fifth line as two blocks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark import oracle as O
from docspark.functions import normalize as N
from docspark.functions import textfeat as T
from docspark.functions.chars import filter_once, words
from docspark.operators import bench, cache, chunking, cost, diagnose, layout, pagefold, prompts, retrieval
from docspark.plans import ingest, process
from docspark.sources import files
from docspark.staging import stage

WIDTH, HEIGHT = O.WIDTH, O.HEIGHT


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet").withColumn("text", F.expr(O.INJECTED))


def page_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Statistics of the pages, with their texts."""
    rows = documents(spark, sf).select(F.col("source").alias("document_id"), F.col("doc_id").alias("page_number"), "text")
    return diagnose.text_stats(rows).withColumns({"image_count": F.expr("int(page_number % 3)"), "image_area_ratio": F.expr("(page_number % 10) / 10D"), "drawing_count": F.expr("int(page_number % 25)")})


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return page_rows(spark, sf).drop("text")


def blocks(spark: SparkSession, sf: str) -> DataFrame:
    lines = F.filter(F.transform(F.split("text", "\n"), words), lambda w: F.size(w) > 0)
    wrapped = F.flatten(F.transform(lines, lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.size(w) - 1) / 10).cast("int")), lambda k: F.slice(w, k * 10 + 1, 10))))
    rows = documents(spark, sf).select("doc_id", F.posexplode(wrapped).alias("pos", "w"))
    cut = F.when((F.col("pos") % 5 == 0) & (F.size("w") >= 2), F.ceil(F.size("w") / 2).cast("int")).otherwise(F.size("w"))
    rows = rows.withColumn("first", F.array_join(F.slice("w", F.lit(1), cut), " ")).withColumn("second", F.array_join(F.slice("w", cut + 1, F.lit(10)), " "))
    top, edge = 72.0 + 18 * (F.col("pos") % 40), 72.0 + 6 * F.length("first")
    bottom = top + F.when(F.col("pos") % 7 == 0, 18).otherwise(12)
    score = (25 + (F.col("doc_id") * 31 + F.col("pos") * 17) % 76) / 100.0
    whole = F.struct((F.col("pos") * 2).alias("i"), F.col("first").alias("x"), F.lit(72.0).alias("l"), edge.alias("r"))
    right = F.struct((F.col("pos") * 2 + 1).alias("i"), F.col("second").alias("x"), (edge + 6).alias("l"), (edge + 6 + 6 * F.length("second")).alias("r"))
    both = F.filter(F.array(whole, right), lambda b: b["x"] != "")
    return rows.select(F.concat(F.lit("d"), "doc_id").alias("document_id"), (F.floor(F.col("pos") / 40) + 1).cast("int").alias("page_number"), F.explode(both).alias("b"), top.alias("t"), bottom.alias("bt"), score.alias("score")).select("document_id", "page_number", F.col("b.i").alias("block_idx"), F.col("b.x").alias("text"), "score", F.col("b.l").alias("l"), "t", F.col("b.r").alias("r"), F.col("bt").alias("b"))


def lines(spark: SparkSession, sf: str) -> DataFrame:
    return layout.group_lines(blocks(spark, sf))


def typed(spark: SparkSession, sf: str) -> DataFrame:
    return pagefold.fold(blocks(spark, sf), WIDTH, HEIGHT, "lines")


def regions(spark: SparkSession, sf: str) -> DataFrame:
    return pagefold.fold(blocks(spark, sf), WIDTH, HEIGHT, "regions")


def page_text_stats(spark, sf):
    return pages(spark, sf).drop("image_count", "image_area_ratio", "drawing_count")


def page_diagnosis(spark, sf):
    return diagnose.diagnose_pages(pages(spark, sf)).select("document_id", "page_number", "status", "method", F.round("broken_ratio", 4).alias("broken_ratio"), F.round("persian_ratio", 4).alias("persian_ratio"))


def document_diagnosis(spark, sf):
    return diagnose.diagnose_documents(diagnose.diagnose_pages(pages(spark, sf)))


def pages_with_status(spark, sf):
    found = diagnose.pages_with_status(diagnose.diagnose_pages(pages(spark, sf)), "text_broken", "scanned")
    return found.select("document_id", F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"))


def normalize_text(spark, sf):
    return documents(spark, sf).select("doc_id", N.normalize_text(F.col("text")).alias("normalized"))


def persian_features(spark, sf):
    t = F.col("text")
    return documents(spark, sf).select("doc_id", N.has_persian(t).alias("has_persian"), F.round(N.persian_letter_ratio(t), 4).alias("ratio"), N.is_mostly_persian(t, 0.01).alias("mostly"))


def text_features(spark, sf):
    t = F.col("text")
    return blocks(spark, sf).select("document_id", "block_idx", T.looks_like_formula(t).alias("formula"), T.looks_like_english(t).alias("english"), F.round(T.letter_spam_ratio(t), 4).alias("spam"), T.is_decorative(t).alias("decorative"), T.looks_like_chart_label(t).alias("chart"), T.looks_like_footer(t).alias("footer"))


def noise_block_filter(spark, sf):
    return pagefold.filter_blocks(blocks(spark, sf)).select("document_id", "block_idx")


def group_lines(spark, sf):
    return lines(spark, sf).select("document_id", "page_number", F.col("line_id").cast("long").alias("line_id"), "text", "l", "t", "r", "b", F.round("mean_score", 4).alias("mean_score"))


def column_count(spark, sf):
    return layout.column_counts(lines(spark, sf), WIDTH).select("document_id", "page_number", "n", "n_left", "n_right", "n_crossing", "columns")


def line_types(spark, sf):
    return typed(spark, sf).select("document_id", "page_number", F.col("position").cast("long").alias("position"), "line_type")


def regions_query(spark, sf):
    return regions(spark, sf).select("document_id", "page_number", F.col("region_idx").cast("long").alias("region_idx"), "role", "text", "n_lines", "l", "t", "r", "b", F.round("score", 4).alias("score"), "heading_text")


def repeated_lines(spark, sf):
    return layout.repeated_texts(by_source(spark, sf))


def strip_repeated(spark, sf):
    return layout.strip_repeated(by_source(spark, sf)).groupBy("document_id").agg(F.count("*").alias("n_lines"))


def by_source(spark, sf):
    rows = documents(spark, sf)
    return rows.select(F.concat_ws("-", "source", F.col("doc_id") % 8).alias("document_id"), F.col("doc_id").alias("page_number"), F.explode(F.split("text", "\n")).alias("text"))


def sentence_split(spark, sf):
    return documents(spark, sf).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("n", "sentence"))


def split_paragraph(spark, sf):
    rows = documents(spark, sf).select(F.concat(F.lit("d"), "doc_id").alias("document_id"), F.lit(1).alias("page_number"), F.lit(0).alias("region_idx"), F.lit("body").alias("role"), "text", *(F.lit(0.0).alias(c) for c in "ltrb"), F.lit(1.0).alias("score"), F.lit("text").alias("source_method"))
    return chunking.chunk_regions(rows).select("chunk_id", "chunk_type", "text", "char_count")


def chunk_regions(spark, sf):
    made = chunking.chunk_regions(regions(spark, sf).withColumn("source_method", F.lit("text")))
    return made.select("chunk_id", "chunk_type", "page_start", "page_end", "section", "text", F.round("score", 4).alias("score"))


def chunk_pages(spark, sf):
    return ingest.chunk_pages(regions(spark, sf).withColumn("source_method", F.lit("text"))).select("chunk_id", "chunk_type", "page_start", "page_end", "text")


def parse_pages(spark, sf):
    spec = F.expr(O.SPEC)
    found = T.select_pages(T.parse_pages(spec), F.lit(30))
    return documents(spark, sf).select("doc_id", F.array_join(found.cast("array<string>"), ",").alias("pages"))


def document_id(spark, sf):
    rows = spark.read.parquet(f"{sf}/pages.parquet")
    return rows.select("page_id", files.document_id(F.concat(F.lit("/in/p."), F.col("page_id").cast("string"), F.lit(".pdf")), F.sha2("html", 256)).alias("document_id"))


def token_estimate(spark, sf):
    return documents(spark, sf).groupBy("source").agg(F.sum(T.estimate_tokens(F.col("text"))).alias("tokens"))


def scenario_cost(spark, sf):
    rows = documents(spark, sf).select("doc_id", T.estimate_tokens(F.col("text")).alias("context"))
    return cost.scenario(rows, F.col("context"), F.lit(20), F.lit(350))


def chunks(spark, sf):
    return documents(spark, sf).select(F.col("doc_id").alias("chunk_id"), "text")


def questions(spark, sf):
    return spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def tf(spark, sf):
    return retrieval.term_frequencies(chunks(spark, sf))


def idf(spark, sf):
    rows = chunks(spark, sf)
    return retrieval.idf(retrieval.term_frequencies(rows), rows.agg(F.count("*")).scalar()).withColumn("idf", F.round("idf", 4))


def lexical_topk(spark, sf):
    return retrieval.search(chunks(spark, sf), questions(spark, sf)).select("query_id", "chunk_id", F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank"))


def render_chunk(spark, sf):
    return documents(spark, sf).select("doc_id", rendered())


def rendered():
    first = F.col("doc_id") % 7 + 1
    return prompts.render_chunk(first, first + F.col("doc_id") % 2, F.when(F.col("doc_id") % 3 == 0, "text").otherwise("ocr"), F.when(F.col("doc_id") % 4 == 0, F.col("lang")), F.col("text")).alias("rendered")


def pack_context(spark, sf):
    return prompts.pack_context(documents(spark, sf).select("source", "doc_id", rendered()), "source", ["doc_id"])


def history_filter(spark, sf):
    found = prompts.history(spark.read.parquet(f"{sf}/conversations.parquet"))
    return found.select("conv_id", F.array_join(F.transform("history", lambda x: F.concat(x["role"], F.lit("="), x["content"])), "\n").alias("history"))


def build_messages(spark, sf):
    past = prompts.history(spark.read.parquet(f"{sf}/conversations.parquet"))
    rows = questions(spark, sf).join(past, F.col("query_id") == F.col("conv_id"), "left")
    made = prompts.build_messages(F.col("question"), F.lit("[c]"), F.col("history"), "exam")
    return rows.select("query_id", F.size(made).alias("n"), F.array_join(F.transform(made, lambda m: m["role"]), ",").alias("roles"), F.element_at(made, -1)["content"].alias("asked"))


def route_method(spark, sf):
    rows = diagnose.diagnose_pages(pages(spark, sf))
    return rows.select("document_id", "page_number", ingest.route(F.col("status"), F.col("method"), ingest.Options()).alias("auto"), ingest.route(F.col("status"), F.col("method"), ingest.Options(ocr_hybrid_pages=True)).alias("hybrid"))


def text_fallback(spark, sf):
    rows = diagnose.diagnose_pages(page_rows(spark, sf))
    return filter_once(rows, ingest.needs_fallback(F.col("status"), F.col("text"), ingest.Options(min_text_chars=200))).select("document_id", "page_number")


def _cached(spark, sf):
    rows = documents(spark, sf).select(F.col("source").alias("document_id"), F.col("doc_id").cast("int").alias("page_no"), "text", F.sha2("text", 256).alias("checksum_sha256"), F.lit(200).alias("dpi"), F.when(F.col("doc_id") % 5 == 0, "ocr").otherwise("text").alias("source_method"), F.lit(chunking.ENGINE_VERSION).alias("engine_version"))
    old = rows.filter("page_no % 3 != 0").withColumn("dpi", F.when(F.col("page_no") % 7 == 0, 300).otherwise(F.col("dpi")))
    return rows, old


def cache_hits(spark, sf):
    rows, old = _cached(spark, sf)
    return cache.lookup(rows, old).select("document_id", "page_no", "cache_hit", F.length("cached_text").alias("cached_chars"))


def cache_misses(spark, sf):
    rows, old = _cached(spark, sf)
    return cache.misses(rows, old).select("document_id", "page_no")


def job_rollup(spark, sf):
    rows = diagnose.diagnose_pages(pages(spark, sf)).withColumn("route", ingest.route(F.col("status"), F.col("method"), ingest.Options()))
    done = ingest.job_rollup(rows, "document_id")
    return done.select("document_id", "pages_done", F.size("method_per_page").cast("long").alias("n_methods"), F.size(F.map_filter("method_per_page", lambda k, v: v == "ocr")).cast("long").alias("n_ocr"))


def bench_summary(spark, sf):
    hits = retrieval.search(chunks(spark, sf), questions(spark, sf))
    texts = documents(spark, sf).select(F.col("doc_id").alias("chunk_id"), T.estimate_tokens(F.col("text")).alias("tokens"))
    each = hits.hint("shuffle_hash").join(texts, "chunk_id").groupBy("query_id").agg(F.sum("tokens").alias("rag"), F.bool_or(F.col("chunk_id") % 10 == F.col("query_id") % 10).alias("hit"))
    whole = texts.agg(F.sum("tokens").alias("whole"))
    return each.join(F.broadcast(whole)).agg(F.count("*").alias("n"), F.round(F.avg(F.col("hit").cast("int")), 2).alias("hit_rate"), F.round(F.avg("rag"), 1).alias("mean_rag_tokens"), F.round(F.avg(100 * (1 - F.col("rag") / F.col("whole"))), 1).alias("mean_reduction"))


def object_stats(spark, sf):
    n = F.col("doc_id")
    rows = documents(spark, sf).select(n, F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"), F.col("text").alias("raw_text"), F.split("text", "\n").alias("text_blocks"), F.array((n % 7) * 100000.0, (n % 3) * 50000.0).alias("image_rect_areas"))
    return diagnose.object_stats(rows).select("doc_id", "char_count", "readable_char_count", "text_block_count", F.round("image_area_ratio", 6).alias("image_area_ratio"))


def page_text(spark, sf):
    return process.page_text(regions(spark, sf))


def reading_order(spark, sf):
    return layout.reading_order(lines(spark, sf), WIDTH).select("document_id", "page_number", F.col("line_id").cast("long").alias("line_id"), F.col("position").cast("long").alias("position"))


def question_bench(spark, sf):
    first = (F.col("chunk_id") % 50).cast("int")
    rows = chunks(spark, sf).withColumn("page_start", first).withColumn("page_end", first + (F.col("chunk_id") % 2).cast("int"))
    asked = questions(spark, sf).withColumn("expected_pages", F.array((F.col("query_id") % 50).cast("int"), (F.col("query_id") % 50 + 1).cast("int")))
    made = bench.question_bench(rows, asked, 1_000_000)
    return made.select("query_id", F.array_join(F.col("retrieved_pages").cast("array<string>"), ",").alias("pages"), "page_hit", F.col("pipeline_rag.context_tokens").alias("rag_tokens"), F.col("baseline.input_tokens").alias("baseline_tokens"), F.col("input_token_reduction_pct").alias("reduction"))


def _run_inputs(spark, sf):
    """Diagnosed pages of the blocks, the blocks, and an OCR that reads the same blocks."""
    made = stage(blocks(spark, sf), "blocks")  # read three times
    objects = made.groupBy("document_id", "page_number").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_idx", "text"))), lambda x: x["text"]), "\n").alias("text"))
    stats = diagnose.text_stats(objects).withColumns({"checksum_sha256": F.sha2("text", 256), "image_count": (F.col("page_number") % 3).cast("int"), "image_area_ratio": F.lit(0.5), "drawing_count": F.lit(0)})
    return diagnose.diagnose_pages(stats.drop("text")), made, lambda todo: made.join(todo.hint("shuffle_hash"), ["document_id", "page_number"], "left_semi")


def process_pages(spark, sf):
    """Whole run over blocks of the documents: diagnosis, routes, text, fallback and OCR."""
    rows, made, ocr = _run_inputs(spark, sf)
    done = process.run_pages(rows, made, WIDTH, HEIGHT, None, ocr, ingest.Options(fix_fallback=True))
    return done.pages.select("document_id", "page_number", "status", "source_method", "fallback_used", F.length("text").alias("n_chars"))


def ingest_job(spark, sf):
    """A job for each document: its second and third pages, all pages of shorter documents."""
    rows, made, ocr = _run_inputs(spark, sf)
    jobs = documents(spark, sf).select(F.concat(F.lit("d"), "doc_id").alias("document_id"), F.array(F.lit(2), F.lit(3)).alias("pages"))
    _, _, rollup = process.run_jobs(jobs, rows, made, WIDTH, HEIGHT, None, ocr)

    def listed(name):
        return F.array_join(F.transform(F.map_entries(name), lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"])), ",").alias(name)

    return rollup.select("document_id", "pages_done", listed("method_per_page"), listed("status_per_page"))


def strip_pipeline(spark, sf):
    """Texts of whole documents without their repeated lines."""
    rows, made, ocr = _run_inputs(spark, sf)
    done = process.run_pipeline(rows, made, WIDTH, HEIGHT, ocr, ingest.PipelineConfig().to_options())
    return done.run.pages.select("document_id", "page_number", "source_method", F.sha2("text", 256).alias("text_sha256"), F.length("text").alias("n_chars"))


def persian_text(spark, sf):
    return documents(spark, sf).select("doc_id", N.normalize_persian_text(F.col("text")).alias("normalized"))


_ALL = (object_stats, page_text, reading_order, question_bench, process_pages, ingest_job, strip_pipeline, persian_text, page_text_stats, page_diagnosis, document_diagnosis, pages_with_status, normalize_text, persian_features, text_features, noise_block_filter, group_lines, column_count, line_types, regions_query, repeated_lines, strip_repeated, sentence_split, split_paragraph, chunk_regions, chunk_pages, parse_pages, document_id, token_estimate, scenario_cost, tf, idf, lexical_topk, render_chunk, pack_context, history_filter, build_messages, route_method, text_fallback, cache_hits, cache_misses, job_rollup, bench_summary)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__.removesuffix("_query"): f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return O.sql()


def entry(spark: SparkSession) -> DataFrame:
    return document_diagnosis(spark, "/root/testdata/sf0.001")
