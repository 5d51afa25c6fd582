"""Command line: diagnose, process and bench over page objects (Parquet or JSON lines) or, with the PDF library, PDFs."""

from __future__ import annotations

import argparse
import json
import sys
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark import staging
from docspark.functions.textfeat import estimate_tokens, parse_pages
from docspark.operators import bench, cache, diagnose
from docspark.plans import process
from docspark.plans.ingest import Options
from docspark.sources import files


def load(spark: SparkSession, path: str, spec: str | None) -> tuple[DataFrame, DataFrame]:
    """(diagnosed pages, text blocks) of the selected pages."""
    wanted = spark.range(1).select(parse_pages(F.lit(spec))).first()[0] if spec else None
    objects = files.page_objects(spark, path, wanted)
    return diagnose.diagnose_pages(diagnose.object_stats(objects)), staging.stage(files.text_blocks(objects), "blocks")


def run(spark: SparkSession, args: argparse.Namespace, options: Options) -> tuple[process.Run, DataFrame, DataFrame]:
    """(run, chunks, blocks). Pages go into the cache and are served from it; documents are laid out whole."""
    pages, blocks = load(spark, args.path, args.pages)
    if getattr(args, "cache", None):
        store = cache.PageCache(spark, args.cache)
        served = process.run_pages(pages, blocks, args.width, args.height, store.read() if store.exists() else None, None, options)
        store.upsert(process.cache_rows(served, pages, options))
    if getattr(args, "strip_repeated", False):
        made = process.run_pipeline(pages, blocks, args.width, args.height, None, options)
        done, chunks = made.run, made.chunks
    else:
        done = process.run_document(pages, blocks, args.width, args.height, None, options)
        chunks = process.document_chunks(done, options)
    return done, staging.stage(chunks), blocks


def cmd_diagnose(spark: SparkSession, args: argparse.Namespace) -> None:
    pages, _ = load(spark, args.path, args.pages)
    files.to_json(diagnose.diagnose_documents(pages)).write.mode("overwrite").text(f"{args.outdir}/diagnosis.json")
    files.to_json(pages.drop("blocks", "raw_text", "text_blocks")).write.mode("overwrite").text(f"{args.outdir}/pages.jsonl")
    diagnose.diagnose_documents(pages).show(50, truncate=False)


def cmd_process(spark: SparkSession, args: argparse.Namespace) -> None:
    began = time.perf_counter()
    done, chunks, blocks = run(spark, args, Options(mode=args.mode, dpi=args.dpi, merge_across_pages=args.merge_across_pages, strip_repeated=not args.no_strip_repeated))
    files.to_json(process.documents(done, chunks, blocks if args.include_blocks else None)).write.mode("overwrite").text(f"{args.outdir}/document.json")
    files.write_chunks(chunks, f"{args.outdir}/chunks.jsonl")
    files.write_texts(done.pages, f"{args.outdir}/document.txt")
    counts = {"pages_processed": done.pages.count(), "chunks": chunks.count(), "elapsed_seconds": round(time.perf_counter() - began, 2)}
    (Path(args.outdir) / "bench.json").write_text(json.dumps(counts, indent=2))
    print(json.dumps(counts))


def cmd_bench(spark: SparkSession, args: argparse.Namespace) -> None:
    done, chunks, _ = run(spark, args, Options(dpi=args.dpi))
    whole = done.pages.agg(F.coalesce(F.sum(estimate_tokens(F.col("text"))), F.lit(0))).first()[0]
    rows = bench.question_bench(chunks, bench.fixed_questions(spark, args.questions), whole, args.top_k, args.baseline_answer_tokens, args.rag_answer_tokens)
    files.to_json(rows).write.mode("overwrite").text(f"{args.outdir}/questions.jsonl")
    report = bench.summary(rows).first().asDict()  # one row
    (Path(args.outdir) / "token_benchmark.json").write_text(json.dumps(report, indent=2))
    print(json.dumps(report))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="docspark")
    commands = top.add_subparsers(dest="command", required=True)
    for name, do in (("diagnose", cmd_diagnose), ("process", cmd_process), ("bench", cmd_bench)):
        p = commands.add_parser(name)
        p.set_defaults(do=do)
        p.add_argument("path")
        p.add_argument("--pages", help="such as 1,2,5-9; all without it")
        p.add_argument("--outdir", default=f"output/{name}")
        p.add_argument("--dpi", type=int, default=200)
        p.add_argument("--width", type=float, default=595.0)
        p.add_argument("--height", type=float, default=842.0)
        if name == "process":
            p.add_argument("--mode", choices=["auto", "text_only", "ocr_only"], default="auto")
            p.add_argument("--merge-across-pages", action="store_true")
            p.add_argument("--no-strip-repeated", action="store_true", help="no effect without --strip-repeated")
            p.add_argument("--strip-repeated", action="store_true", help="leave out lines that repeat through a document")
            p.add_argument("--include-blocks", action="store_true", help="list each page's blocks in document.json")
            p.add_argument("--cache", help="folder of the page cache")
        if name == "bench":
            p.add_argument("--top-k", type=int, default=4)
            p.add_argument("--questions", type=int, default=len(bench.QUESTIONS))
            p.add_argument("--baseline-answer-tokens", type=int, default=350)
            p.add_argument("--rag-answer-tokens", type=int, default=300)
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if not Path(args.path).exists() and "://" not in args.path:
        print(f"no such file: {args.path}", file=sys.stderr)
        return 2
    Path(args.outdir).mkdir(parents=True, exist_ok=True)
    args.do(SparkSession.builder.appName("docspark").getOrCreate(), args)
    return 0


if __name__ == "__main__":
    sys.exit(main())
