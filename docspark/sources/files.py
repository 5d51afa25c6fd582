"""Files as documents, text blocks from nested page objects, and the writers. PDF and OCR libraries are optional."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.functions.chars import strip
from docspark.functions.normalize import nfc, normalize_text

BLOCKS = "document_id string, page_number int, block_idx int, text string, score double, l double, t double, r double, b double"


#: A page's objects: what its text layer, images and drawings are.
LINES = "array<struct<bbox:array<double>,spans:array<struct<text:string>>>>"
BLOCK = "struct<type:int,bbox:array<double>,lines:array<struct<bbox:array<double>,spans:array<struct<text:string>>>>>"
OBJECTS = f"document_id string, page_number int, checksum_sha256 string, title string, author string, width double, height double, raw_text string, text_blocks array<string>, image_rect_areas array<double>, image_count int, drawing_count int, font_count int, blocks array<{BLOCK}>"


def document_id(path: Column, checksum: Column) -> Column:
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")
    return F.concat_ws("-", stem, F.substring(checksum, 1, 8))


def open_documents(spark: SparkSession, path: str) -> DataFrame:
    """document_id, path, checksum, content of every file; a missing path is an error."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(document_id(F.col("path"), F.sha2("content", 256)).alias("document_id"), "path", F.sha2("content", 256).alias("checksum"), "content")


def page_objects(spark: SparkSession, path: str, pages: list[int] | None = None) -> DataFrame:
    """Page objects of Parquet or JSON lines, or of PDFs where the PDF library is installed: OBJECTS columns.

    ``path`` may be a file, a folder or a glob; what it holds is told by the names in it. ``pages``: only those page
    numbers; of a document that has none of them, all. Parquet row groups without them are skipped, and other pages of
    PDFs are not read.
    """
    kind = _kind(spark, path)
    if kind == "pdf":
        return pdf_objects(open_documents(spark, path), pages)
    return select_pages(spark.read.schema(OBJECTS).format(kind).load(path), pages)


def _kind(spark: SparkSession, path: str) -> str:
    found = re.search(r"\.(pdf|jsonl?|parquet)(?:\.\w+)?$", path.lower())
    if not found:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        names = [x.getPath().getName().lower() for top in fs.globStatus(at) or [] for x in (fs.listStatus(top.getPath()) if top.isDirectory() else [top])]
        found = next((m for n in sorted(names) if (m := re.search(r"\.(pdf|jsonl?|parquet)(?:\.\w+)?$", n))), None)
    return {"jsonl": "json"}.get(found[1], found[1]) if found else "parquet"


def select_pages(objects: DataFrame, pages: list[int] | None) -> DataFrame:
    """The wanted pages of each document; all pages of documents that have none of them."""
    if not pages:
        return objects
    wanted = F.col("page_number").isin(pages)
    inside = objects.filter(wanted)
    return inside.unionByName(objects.filter(~wanted).join(inside.select("document_id").distinct(), "document_id", "left_anti").select(*objects.columns))


def text_blocks(pages: DataFrame) -> DataFrame:
    """Blocks of a text layer: pages hold blocks (type, bbox) of lines (bbox) of spans (text); only type 0 is text."""
    of_text = F.filter("blocks", lambda b: b["type"] == 0)
    lines = F.flatten(F.transform(of_text, lambda b: F.transform(F.coalesce(b["lines"], F.array().cast(LINES)), lambda x: F.struct(x["spans"].alias("spans"), F.coalesce(x["bbox"], b["bbox"]).alias("box")))))
    rows = pages.select("document_id", "page_number", F.posexplode(lines).alias("block_idx", "line"))
    text, box = strip(F.array_join(F.transform("line.spans", lambda s: s["text"]), "")), F.col("line.box")
    kept = rows.select("document_id", "page_number", "block_idx", normalize_text(text).alias("text"), F.lit(1.0).alias("score"), box[0].alias("l"), box[1].alias("t"), box[2].alias("r"), box[3].alias("b"))
    return kept.filter("text != ''")


def plain_page_text(pages: DataFrame) -> DataFrame:
    """document_id, page_number, text: normalized blocks that are not blank, a blank line between."""
    texts = F.transform("text_blocks", lambda x: normalize_text(x, composed=True))
    composed = pages.withColumn("text_blocks", F.split(nfc(F.array_join("text_blocks", "\x1f")), "\x1f"))
    return composed.select("document_id", "page_number", F.array_join(F.filter(texts, lambda x: x != ""), "\n\n").alias("text"))


def pdf_blocks(documents: DataFrame) -> DataFrame:
    """Text-layer blocks of PDF bytes; needs the optional PDF library on the executors."""
    import pymupdf  # noqa: F401

    def run(frames: Iterator) -> Iterator:
        import pandas as pd
        import pymupdf

        for frame in frames:
            for doc, content in zip(frame["document_id"], frame["content"], strict=True):
                with pymupdf.open(stream=content, filetype="pdf") as pdf:
                    rows = [(doc, n, i, line_text(line), 1.0, *(line.get("bbox") or block["bbox"])) for n, page in enumerate(pdf, 1) for i, (block, line) in enumerate((b, x) for b in page.get_text("dict", sort=True)["blocks"] if b["type"] == 0 for x in b["lines"])]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in BLOCKS.split(", ")])

    def line_text(line: dict) -> str:
        return "".join(s["text"] for s in line["spans"]).strip()

    return documents.select("document_id", "content").mapInPandas(run, BLOCKS)


def pdf_objects(documents: DataFrame, wanted: list[int] | None = None) -> DataFrame:
    """OBJECTS of every (wanted) page of PDF bytes; blank titles and authors are null. Needs the optional PDF library."""
    import pymupdf  # noqa: F401

    def run(frames: Iterator) -> Iterator:
        import pandas as pd
        import pymupdf

        for frame in frames:
            for doc, checksum, content in zip(frame["document_id"], frame["checksum"], frame["content"], strict=True):
                with pymupdf.open(stream=content, filetype="pdf") as pdf:
                    about = [(pdf.metadata.get(k) or "").strip() or None for k in ("title", "author")]
                    numbers = [n for n in sorted(set(wanted or ())) if 1 <= n <= len(pdf)] or range(1, len(pdf) + 1)
                    for number, page in ((n, pdf[n - 1]) for n in numbers):
                        images = page.get_images(full=True)
                        areas = [abs(rect) for image in images for rect in page.get_image_rects(image[0])]
                        blocks = [{"type": b["type"], "bbox": list(b["bbox"]), "lines": [{"bbox": list(x["bbox"]), "spans": [{"text": t["text"]} for t in x["spans"]]} for x in b.get("lines", [])]} for b in page.get_text("dict", sort=True)["blocks"]]
                        row = (doc, number, checksum, *about, page.rect.width, page.rect.height, page.get_text("text"), [b[4] for b in page.get_text("blocks")], areas, len(images), len(page.get_drawings()), len(page.get_fonts(full=True)), blocks)
                        yield pd.DataFrame([row], columns=[c.split()[0] for c in OBJECTS.split(", ")])

    return documents.select("document_id", "checksum", "content").mapInPandas(run, OBJECTS)


def pdf_images(documents: DataFrame, pages: DataFrame | None = None, dpi: int = 200) -> DataFrame:
    """document_id, page_number, image (PNG bytes) page by page, of ``pages`` if given. Needs the optional PDF library."""
    import pymupdf  # noqa: F401

    def run(frames: Iterator) -> Iterator:
        import pandas as pd
        import pymupdf

        for frame in frames:
            for doc, content, wanted in frame.itertuples(index=False, name=None):
                with pymupdf.open(stream=content, filetype="pdf") as pdf:
                    for number in sorted({int(n) for n in wanted}) if wanted is not None else range(1, len(pdf) + 1):
                        if 1 <= number <= len(pdf):
                            yield pd.DataFrame([(doc, number, pdf[number - 1].get_pixmap(dpi=dpi).tobytes("png"))], columns=["document_id", "page_number", "image"])

    rows = documents.select("document_id", "content")
    if pages is None:
        rows = rows.withColumn("wanted", F.lit(None).cast("array<int>"))
    else:
        rows = rows.join(pages.groupBy("document_id").agg(F.collect_set("page_number").alias("wanted")), "document_id")
    return rows.mapInPandas(run, "document_id string, page_number int, image binary")


def load_images(documents: DataFrame, dpi: int = 200) -> DataFrame:
    """All pages of small documents at once: document_id, images (array of page_number and PNG bytes, in order)."""
    pages = pdf_images(documents, None, dpi)
    return pages.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("page_number", "image"))).alias("images"))


def write_images(images: DataFrame, path: str) -> None:
    """One Parquet row an image, by document: an object store copes better with this than with a file a page."""
    images.withColumn("name", F.format_string("page_%d.png", "page_number")).write.mode("overwrite").parquet(path)


def preprocessed(engine: Callable[[], Callable[[bytes], list[tuple]]], upscale: float = 1.0, contrast: float = 1.0, sharpen: bool = False, gray: bool = False) -> Callable[[], Callable[[bytes], list[tuple]]]:
    """``engine`` behind image preprocessing (all off by default); needs the optional imaging library once any is on."""

    def build() -> Callable[[bytes], list[tuple]]:
        recognise = engine()
        if upscale == 1.0 and contrast == 1.0 and not sharpen and not gray:
            return recognise
        from io import BytesIO

        from PIL import Image, ImageEnhance, ImageFilter

        def prepared(data: bytes) -> list[tuple]:
            image = Image.open(BytesIO(data)).convert("L" if gray else "RGB")
            if upscale != 1.0:
                image = image.resize((round(image.width * upscale), round(image.height * upscale)), Image.Resampling.LANCZOS)
            image = ImageEnhance.Contrast(image).enhance(contrast) if contrast != 1.0 else image
            image = image.filter(ImageFilter.SHARPEN) if sharpen else image
            out = BytesIO()
            image.save(out, "PNG")
            return recognise(out.getvalue())

        return prepared

    return build


#: Engines of this Python worker, by their factory. Workers outlive tasks, so a model is loaded once for each.
ENGINES: dict[str, Callable[[bytes], list[tuple]]] = {}


def engine_of(key: str, factory: Callable[[], Callable[[bytes], list[tuple]]]) -> Callable[[bytes], list[tuple]]:
    if key not in ENGINES:
        ENGINES[key] = factory()
    return ENGINES[key]


def reset_engines() -> None:
    """Forget the engines of this process."""
    ENGINES.clear()


def ocr_blocks(images: DataFrame, engine: Callable[[], Callable[[bytes], list[tuple]]]) -> DataFrame:
    """Blocks of page images; ``engine()`` is built once a Python worker and maps image bytes to (text, score, l, t, r, b)."""
    key = hashlib.sha256(cloudpickle.dumps(engine)).hexdigest()

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        from docspark.sources import files as own  # the worker's module, not a copy of its names in this closure

        recognise = own.engine_of(key, engine)
        for frame in frames:
            rows = [(d, n, i, text.strip(), *rest) for d, n, image in frame.itertuples(index=False, name=None) for i, (text, *rest) in enumerate(recognise(image) or [])]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in BLOCKS.split(", ")])

    return images.select("document_id", "page_number", "image").mapInPandas(run, BLOCKS)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """One JSON object a line."""
    chunks.write.mode("overwrite").json(path)


def document_text(pages: DataFrame) -> DataFrame:
    """document_id, value: a heading line and the text of each page with its method."""
    part = F.concat(F.lit("--- page "), F.col("page_number").cast("string"), F.lit(" ("), F.col("source_method"), F.lit(") ---\n"), F.col("text"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("page_number", part.alias("p")))), lambda x: x["p"])
    return pages.groupBy("document_id").agg(F.concat(F.lit("# "), F.first("document_id"), F.lit("\n\n"), F.array_join(ordered, "\n\n")).alias("value"))


def write_texts(pages: DataFrame, path: str) -> None:
    document_text(pages).select("value").write.mode("overwrite").text(path)


def to_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


#: Fields of the records that the JSON sinks write.
RECORDS = {
    "chunk": "document_id string, chunk_index int, chunk_id string, chunk_type string, text string, page_start int, page_end int, section string, section_path array<string>, bbox array<double>, page_bboxes map<string,array<double>>, score double, char_count int, source_method string, language string, engine_version string, normalized boolean",
    "page": "document_id string, page_number int, status string, source_method string, text string, cache_hit boolean, fallback_used boolean",
    "diagnosis": "document_id string, page_count long, n_text_ok long, n_text_plus_visual long, n_text_broken long, n_scanned long, n_empty long, dominant_status string, method string",
    "region": "document_id string, page_number int, region_idx int, role string, text string, l double, t double, r double, b double, score double, n_lines long, heading_text string, source_method string",
    "job": "document_id string, pages array<int>, mode string, dpi int, merge_across_pages boolean, checksum_sha256 string",
}


def read_json(spark: SparkSession, path: str, record: str) -> DataFrame:
    """Records of JSON lines; a line that is no such record is an error, fields that are missing are null."""
    return spark.read.schema(RECORDS[record]).option("mode", "FAILFAST").json(path)
