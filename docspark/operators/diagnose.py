"""Page diagnosis: statistics, status, method, and the rollup by document."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.functions.chars import CONTROL, PERSIAN_NO_FORMS_B, PRIVATE, READABLE, REPLACED, count, filter_once, strip

STATUSES = ("text_ok", "text_plus_visual", "text_broken", "scanned", "empty")
METHODS = {"text_ok": "text_extract_sorted", "text_plus_visual": "hybrid", "text_broken": "ocr", "scanned": "ocr", "empty": "skip"}
MIN_CHARS, BROKEN, MIN_LETTERS, IMAGE_AREA, DRAWINGS = 50, 0.10, 20, 0.30, 20


def text_stats(pages: DataFrame, text: str = "text") -> DataFrame:
    """Adds the character counts of a page's text layer; null counts as no text."""
    t = F.coalesce(F.col(text), F.lit(""))
    return pages.withColumns({
        "char_count": F.length(t), "readable_char_count": count(t, READABLE), "persian_char_count": count(t, PERSIAN_NO_FORMS_B),
        "pua_char_count": count(t, PRIVATE), "replacement_char_count": count(t, REPLACED), "control_char_count": count(t, CONTROL),
    })


def object_stats(pages: DataFrame) -> DataFrame:
    """Adds all statistics of page objects: characters of raw_text, blocks that are not blank, share of the page under
    images (image_rect_areas over width * height, 1 at most; 0 for a page without area)."""
    area = F.col("width") * F.col("height")
    covered = F.aggregate(F.coalesce("image_rect_areas", F.array().cast("array<double>")), F.lit(0.0), lambda a, x: a + F.coalesce(F.abs(x), F.lit(0.0)))
    blocks = F.filter(F.coalesce("text_blocks", F.array().cast("array<string>")), lambda b: strip(b) != "")
    return text_stats(pages, "raw_text").withColumns({"text_block_count": F.size(blocks), "image_area_ratio": F.when(area > 0, F.least(covered / area, F.lit(1.0))).otherwise(0.0)})


def broken_ratio() -> Column:
    bad = F.col("pua_char_count") + F.col("replacement_char_count") + F.col("control_char_count")
    return F.coalesce(bad / F.nullif(F.col("char_count"), F.lit(0)), F.lit(0.0))


def persian_ratio() -> Column:
    return F.coalesce(F.col("persian_char_count") / F.nullif(F.col("readable_char_count"), F.lit(0)), F.lit(0.0))


def is_visual() -> Column:
    return (F.col("image_count") >= 1) & (F.col("image_area_ratio") >= IMAGE_AREA) | (F.col("drawing_count") >= DRAWINGS)


def status() -> Column:
    chars, nothing = F.col("char_count"), (F.col("image_count") == 0) & (F.col("drawing_count") == 0)
    few, broken = chars < MIN_CHARS, broken_ratio() >= BROKEN
    return (
        F.when((chars == 0) & nothing, "empty")
        .when(few & (chars > 0) & broken, "text_broken")
        .when(few, "scanned")
        .when(broken | (F.greatest("readable_char_count", "persian_char_count") < MIN_LETTERS), "text_broken")
        .when(is_visual(), "text_plus_visual")
        .otherwise("text_ok")
    )


def method(state: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in METHODS.items() for x in pair))[state]


def diagnose_pages(pages: DataFrame) -> DataFrame:
    return pages.withColumn("status", status()).withColumn("method", method(F.col("status"))).withColumns({"broken_ratio": broken_ratio(), "persian_ratio": persian_ratio()})


def diagnose_documents(diagnosed: DataFrame, key: str = "document_id") -> DataFrame:
    """One row per document: page_count, counts by status (zero-filled), dominant status, method."""
    counts = [F.count_if(F.col("status") == s).alias(f"n_{s}") for s in STATUSES]
    any_ocr, any_text = F.bool_or(F.col("method") == "ocr"), F.bool_or(F.col("method").isin("text_extract_sorted", "hybrid"))
    ranked = F.array(*(F.struct(F.col(f"n_{s}").alias("n"), F.lit(-i).alias("i"), F.lit(s).alias("s")) for i, s in enumerate(STATUSES)))
    rows = diagnosed.groupBy(key).agg(F.count("*").alias("page_count"), *counts, any_ocr.alias("_ocr"), any_text.alias("_text"))
    how = F.when(F.col("_ocr") & F.col("_text"), "hybrid").when(F.col("_ocr"), "ocr").when(F.col("_text"), "text_extract_sorted").otherwise("skip")
    return rows.withColumn("dominant_status", F.array_max(ranked)["s"]).withColumn("method", how).drop("_ocr", "_text")


def pages_with_status(diagnosed: DataFrame, *wanted: str, key: str = "document_id") -> DataFrame:
    return filter_once(diagnosed, F.col("status").isin(*wanted)).groupBy(key).agg(F.array_sort(F.collect_list("page_number")).alias("pages"))
