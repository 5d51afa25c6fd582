"""Page cache: an append-only table, the latest row of a key wins."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.operators.chunking import ENGINE_VERSION

COLUMNS = "document_id string, page_no int, text string, checksum_sha256 string, dpi int, source_method string, engine_version string, created_at string, written_at timestamp"
IDENTITY = ("checksum_sha256", "dpi", "source_method", "engine_version")


class PageCache:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def upsert(self, pages: DataFrame) -> None:
        rows = pages.withColumn("engine_version", F.lit(ENGINE_VERSION)).withColumn("written_at", F.current_timestamp())
        have = set(rows.columns)
        rows.select(*(F.col(n).cast(t) if n in have else F.lit(None).cast(t).alias(n) for n, t in (c.split() for c in COLUMNS.split(", ")))).write.mode("append").parquet(self.path)

    def exists(self) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def read(self) -> DataFrame:
        return latest(self.spark.read.schema(COLUMNS).parquet(self.path))


def latest(rows: DataFrame, by: str = "written_at") -> DataFrame:
    others = [c for c in rows.columns if c not in ("document_id", "page_no")]
    picked = rows.groupBy("document_id", "page_no").agg(F.max_by(F.struct(*others), by).alias("_r"))
    return picked.select("document_id", "page_no", "_r.*")


def from_json(rows: DataFrame, value: str = "value") -> DataFrame:
    """Cache rows of JSON lines; fields that are missing get their defaults (dpi 200, method ocr, else empty)."""
    names = [c for c in COLUMNS.split(", ") if not c.startswith("written_at")]
    got = rows.select(F.from_json(value, ", ".join(names)).alias("r")).select("r.*")
    return got.na.fill({"dpi": 200, "source_method": "ocr", "text": "", "checksum_sha256": "", "engine_version": "", "created_at": ""})


def lookup(pages: DataFrame, cache: DataFrame) -> DataFrame:
    """``pages`` with cache_hit and cached_text: the cached page counts if checksum, dpi, method and version agree."""
    old = cache.select("document_id", "page_no", F.col("text").alias("_text"), *(F.col(c).alias(f"_{c}") for c in IDENTITY))
    same = F.lit(True)
    for c in IDENTITY:
        same = same & F.coalesce(F.col(c) == F.col(f"_{c}"), F.lit(False))
    joined = pages.join(old, ["document_id", "page_no"], "left").withColumn("cache_hit", same)
    return joined.withColumn("cached_text", F.when(F.col("cache_hit"), F.col("_text"))).drop("_text", *(f"_{c}" for c in IDENTITY))


def misses(pages: DataFrame, cache: DataFrame) -> DataFrame:
    return pages.join(cache.select("document_id", "page_no", *IDENTITY), ["document_id", "page_no", *IDENTITY], "left_anti")
