"""Exact dedup against a persistent digest index, bucketed and sorted by digest."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm.common import apart, ascii_lower, join_groups, put_new, read_all, shared_dir, stage

SCHEMA = "digest string, keep_id {}, group_size long, seq long, attempt string"
#: Batches after which the index is rewritten, so that a bucket never has many files.
COMPACT_AFTER = 16


def digest(text: Column) -> Column:
    """SHA-256 (hex) of the text, A-Z lower-cased, null as empty."""
    return F.sha2(ascii_lower(F.coalesce(text, F.lit(""))).cast("binary"), 256)


class DigestIndex:
    """Digests of all texts taken in so far: an external table, bucketed and sorted by digest, and a log of batches.

    ``location`` survives the session; its bucket count and id type are stored with it, and opening it with others is
    an error. A batch appends one sorted file a bucket and counts once its entry in the log is written, in one step:
    rows of an attempt that failed before are never read, and a batch that is driven again is judged as before, by the
    batches before it, and not appended again. Joins with new digests read the index without shuffling it.
    """

    def __init__(self, spark: SparkSession, location: str | None = None, buckets: int | None = None, id_type: str = "bigint"):
        self.spark = spark
        self.location = location or f"{shared_dir(spark)}/llm/digest-index-{uuid.uuid4().hex}"
        asked = {"buckets": buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), "id_type": id_type}
        put_new(spark, f"{self.location}/about/index.json", json.dumps(asked))
        stored = json.loads(read_all(spark, f"{self.location}/about")[0])
        if stored["id_type"] != id_type or buckets and stored["buckets"] != buckets:
            raise ValueError(f"the index at {self.location} has {stored}, not {asked}")
        self.buckets, self.id_type = stored["buckets"], id_type

    def log(self) -> list[dict]:
        """Committed batches in order: seq, batch, attempt and, of a compaction, the folder that holds all before it."""
        return [json.loads(x) for x in read_all(self.spark, f"{self.location}/log")]

    def table(self, folder: str) -> str:
        name = f"digest_index_{uuid.uuid5(uuid.NAMESPACE_URL, f'{self.location}/{folder}').hex}"
        where = f"{self.location}/{folder}".replace("'", "\\'")
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({SCHEMA.format(self.id_type)}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{where}'")
        return name

    def folder(self, log: list[dict]) -> str:
        return next((x["folder"] for x in reversed(log) if "folder" in x), "data")

    def read(self, until: int | None = None) -> DataFrame:
        """Rows of committed batches, of those with a lesser ``seq`` than ``until`` if given."""
        log = self.log()
        rows = self.spark.table(self.table(self.folder(log))).filter(F.col("attempt").isin([x["attempt"] for x in log]))
        return rows if until is None else rows.filter(F.col("seq") < until)

    def write(self, rows: DataFrame, folder: str, entry: dict) -> None:
        columns = [c.split()[0] for c in SCHEMA.format("").split(", ")]
        made = rows.withColumn("attempt", F.lit(entry["attempt"])).select(*columns).repartition(self.buckets, "digest")
        made.write.bucketBy(self.buckets, "digest").sortBy("digest").format("parquet").mode("append").saveAsTable(self.table(folder))
        if not put_new(self.spark, f"{self.location}/log/{entry['seq']:012d}.json", json.dumps(entry)):
            raise RuntimeError(f"another batch was committed to {self.location} meanwhile; drive this one again")

    def add(self, groups: DataFrame, batch: str) -> int:
        """Take in ``groups`` (digest, keep_id, group_size): those that the anti-join with the index leaves are appended.

        Returns the batch's seq. A batch that was committed before is left as it is.
        """
        log = self.log()
        seq = next((x["seq"] for x in log if x["batch"] == batch), None)
        if seq is not None:
            return seq
        seq = max((x["seq"] for x in log), default=0) + 1
        fresh = groups.join(self.read().select("digest").hint("merge"), "digest", "left_anti")
        self.write(fresh.withColumn("seq", F.lit(seq).cast("long")), self.folder(log), {"seq": seq, "batch": batch, "attempt": uuid.uuid4().hex})
        since = len(log) - max((n for n, x in enumerate(log) if "folder" in x), default=-1)
        if since >= COMPACT_AFTER:
            self.compact()
        return seq

    def compact(self) -> None:
        """Write all committed rows into a new folder, one sorted file a bucket; rows keep their seq."""
        seq = max((x["seq"] for x in self.log()), default=0) + 1
        folder = f"data-{seq}-{uuid.uuid4().hex}"
        self.write(self.read(), folder, {"seq": seq, "batch": f"compaction {folder}", "attempt": uuid.uuid4().hex, "folder": folder})


def judged(docs: DataFrame, index: DigestIndex, text: str, batch: str | None) -> DataFrame:
    """doc_id, digest, n, keep_id, group_size, stays: one row per doc_id and digest, ``n`` of them in ``docs``."""
    counted = stage(docs.select("doc_id", digest(F.col(text)).alias("digest")).groupBy("doc_id", "digest").agg(F.count("*").alias("n")), "digests")
    groups = stage(counted.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size")), "digest-groups")
    seq = index.add(groups, batch or uuid.uuid4().hex)
    held = index.read(seq + 1).select("digest", "keep_id", (F.col("seq") == seq).alias("own"))
    found = stage(groups.select("digest", "group_size").join(held.hint("merge"), "digest"), "digest-found")
    joined = join_groups(counted, found, "digest", "group_size")
    return joined.withColumn("stays", F.col("own") & F.col("doc_id").eqNullSafe(F.col("keep_id"))).drop("own")


def assign(docs: DataFrame, index: DigestIndex, text: str = "text", batch: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, digest; new digests go into ``index``.

    keep_id is what the index has: of the batch that brought a digest, the largest non-null doc_id stays, and a row of
    a later batch goes. group_size counts the batch's own rows. ``batch`` names the batch; the same name gives the
    same answer again. Null texts count as empty. Repeated rows (same doc_id and text) are one kept row and dropped
    ones. A group whose doc_ids are all null keeps one of its rows, with keep_id null. An empty table gives none;
    further columns are not read.
    """
    copies = judged(docs, index, text, batch).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return copies.select("doc_id", "keep_id", "group_size", (F.col("stays") & (F.col("copy") == 1)).alias("kept"), "digest")


def keep_one(docs: DataFrame, index: DigestIndex, text: str = "text", batch: str | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, all columns; of rows equal in doc_id and text, one. Texts are moved once at most."""
    stays = stage(judged(docs, index, text, batch).filter("stays").select(F.col("doc_id").alias("_doc"), F.col("digest").alias("_digest"), "n"), "digest-stays")
    plain, names = apart(docs)
    rows = plain.withColumn("_d", digest(F.col(names[text])))
    same = F.col(names["doc_id"]).eqNullSafe(F.col("_doc")) & (F.col("_d") == F.col("_digest"))
    twice = stays.filter("n > 1")
    if twice.isEmpty():
        found = rows.join(stays, same, "left_semi")
    else:
        once = rows.join(stays.filter("n = 1"), same, "left_semi")
        found = once.unionByName(rows.join(twice, same, "left_semi").dropDuplicates([names["doc_id"], "_d"]))
    return found.select(*names.values()).toDF(*docs.columns)
