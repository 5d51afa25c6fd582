"""Shared pieces: tables, the shared folder, staged tables and the hot-key join."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.staging import shared_dir

#: Keys holding more than 1/HEAVY_SHARE of all rows count as hot. There are fewer than HEAVY_SHARE of them,
#: whatever the input, which bounds what is broadcast for them.
HEAVY_SHARE = 512


#: The public vocabulary of op3, op8 and the pipeline.
TOKENIZER = "byte_bpe_50k.json"


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Folder:
    """A folder of staged tables in the shared folder, for those that are of no use once a result is written."""

    def __init__(self, spark: SparkSession, name: str = ""):
        self.spark, self.path = spark, f"{shared_dir(spark)}/llm" + (f"/{name}-{uuid.uuid4().hex}" if name else "")

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        return self.stage_at(df, name)[0]

    def stage_at(self, df: DataFrame, name: str) -> tuple[DataFrame, str]:
        path = f"{self.path}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path), path

    def remove(self) -> None:
        remove(self.spark, self.path)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs only the tasks that read it, and each later pass starts here.
    """
    return Folder(df.sparkSession).stage(df, name)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a staged table by the file system that holds it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def put_new(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file in one step unless it exists; whether it was written."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(at):
        return False
    part = at.suffix(f".{uuid.uuid4().hex}.tmp")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.rename(part, at):
        return True
    fs.delete(part, False)
    return False


def read_all(spark: SparkSession, folder: str) -> list[str]:
    """The texts of the small JSON files in a folder, by name; none if there is no such folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    found = []
    for status in sorted(fs.listStatus(at), key=lambda s: s.getPath().getName()):
        if status.getPath().getName().endswith(".json"):
            given = fs.open(status.getPath())
            found.append(bytes(given.readAllBytes()).decode())
            given.close()
    return found


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often the body uses it in lambdas."""
    return F.transform(F.array(value), body)[0]


def apart(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns named by place, and those names by the old ones: nothing clashes with what is added."""
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """Inner join of ``rows`` with one row of ``groups`` per non-null ``key``; ``size`` counts a group's rows.

    Groups with over 1/HEAVY_SHARE of all rows are broadcast (fewer than HEAVY_SHARE exist at any input size),
    so that their rows stay where they are; the others take a shuffled join without hot keys. Both inputs are
    read twice and should be staged tables.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    heavy = groups.filter(F.col(size) * HEAVY_SHARE > F.lit(total))
    cold = rows.join(F.broadcast(heavy.select(key)), key, "left_anti")
    light = groups.filter(F.col(size) * HEAVY_SHARE <= F.lit(total))
    return rows.join(F.broadcast(heavy), key).unionByName(cold.join(light, key))
