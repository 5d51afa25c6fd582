"""Lexical retrieval over chunks, for many queries at once."""

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docspark.functions.textfeat import tokenize
from docspark.operators.pagefold import normalized
from docspark.staging import stage

#: Rows of (query, token) up to which they are broadcast, some 100 bytes each; more take shuffled joins.
BROADCAST_ROWS = 200_000
#: Terms of chunks, each times the queries that ask for it, that a task adds up.
TASK_ROWS = 2_000_000
#: Chunks whose tokens a task counts.
TASK_CHUNKS = 2_000
#: Code points of texts that are cut into tokens together.
TEXT_CHARS = 1_000_000


def tokens(chunks: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """key, token, n: the distinct tokens of each text, as by ``tokenize``, and how often they come.

    Texts are cut some TEXT_CHARS at a time, so a task holds no more than these or one longer text.
    """

    def groups(texts: list[str | None]) -> Iterator[list[int]]:
        held, size = [], 0
        for i, t in enumerate(texts):
            if t:
                held.append(i)
                size += len(t)
            if held and size >= TEXT_CHARS:
                yield held
                held, size = [], 0
        if held:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].to_pylist()
            for some in groups(texts):
                counts = [Counter(w for w in t.split() if len(w) > 1) for t in normalized([texts[i] for i in some])]
                of = np.repeat(np.array(some), [len(c) for c in counts])
                yield pa.RecordBatch.from_arrays([batch["key"].take(pa.array(of)), pa.array([w for c in counts for w in c], pa.string()), pa.array([n for c in counts for n in c.values()], pa.int64())], ["key", "token", "n"])

    rows = chunks.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, token string, n bigint").withColumnRenamed("key", key)


def term_frequencies(chunks: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    return tokens(chunks, key, text).groupBy(key, "token").agg(F.sum("n").alias("tf"))


def idf(frequencies: DataFrame, n_chunks: int | Column) -> DataFrame:
    """token, df, idf; ``n_chunks`` may be a scalar subquery, so that nothing is counted while the plan is built."""
    n = F.greatest(F.lit(n_chunks) if isinstance(n_chunks, int) else n_chunks, F.lit(1))
    return frequencies.groupBy("token").agg(F.count("*").alias("df")).withColumn("idf", F.log((n + 1) / (F.col("df") + 0.5)))


def search(chunks: DataFrame, queries: DataFrame, k: int = 4, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """query_id, chunk key, score and rank of the k best chunks with a positive score; ties go to the smaller key.

    Texts are cut once: tokens that no query asks for are dropped before anything is shuffled, the others are staged
    by chunk. So a chunk's scores for all queries are sums within a partition, and of each partition only the k best
    of a query go on. Partitions grow in number with the input, so that each counts TASK_CHUNKS chunks or so and adds
    up TASK_ROWS terms: every term of a chunk counts for each query that asks for it. Query tokens count with their
    multiplicity. The queries' tokens are broadcast while they are BROADCAST_ROWS at most.
    """
    asked = stage(queries.select("query_id", F.explode(tokenize(F.col("question"))).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("times")), "asked")
    few = asked.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS

    def small(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if few else df

    wanted = tokens(chunks, key, text).join(small(asked.select("token").distinct()), "token", "left_semi")
    tf = stage(wanted.repartition(chunks.count() // TASK_CHUNKS + 1, key).groupBy(key, "token").agg(F.sum("n").alias("tf")), "postings")
    terms = tf.groupBy("token").agg(F.count("*").alias("n")).join(asked.groupBy("token").agg(F.count("*").alias("m")), "token").agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0
    weighted = stage(asked.join(idf(tf, chunks.agg(F.count("*")).scalar()), "token"), "weights")
    postings = tf.repartition(terms // TASK_ROWS + 1, key).join(small(weighted), "token")
    hits = postings.groupBy("query_id", key).agg(F.sum(F.col("times") * (1 + F.log("tf")) * F.col("idf")).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), key)
    return hits.filter("score > 0").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
