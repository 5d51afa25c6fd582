"""Token and cost benchmark: retrieved chunks against the whole text, question by question."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.functions.textfeat import estimate_tokens
from docspark.operators.cost import Prices, money
from docspark.operators.retrieval import search

# The benchmark's questions and the pages that answer them.
QUESTIONS = [
    ("ویژگی های فلزات چیست و چه کاربردهایی در زندگی دارند؟", [3, 4]),
    ("اوزون چیست و چه نقشی دارد؟", [5, 6]),
    ("کاربردهای آمونیاک کدام اند؟", [7]),
    ("در مدل بور محل پروتون ها و الکترون ها کجاست؟", [7, 8]),
    ("در جدول تناوبی ستون ها و سطرها چه نام دارند؟", [9]),
]


def fixed_questions(spark: SparkSession, n: int = len(QUESTIONS)) -> DataFrame:
    return spark.createDataFrame([(i, text, pages) for i, (text, pages) in enumerate(QUESTIONS[:n])], "query_id int, question string, expected_pages array<int>")


def usage(context: Column, question: Column, answer: int, prices: Prices = Prices()) -> Column:
    """Struct of a scenario's tokens and costs."""
    tokens = context + question
    return F.struct(
        context.alias("context_tokens"), question.alias("question_tokens"), F.lit(answer).alias("answer_tokens"), tokens.alias("input_tokens"), (tokens + answer).alias("total_tokens"),
        *(c.alias(name) for name, c in money(tokens, F.lit(answer), prices).items()),
    )


#: What retrieval is to the rest: (chunks, questions, k) to query_id, chunk_id, score, rank.
Retriever = Callable[[DataFrame, DataFrame, int], DataFrame]


def question_bench(chunks: DataFrame, questions: DataFrame, baseline_tokens: int, k: int = 4, baseline_answer: int = 350, rag_answer: int = 300, prices: Prices = Prices(), retriever: Retriever = search) -> DataFrame:
    """A row per question: retrieved_pages, page_hit, baseline, pipeline_rag and input_token_reduction_pct.

    ``chunks``: chunk_id, text, page_start, page_end; ``questions``: query_id, question, expected_pages. A question
    without a hit has no pages and an empty context.
    """
    hits = retriever(chunks, questions, k).hint("shuffle_hash").join(chunks.select("chunk_id", F.length("text").alias("n"), "page_start", "page_end"), "chunk_id")
    found = hits.groupBy("query_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.sequence("page_start", "page_end"))))).alias("retrieved_pages"), (F.sum("n") + 2 * (F.count("*") - 1)).alias("n"))  # k rows a question
    rows = questions.join(found, "query_id", "left").withColumn("retrieved_pages", F.coalesce("retrieved_pages", F.array().cast("array<int>")))
    n = F.coalesce("n", F.lit(0))
    rag = F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.rint(n / F.lit(3.2)).cast("int")))
    rows = rows.withColumn("pipeline_rag", usage(rag, estimate_tokens(F.col("question")), rag_answer, prices)).withColumn("baseline", usage(F.lit(baseline_tokens), estimate_tokens(F.col("question")), baseline_answer, prices))
    cut = F.round(100 * (1 - F.col("pipeline_rag.input_tokens") / F.nullif(F.col("baseline.input_tokens"), F.lit(0))), 1)
    return rows.select("query_id", "question", "expected_pages", "retrieved_pages", F.arrays_overlap("retrieved_pages", "expected_pages").alias("page_hit"), "baseline", "pipeline_rag", cut.alias("input_token_reduction_pct"))


def summary(bench: DataFrame) -> DataFrame:
    """One row: question count, hit rate, mean reduction and mean context; zeros without questions."""

    def mean(x: Column, places: int) -> Column:
        return F.coalesce(F.round(F.avg(x), places), F.lit(0.0))

    return bench.agg(F.count("*").alias("questions"), mean(F.col("page_hit").cast("int"), 2).alias("retrieval_page_hit_rate"), mean(F.col("input_token_reduction_pct"), 1).alias("avg_input_token_reduction_pct"), mean(F.col("pipeline_rag.context_tokens"), 1).alias("rag_context_tokens_avg"))
