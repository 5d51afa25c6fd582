"""Sharding by sampled splitters: size-weighted key samples, quantile boundaries, ranges, overfull ranges subdivided.

The key is the text's hash, so equal texts lie side by side. Boundaries cut the keys into ranges, RANGES_A_SHARD per
shard and more where the rows are many; a range with too many bytes or rows (a hot text) is subdivided by a hash of
doc_id and of the row's place in the staged keys, so that repeated rows are split as well. Exact sums of the ranges
then place every row on the line of all bytes, and the shard is the row's fortieth (of 40) of that line. The rows
that move are (doc_id, size, hashes), never texts.
"""

from __future__ import annotations

from bisect import bisect_left
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docspark.llm.common import stage

ROW_BYTES = 16
#: Ranges per shard at least, rows of a range or part of one, ranges at most (beyond that, ranges have more parts), and
#: keys drawn per range. The driver gets the drawn keys and a sum per range and part, a row for ROWS_A_PART of the input.
RANGES_A_SHARD, ROWS_A_PART, MOST_RANGES, SAMPLES_A_RANGE = 32, 1 << 20, 1 << 16, 16


def keyed(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes and ROW_BYTES a row; null: no bytes), text_crc32 (null: of no bytes), key, spread."""
    t = F.col(text)
    raw = F.coalesce(t, F.lit("")).cast("binary")
    return docs.select("doc_id", (F.coalesce(F.octet_length(t), F.lit(0)) + ROW_BYTES).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.xxhash64(t).alias("key"), F.xxhash64("doc_id", F.monotonically_increasing_id()).alias("spread"))


def boundaries(sample: list[tuple[int, float]], ranges: int) -> list[int]:
    """Weighted quantiles of the sampled keys, strictly increasing; a key that fills several ranges gets its own."""
    sample = sorted(sample)
    ends = list(accumulate(w for _, w in sample))
    if not ends:
        return []
    cuts = [sample[min(bisect_left(ends, ends[-1] * i / ranges), len(sample) - 1)][0] for i in range(1, ranges)]
    hot = {a for a, b in zip(cuts, cuts[1:], strict=False) if a == b and a < (1 << 63) - 1}
    return sorted({*cuts, *(x + 1 for x in hot)})


def place(key: Column, cuts: list[int]) -> Column:
    """Number of boundaries at or below the key: binary search in a constant array."""
    n = len(cuts)
    if not n:
        return F.lit(0)
    held = F.from_json(F.lit(str(cuts)), "array<bigint>")
    steps = F.sequence(F.lit(n.bit_length() - 1), F.lit(0), F.lit(-1)) if n > 1 else F.array(F.lit(0))

    def halve(at: Column, k: Column) -> Column:
        step = F.call_function("shiftleft", F.lit(1), k)
        return at + F.when(F.coalesce(F.get(held, at + step - 1) <= key, F.lit(False)), step).otherwise(F.lit(0))

    return F.aggregate(steps, F.lit(0), halve)


def shard(docs: DataFrame, shards: int = 40, text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row; shards of near equal bytes, slots gapless from 0.

    A shard's bytes differ from the mean by at most one row's. Rows with equal keys, repeated rows included, are
    split between shards only where a boundary falls; which of several equal rows gets which slot depends on the layout
    of the files, all else does not. Null texts have a key of their own; an empty table gives no
    row; further columns are not read.
    """
    spark = docs.sparkSession
    rows = stage(keyed(docs, text), "shard-keys")
    n, total = rows.agg(F.count("*"), F.sum("size")).first()
    ranges = min(max(shards * RANGES_A_SHARD, -(-n // ROWS_A_PART)), max(shards * RANGES_A_SHARD, MOST_RANGES))
    share = ranges * SAMPLES_A_RANGE / (total or 1)
    weight = F.greatest(F.lit(1.0), F.col("size") * share)  # rows larger than a sampling step are always drawn
    draw = F.shiftrightunsigned(F.xxhash64("key", "doc_id", F.lit(7)), 11) / F.lit(float(1 << 53))
    drawn = rows.filter(draw < F.col("size") * share).groupBy("key").agg(F.sum(weight).alias("weight"))
    cuts = boundaries(list(map(tuple, drawn.collect())), ranges)
    ranged = rows.withColumn("range", place(F.col("key"), cuts))
    sums = {r: (a, b) for r, a, b in ranged.groupBy("range").agg(F.count("*"), F.sum("size")).collect()}
    most = max(1, min(ROWS_A_PART, 2 * n // ranges))
    parts = [max(1, -(-sums.get(r, (0, 0))[0] // most), -(-sums.get(r, (0, 0))[1] * ranges // (2 * (total or 1)))) for r in range(len(cuts) + 1)]
    fine = ranged.withColumn("part", F.pmod(F.col("spread"), F.get(F.from_json(F.lit(str(parts)), "array<bigint>"), "range")))
    tiles, at_rows, at_bytes = [], 0, 0
    for r, p, a, b in sorted(map(tuple, fine.groupBy("range", "part").agg(F.count("*"), F.sum("size")).collect())):
        tiles.append((r, p, at_rows, at_bytes))
        at_rows, at_bytes = at_rows + a, at_bytes + b
    base = spark.createDataFrame(tiles, "range int, part long, base_rows long, base_bytes long")  # 3 * ranges rows at most, and one for ROWS_A_PART of the input
    own = Window.partitionBy("range", "part").orderBy("key", "doc_id", "size", "text_crc32")
    middle = 2 * (F.col("base_bytes") + F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, 0))) - F.col("size")
    ranked = fine.join(F.broadcast(base), ["range", "part"]).select("doc_id", "size", "text_crc32", F.least(F.lit(shards - 1), F.floor(middle.cast("decimal(38,0)") * shards / (2 * (total or 1))).cast("int")).alias("shard"), (F.col("base_rows") + F.row_number().over(own) - 1).alias("rank"))
    ranked = stage(ranked, "shard-ranks")
    starts = spark.createDataFrame(list(map(tuple, ranked.groupBy("shard").agg(F.min("rank")).collect())), "shard int, start long")  # a row a shard
    return ranked.join(F.broadcast(starts), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("rank") - F.col("start")).alias("slot"))
