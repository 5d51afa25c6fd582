"""Exact set-similarity join by prefix filtering, for the links that a search by anchors has not found.

Two sets of at least similarity s share k shingles or more among the first n - ceil(s n) + k of each, in any order of
all shingles that is the same for both; k grows with the set, and the lesser one counts. So every set goes to the
buckets of its prefix, and every pair that meets in k buckets and is not connected yet is verified, unless sizes and
places rule it out. Nothing is sampled or cut: counts of a sample only make the order (frequent shingles last), and
large buckets are compared block by block, every block with every other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import Folder
from docspark.llm.components import components

#: 1 of SAMPLE sets is counted for the order; that many frequent shingles at most go to the end of it.
SAMPLE, FREQUENT = 16, 1 << 18
#: A bucket with more sets is dealt into blocks; 1 of SHARE sets is counted to find such buckets.
BLOCK, SHARE = 8192, 64
#: Pairs that a worker looks at in one step.
STEP = 1 << 18
#: Similar sets meet in one bucket, and in one more for each so many shingles of the smaller set.
EVERY = 32


def one_of(n: int, column: str) -> F.Column:
    return F.pmod(F.xxhash64(column, F.lit(3)), F.lit(n)) == 0


def frequent(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, sorted; their counts in a sample) of those that the sample has twice or more, the most frequent ones."""
    counts = sets.filter(one_of(SAMPLE, "row")).select(F.explode("shingles").alias("x")).groupBy("x").agg(F.count("*").alias("n"))
    found = counts.filter("n > 1").orderBy(F.desc("n"), "x").limit(FREQUENT).toArrow()
    x, n = (c.to_numpy() for c in found.columns)
    order = np.argsort(x)
    return x[order], n[order]


def postings(sets: DataFrame, similarity: float, often: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """bucket, node, root, size, place: every set of ``sets`` (node, root, shingles) in the buckets of its prefix."""
    known, counts = often

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                size = np.array(part.column(2).value_lengths(), np.int64)
                x, of = part.column(2).flatten().to_numpy(), np.repeat(np.arange(len(size)), size)
                rank = np.zeros(len(x), np.int64)
                if len(known):
                    i = np.minimum(np.searchsorted(known, x), len(known) - 1)
                    rank = np.where(known[i] == x, counts[i], 0)
                x = x[np.lexsort((x, rank, of))]
                place = np.arange(len(x)) - np.repeat(np.cumsum(size) - size, size)
                kept = np.flatnonzero(place < (size - np.ceil(similarity * size - 1e-9).astype(np.int64) + 1 + size // EVERY)[of])
                to = pa.array(of[kept])
                yield pa.RecordBatch.from_arrays([pa.array(x[kept].astype(np.int64)), part.column(0).take(to), part.column(1).take(to), pa.array(size[of[kept]].astype(np.int32)), pa.array(place[kept].astype(np.int32))], ["bucket", "node", "root", "size", "place"])

    return sets.select("node", "root", "shingles").mapInArrow(run, "bucket long, node long, root long, size int, place int")


def crossed(rows: DataFrame, sample: DataFrame, folder: Folder) -> DataFrame:
    """``rows`` and ``side``; buckets of over BLOCK sets, as the sample tells, become one bucket for each two blocks.

    There, rows of side 1 are compared with those of side 2; rows of side 0 with all of their bucket.
    """
    hot = folder.stage(sample.groupBy("bucket").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK // SHARE).select("bucket", F.ceil(F.col("n") * SHARE / BLOCK).cast("int").alias("g")), "prefix-hot")
    if hot.isEmpty():
        return rows.withColumn("side", F.lit(0))
    own = F.pmod(F.xxhash64("node", F.lit(1)), F.col("g")).cast("int")
    dealt = rows.join(hot, "bucket", "left").withColumn("own", own)
    each = dealt.withColumn("other", F.explode(F.when(F.col("g").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("g") - 1))))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    side = F.when(F.col("g").isNull() | (F.col("own") == F.col("other")), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    bucket = F.when(F.col("g").isNull(), F.col("bucket")).otherwise(F.xxhash64("bucket", low, high))
    return each.select(bucket.alias("bucket"), "node", "root", "size", "place", side.alias("side"))


def pairs(bucket: np.ndarray, node: np.ndarray, root: np.ndarray, size: np.ndarray, place: np.ndarray, side: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, ...]]:
    """(u, v, root of u, root of v, need, spare) of all rows of a bucket with different roots and similar sizes; u is greater than v.

    need: in how many buckets they have to meet; spare: shingles from here on beyond those they must share, not
    negative in the first bucket of a similar pair.

    Rows of a bucket's largest root come last and are not compared with each other, so a bucket of one class costs
    nothing.
    """
    order = np.lexsort((root, bucket))
    bucket, node, root, size, place, side = (x[order] for x in (bucket, node, root, size, place, side))
    starts = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (root[1:] != root[:-1])])
    runs = np.diff(np.r_[starts, len(bucket)])
    by = np.lexsort((runs, bucket[starts]))
    last = by[np.r_[bucket[starts][by][1:] != bucket[starts][by][:-1], True]]
    major = np.zeros(len(starts), bool)
    major[last] = True
    major = np.repeat(major, runs)
    order = np.lexsort((major, bucket))
    bucket, node, root, size, place, side, major = (x[order] for x in (bucket, node, root, size, place, side, major))
    after = np.where(major, 0, np.searchsorted(bucket, bucket, "right") - np.arange(len(bucket)) - 1)
    ends = np.cumsum(after)
    at = 0
    while at < len(after):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STEP, "right")))
        n = after[at:to]
        i = np.repeat(np.arange(at, to), n)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        at = to
        a, b = size[i], size[j]
        least = np.ceil(similarity / (1 + similarity) * (a + b) - 1e-9)
        ok = (root[i] != root[j]) & ((side[i] == 0) | (side[i] != side[j])) & (np.minimum(a, b) >= similarity * np.maximum(a, b) - 1e-9)
        need, spare = 1 + np.minimum(a, b)[ok] // EVERY, (np.minimum(a - place[i], b - place[j]) - least)[ok]
        i, j = i[ok], j[ok]
        swap = node[i] < node[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        yield node[i], node[j], root[i], root[j], need.astype(np.int32), spare.astype(np.int32)


def unlinked(rows: DataFrame, similarity: float) -> DataFrame:
    """u, v, ru, rv, n: pairs of ``rows`` (buckets) with different roots that met often enough, and in how many buckets."""
    dealt = rows.repartition("bucket").sortWithinPartitions("bucket")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # batches that end in one and the same bucket

        def made(parts: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
            columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
            for found in pairs(*columns, similarity) if len(columns[0]) else ():
                if len(found[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["u", "v", "ru", "rv", "need", "spare"])

        for batch in batches:
            new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if len(new[0]) == 0:
                continue
            cut = int(np.searchsorted(new[0], new[0][-1]))
            if cut or (held and held[-1][0][-1] != new[0][-1]):
                yield from made([*held, [x[:cut] for x in new]])
                held = []
            held.append([x[cut:] for x in new])
        if held:
            yield from made(held)

    met = dealt.mapInArrow(run, "u long, v long, ru long, rv long, need int, spare int").groupBy("u", "v", "ru", "rv")
    return met.agg(F.count("*").alias("n"), F.max("need").alias("need"), F.max("spare").alias("spare")).filter("n >= need AND spare >= 0").drop("need", "spare")


def relabelled(found: DataFrame, roots: DataFrame) -> DataFrame:
    """``found`` with the roots of ``roots``, without the pairs that they connect."""
    for end in "uv":
        named = roots.select(F.col("node").alias(end), F.col("root").alias("now"))
        found = found.join(named, end, "left").withColumn(f"r{end}", F.coalesce("now", F.col(f"r{end}"))).drop("now")
    return found.filter("ru != rv")


def completed(rows: DataFrame, nodes: DataFrame, roots: DataFrame, similarity: float, verify: Callable[[DataFrame], DataFrame], folder: Folder) -> DataFrame:
    """node, root: the components ``roots`` of ``nodes`` joined by every further link of at least ``similarity``.

    ``rows``: row and shingles (distinct, hashed) of all nodes and maybe others; ``verify`` keeps the pairs u, v that
    are similar. Of two components, the pair that met most often is verified first, and all others only if that did
    not connect them.
    """
    copies = rows.select("row").join(nodes.select(F.col("node").alias("row")), "row", "left_anti")
    moved = roots.filter("node != root").select(F.col("node").alias("row"), "root")
    odd = folder.stage(moved.unionByName(copies.withColumn("root", F.lit(None).cast("long"))).withColumn("odd", F.lit(True)), "prefix-odd")
    often = frequent(rows)

    def sets(some: DataFrame) -> DataFrame:
        named = some.join(odd, "row", "left").filter("odd IS NULL OR root IS NOT NULL")
        return postings(named.select(F.col("row").alias("node"), F.coalesce("root", "row").alias("root"), "shingles"), similarity, often)

    dealt = crossed(sets(rows), sets(rows.filter(one_of(SHARE, "row"))), folder)
    found = folder.stage(unlinked(dealt, similarity), "prefix-pairs")
    best = found.groupBy(F.least("ru", "rv"), F.greatest("ru", "rv")).agg(F.max(F.struct("n", "u", "v")).alias("best"))
    first = folder.stage(best.select("best.u", "best.v"), "prefix-first")
    rest = found.join(first, ["u", "v"], "left_anti")
    for tried in (lambda: first, lambda: folder.stage(relabelled(rest, roots).select("u", "v"), "prefix-rest")):
        if (edges := tried()).isEmpty():
            break
        links = folder.stage(verify(edges), "prefix-links")
        if not links.isEmpty():
            stars = roots.select(F.col("node").alias("u"), F.col("root").alias("v"))
            roots = folder.stage(components(stars.unionByName(links), folder=folder), "prefix-roots")
    return roots
