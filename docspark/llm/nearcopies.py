"""SimHash near-dedup at a given Jaccard similarity: anchors for candidates, exact similarity for the verdict.

Three bits of 64 (``simhash``) find only copies that are all but equal: at a Jaccard similarity of 0.8, about 15 % of
the bits differ, and anchors within covering radius plus such a threshold would be a large share of all anchors. So
this search takes the trivial covering code of radius 0 on many projections of a longer fingerprint: a projection is
``bits`` of the WIDE bits, its anchors are all words of that length, and every fingerprint goes to its own anchor in
each of ``tables`` projections. Their numbers follow from the number of texts and from RECALL. Per anchor, fingerprints
within a threshold are joined to a spanning forest of least distances, and each of its links is then verified by the
exact Jaccard similarity of the word shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, log, log2, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import Folder, apart, join_groups, stage
from docspark.llm.components import components, forest
from docspark.llm.prefixes import completed

#: Bits of the fingerprint, bits that are compared at an anchor, texts an anchor should get, and the share of pairs
#: at exactly the given similarity that should meet.
WIDE, COMPARED, LOAD, RECALL = 256, 128, 512, 0.98
#: An anchor with more texts is dealt into blocks; 1 of SHARE texts is counted to find such anchors.
BLOCK, SHARE = 8192, 64
#: Nearest texts linked beside the spanning forest, and rows compared with all others of an anchor at a time.
NEAREST, TILE = 3, 128
SEED = 42


def shingle_set(text: bytes | None, shingle: int) -> np.ndarray:
    """XXH64 of the distinct word shingles, sorted; fewer words: the whole sequence; none: empty."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    grams = {b" ".join(x) for x in zip(*(words[i:] for i in range(shingle)), strict=False)} or {b" ".join(words)}
    hashes = np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64, len(grams))
    hashes.sort()
    return hashes


def wide_fingerprint(hashes: np.ndarray) -> bytes:
    """WIDE bits: each set if it is set in over half of the mixed hashes."""
    ones = np.zeros(WIDE, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)]
        mixed = np.empty((len(part), WIDE // 64), np.uint64)
        for k in range(WIDE // 64):  # the finalizer of SplitMix64
            x = part + np.uint64(0x9E3779B97F4A7C15 * k % (1 << 64))
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            mixed[:, k] = x ^ (x >> np.uint64(31))
        ones += np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").tobytes()


def signed(docs: DataFrame, doc_id: str, text: str, shingle: int) -> DataFrame:
    """row, doc_id, hash (of the text), shingles (sorted 32-bit hashes), print (the fingerprint), same (digest of all shingles)."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("hash"), F.col(text).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [shingle_set(x, shingle) for x in part.column(2).to_pylist()]
                small = [np.unique((x >> np.uint64(32)).astype(np.uint32)).view(np.int32) for x in sets]
                ends = np.cumsum([0, *map(len, small)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int32), *small])))
                prints = pa.array([wide_fingerprint(x) for x in sets], pa.binary())
                same = pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists, prints, same], ["doc_id", "hash", "shingles", "print", "same"])

    made = rows.mapInArrow(run, f"doc_id {rows.schema[0].dataType.simpleString()}, hash long, shingles array<int>, print binary, same binary")
    return made.withColumn("row", F.monotonically_increasing_id())


def plan(texts: int, similarity: float) -> tuple[int, int, int]:
    """(bits of an anchor, projections, threshold in COMPARED bits) for so many texts at this similarity."""
    differ = acos(2 * similarity / (1 + similarity)) / pi  # the share of bits in which such a pair differs
    bits = min(40, max(1, round(log2(max(2, texts) / LOAD))))
    tables = max(1, ceil(log(1 - RECALL) / log(1 - (1 - differ) ** bits)))
    return bits, tables, ceil(COMPARED * differ + 3 * sqrt(COMPARED * differ * (1 - differ)))


def anchored(nodes: DataFrame, bits: int, tables: int) -> DataFrame:
    """anchor (projection and word), node, print (its first COMPARED bits): every node of ``nodes`` at its anchors."""
    rnd = np.random.default_rng(7)
    places = [rnd.choice(WIDE, bits, replace=False) for _ in range(tables)]
    powers = np.left_shift(1, np.arange(bits), dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                raw = part.column(1).to_pylist()
                each = np.unpackbits(np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1), axis=1, bitorder="little")
                short = pa.array([x[: COMPARED // 8] for x in raw], pa.binary())
                for n, place in enumerate(places):
                    word = each[:, place].astype(np.int64) @ powers
                    yield pa.RecordBatch.from_arrays([pa.array(word | (n << 44)), part.column(0), short], ["anchor", "node", "print"])

    return nodes.select("node", "print").mapInArrow(run, "anchor long, node long, print binary")


def salted(rows: DataFrame, sample: DataFrame, folder: Folder) -> DataFrame:
    """``rows`` with the anchors of over BLOCK texts, as the sample tells, dealt into blocks.

    A block's texts are compared with each other and with the anchor's pilots, about BLOCK texts that go to all of its
    blocks. So no task gets more than some blocks, and the work grows with the rows, not with their square.
    """
    hot = folder.stage(sample.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK // SHARE).withColumn("g", F.ceil(F.col("n") * SHARE / BLOCK).cast("int")), "near-hot")
    if hot.isEmpty():
        return rows
    own, pilot = F.pmod(F.xxhash64("node", F.lit(1)), F.col("g")), F.pmod(F.xxhash64("node", F.lit(2)), F.col("g")) == 0
    blocks = F.when(F.col("g").isNull(), F.array(F.lit(0).cast("long"))).when(pilot, F.sequence(F.lit(0).cast("long"), F.col("g").cast("long") - 1)).otherwise(F.array(own))
    joined = rows.join(hot.select("anchor", "g"), "anchor", "left")
    return joined.withColumn("block", F.explode(blocks)).select(F.when(F.col("g").isNull(), F.col("anchor")).otherwise(F.xxhash64("anchor", "block")).alias("anchor"), "node", "print")


def spanning(prints: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of a spanning forest of least distances among rows within ``threshold`` bits, in Boruvka rounds, and of
    each row's NEAREST rows: distances only estimate the similarity, so a link that fails has others beside it."""
    n = len(prints)
    label, more = np.arange(n), [np.empty((0, 2), np.int64)]
    live = np.arange(n)
    while len(live) > 1:
        own, best, other = label[live], np.full(len(live), threshold + 1, np.int64), np.zeros(len(live), np.int64)
        for at in range(0, len(live), TILE):
            rows = live[at : at + TILE]
            bits = np.bitwise_count(prints[rows, None, 0] ^ prints[None, live, 0])
            for k in range(1, prints.shape[1]):
                bits = bits + np.bitwise_count(prints[rows, None, k] ^ prints[None, live, k])
            bits[own[at : at + TILE, None] == own[None, :]] = 255
            to = bits.argmin(axis=1)
            if n == len(live) and n > NEAREST:
                close = np.flatnonzero(bits[np.arange(len(rows)), to] <= threshold)
                kth = np.argpartition(bits[close], NEAREST, axis=1)[:, :NEAREST]
                i, k = np.nonzero(np.take_along_axis(bits[close], kth, axis=1) <= threshold)
                more.append(np.sort(np.stack([rows[close[i]], live[kth[i, k]]], axis=1), axis=1))
            best[at : at + TILE], other[at : at + TILE] = bits[np.arange(len(rows)), to], live[to]
        near = best <= threshold
        if not near.any():
            break
        if (own == live).all():  # first round: what has no neighbour at all is done with
            live, own, best, other, near = live[near], own[near], best[near], other[near], near[near]
        order = np.lexsort((live, best, own))
        first = order[np.unique(own[order], return_index=True)[1]]
        first = first[near[first]]
        more.append(np.sort(np.stack([live[first], other[first]], axis=1), axis=1))
        child, root = forest(label[live[first]], label[other[first]])
        moved = dict(zip(child.tolist(), root.tolist(), strict=True))
        label = np.array([moved.get(x, x) for x in label.tolist()], np.int64)
    return tuple(np.unique(np.concatenate(more), axis=0).T)


def candidates(rows: DataFrame, threshold: int) -> DataFrame:
    """u, v: links of each anchor. Rows are sorted by anchor and streamed; a worker holds a batch and one anchor's rows."""
    dealt = rows.repartition("anchor").sortWithinPartitions("anchor", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, node, prints = np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, COMPARED // 64), np.uint64)

        def linked(key: np.ndarray, node: np.ndarray, prints: np.ndarray) -> Iterator[pa.RecordBatch]:
            starts = np.flatnonzero(np.diff(key, prepend=key[0] - 1))
            u, v = [], []
            for a, b in zip(starts, [*starts[1:], len(key)], strict=True):
                if b - a > 1:
                    i, j = spanning(prints[a:b], threshold)
                    u.append(np.maximum(node[a + i], node[a + j]))
                    v.append(np.minimum(node[a + i], node[a + j]))
            if u and sum(map(len, u)):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], ["u", "v"])

        for batch in batches:
            new = [batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)]
            wide = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint64).reshape(-1, COMPARED // 64)
            key, node, prints = np.concatenate([key, new[0]]), np.concatenate([node, new[1]]), np.concatenate([prints, wide])
            if len(key) and key[0] != key[-1]:
                cut = np.searchsorted(key, key[-1])
                yield from linked(key[:cut], node[:cut], prints[:cut])
                key, node, prints = key[cut:], node[cut:], prints[cut:]
        if len(key):
            yield from linked(key, node, prints)

    return dealt.mapInArrow(run, "u long, v long").distinct()


def verified(edges: DataFrame, rows: DataFrame, similarity: float, folder: Folder) -> DataFrame:
    """The ``edges`` whose ends' shingles have at least this Jaccard similarity."""
    ends = edges.select(F.explode(F.array("u", "v")).alias("row")).groupBy("row").agg(F.count("*").alias("links"))
    sets = folder.stage(rows.select("row", "shingles").join(ends, "row"), "near-sets")
    half = join_groups(edges, sets.select(F.col("row").alias("u"), "links", F.col("shingles").alias("a")), "u", "links").select("u", "v", "a")
    both = join_groups(half, sets.select(F.col("row").alias("v"), "links", F.col("shingles").alias("b")), "v", "links")
    shared = F.size(F.array_intersect("a", "b"))
    return both.filter(shared >= F.lit(similarity) * (F.size("a") + F.size("b") - shared)).select("u", "v")


def classes(rows: DataFrame, similarity: float, folder: Folder) -> DataFrame:
    """doc_id, hash of the row that stays of each class: of the least non-null doc_id, then of the least row.

    ``rows``: what ``signed`` gives. Rows with equal shingles are one node, whatever their number.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "hash"))
    nodes = folder.stage(rows.groupBy("same").agg(first.alias("least"), F.first("print").alias("print")).select(F.col("least.row").alias("node"), "least", "print"), "nodes")
    bits, tables, threshold = plan(nodes.count(), similarity)
    sample = anchored(nodes.filter(F.pmod(F.xxhash64("node"), F.lit(SHARE)) == 0), bits, tables).drop("print")
    edges = folder.stage(candidates(salted(anchored(nodes, bits, tables), sample, folder), threshold), "candidates")
    near = folder.stage(components(verified(edges, rows, similarity, folder), folder=folder), "roots")
    roots = completed(rows.select("row", "shingles"), nodes, near, similarity, lambda found: verified(found, rows, similarity, folder), folder)
    members = roots.join(nodes.select("node", "least"), "node")
    winners = members.groupBy("root").agg(F.min("least").alias("least")).select("least.doc_id", "least.hash")
    return nodes.join(roots, "node", "left_anti").select("least.doc_id", "least.hash").unionByName(winners)


def keep_one(docs: DataFrame, similarity: float = 0.8, text: str = "text", shingle: int = 5) -> DataFrame:
    """One row of ``docs`` of each class of near copies, all columns: the one of the smallest doc_id.

    A class is what links of at least ``similarity`` (Jaccard, distinct word shingles, A-Z lower-cased) connect. Texts
    without words are equal to each other, null and empty ones too. Rows without doc_id go where one with doc_id is in
    their class, else one of them stays; so does one of repeated rows. An empty table gives none. Texts are read twice
    and moved once at most; all tables but that of the rows that stay are deleted before this returns.
    """
    plain, names = apart(docs)
    doc_id, own = names["doc_id"], names[text]
    folder = Folder(docs.sparkSession, "near")
    rows = folder.stage(signed(plain, doc_id, own, shingle), "rows")
    stays = stage(classes(rows, similarity, folder), "near-stays").toDF("_doc", "_hash")
    twice = stage(rows.groupBy("doc_id", "hash").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias("_doc"), F.col("hash").alias("_hash")), "near-twice")
    folder.remove()
    hashed = plain.withColumn("_hash_of", F.xxhash64(own))
    same = F.col(doc_id).eqNullSafe(F.col("_doc")) & (F.col("_hash_of") == F.col("_hash"))
    found = hashed.join(stays, same, "left_semi")
    if not twice.isEmpty():
        found = found.join(twice, same, "left_anti").unionByName(found.join(twice, same, "left_semi").dropDuplicates([doc_id, "_hash_of"]))
    return found.select(*names.values()).toDF(*docs.columns)
