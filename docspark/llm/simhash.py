"""SimHash near-duplicates by anchor-point covering.

Fingerprints that differ in 3 bits or fewer differ in at most one bit of one of their 32-bit halves. Anchors of a
half are the words of a covering code: the perfect [31, 26] Hamming code on 31 bits, times the last bit as it is.
Its covering radius is 1, so each half has a home anchor within 1, and the other fingerprint's half lies within
radius + threshold = 2 of it. Every fingerprint goes to all anchors within 2 (16.5 a half on average), and per
anchor those at home are compared with all that came; an anchor with over HOT rows is first subdivided by the bytes
of the other half, four of which cannot all differ. An anchor's links are reduced to a spanning forest where
they are found, so that a group of n near copies yields at most n - 1 links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import join_groups, stage
from docspark.llm.components import components, forest

BITS, THRESHOLD, SEED = 64, 3, 42
#: An anchor with more rows is subdivided; a part of one with more rows is compared block by block; from DENSE rows on,
#: rows of one cluster are not compared with each other.
HOT, PART, DENSE = 8192, 1 << 20, 2048
POSITIONS = np.arange(1, 32, dtype=np.uint32)
ONE = [np.uint32(0), *(np.uint32(1 << (p - 1)) for p in range(1, 32))]
#: By syndrome: what to flip to reach each code word within 2 (within 1 first: the home anchor).
FLIPS = [np.array([0], np.uint32)] + [np.array([ONE[s], *(ONE[i] | ONE[i ^ s] for i in range(1, 32) if i < (i ^ s))], np.uint32) for s in range(1, 32)]
CHECKS = [np.uint32(sum(1 << (p - 1) for p in range(1, 32) if p >> k & 1)) for k in range(5)]
LOW31, LAST = np.uint32(0x7FFFFFFF), np.uint32(0x80000000)


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """SimHash of word shingles, repeats included: a bit is set if over half of the XXH64 values have it."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    grams = [b" ".join(x) for x in zip(*(words[i:] for i in range(shingle)), strict=False)] or [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(g, SEED) for g in grams), np.uint64, len(grams))
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", shingle: int = 3) -> DataFrame:
    """``keep`` columns and ``fp`` (the 64 bits as a signed long) of every whole text; null and wordless texts: 0."""
    rows = docs.select(*keep, F.col(text).cast("binary").alias(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                fp = np.array([fingerprint(x, shingle) for x in part.column(len(keep)).to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(fp)], [*keep, "fp"])

    return rows.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keep), "fp long"]))


def covering(half: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, bool]]:
    """(row, anchor, home) for all anchors within 2 of each half: the home anchor, those beside it, those across the last bit."""
    low, last = half & LOW31, half & LAST
    syndrome = sum((np.bitwise_count(low & c).astype(np.int64) & 1) << k for k, c in enumerate(CHECKS))
    rows, found = np.arange(len(half)), []
    for s in range(32):
        own = rows[syndrome == s]
        if len(own):
            for n, flip in enumerate(FLIPS[s]):
                found.append((own, (low[own] ^ flip) | last[own], n == 0))
                if n == 0:
                    found.append((own, (low[own] ^ flip) | (last[own] ^ LAST), False))
    return found


def anchored(groups: DataFrame) -> DataFrame:
    """anchor (half << 32 | code word), home, fp: ``groups`` (one row per fp) sent to every anchor within 2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(whole), 8192):
                fp = whole[at : at + 8192]
                for k in (0, 1):
                    half = (fp.view(np.uint64) >> np.uint64(32 * k)).astype(np.uint32)
                    for rows, anchor, home in covering(half):
                        key = anchor.astype(np.int64) | (k << 32)
                        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.full(len(key), home)), pa.array(fp[rows])], ["anchor", "home", "fp"])

    return groups.select("fp").mapInArrow(run, "anchor long, home boolean, fp long")


def near(fp: np.ndarray, rows: np.ndarray, label: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links of ``rows`` within THRESHOLD bits to rows of another label, as a spanning forest; labels are joined on the way."""
    for i in rows:
        found = np.flatnonzero((np.bitwise_count(fp ^ fp[i]) <= THRESHOLD) & (label != label[i]))
        for j in found:
            if label[j] != label[i]:
                yield fp[i], fp[j]
                label[label == label[j]] = label[i]


def sorted_links(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between neighbours in sorted order, under eight rotations of the bits: most of a dense cluster, cheaply."""
    found = []
    for turn in range(0, BITS, 8):
        order = np.argsort((fp << np.uint64(turn)) | (fp >> np.uint64((BITS - turn) % BITS)) if turn else fp, kind="stable")
        for step in (1, 2, 3):
            a, b = order[:-step], order[step:]
            close = np.bitwise_count(fp[a] ^ fp[b]) <= THRESHOLD
            found.append((a[close], b[close]))
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def links_of(fp: np.ndarray, home: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links between an anchor's home fingerprints and all of its own, enough to connect what they connect.

    Of many rows, neighbours in sorted order are linked first. Rows of the largest cluster that this gives need no
    comparison with each other, so only the rows outside it are compared with all.
    """
    label = np.arange(len(fp))
    if len(fp) <= DENSE:
        yield from near(fp, np.flatnonzero(home), label)
        return
    a, b = sorted_links(fp)
    child, root = forest(a, b)
    label[child] = root
    yield from zip(fp[child], fp[root], strict=True)
    ids, sizes = np.unique(label, return_counts=True)
    yield from near(fp, np.flatnonzero(label != ids[np.argmax(sizes)]), label)


def compare(rows: DataFrame, hot: int) -> DataFrame:
    """u, v, anchor: the links of each anchor's rows (anchor null), or the rows of an anchor with over ``hot`` of them
    as they came (u: the fingerprint, v: 1 at home). Rows are sorted by anchor and streamed; a worker holds a batch
    and one anchor of ``hot`` rows at most.
    """
    dealt = rows.repartition("anchor").sortWithinPartitions("anchor")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, home, fp = np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64)
        over: int | None = None  # the anchor whose rows are passed on

        def made(u: np.ndarray, v: np.ndarray, anchor: np.ndarray | None) -> pa.RecordBatch:
            at = pa.nulls(len(u), pa.int64()) if anchor is None else pa.array(anchor)
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), at], ["u", "v", "anchor"])

        def linked(key: np.ndarray, home: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            starts = np.flatnonzero(np.diff(key, prepend=key[0] - 1))
            sizes = np.diff(starts, append=len(key))
            large = sizes > hot
            several = (sizes > 1) & ~large & (np.add.reduceat(home.astype(np.int64), starts) > 0)
            found = [e for a, n in zip(starts[several], sizes[several], strict=True) for e in links_of(fp[a : a + n].view(np.uint64), home[a : a + n])]
            out = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            if len(out):
                yield made(*forest(out[:, 0], out[:, 1]), None)
            for a, n in zip(starts[large], sizes[large], strict=True):
                yield made(fp[a : a + n], home[a : a + n].astype(np.int64), key[a : a + n])

        for batch in batches:
            new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if over is not None:
                n = int(np.searchsorted(new[0], over, "right"))
                yield made(new[2][:n], new[1][:n].astype(np.int64), new[0][:n])
                new = [c[n:] for c in new]
                over = None if len(new[0]) else over
            key, home, fp = (np.concatenate([a, c]) for a, c in zip((key, home, fp), new, strict=True))
            if len(key) and key[0] != key[-1]:
                cut = np.searchsorted(key, key[-1])  # the last anchor may go on in the next batch
                yield from linked(key[:cut], home[:cut], fp[:cut])
                key, home, fp = key[cut:], home[cut:], fp[cut:]
            if len(key) > hot:
                over = int(key[0])
                yield made(fp, home.astype(np.int64), key)
                key, home, fp = key[:0], home[:0], fp[:0]
        if len(key):
            yield from linked(key, home, fp)

    return dealt.mapInArrow(run, "u long, v long, anchor long")


def passed_on(found: DataFrame) -> DataFrame:
    """anchor, home, fp of the rows that an anchor had too many of."""
    return found.filter("anchor IS NOT NULL").select("anchor", (F.col("v") == 1).alias("home"), F.col("u").alias("fp"))


def subdivided(rows: DataFrame) -> DataFrame:
    """``rows`` four times: once for each byte of the half that the anchor is not of.

    Fingerprints within THRESHOLD = 3 bits agree in one of those four bytes, so a hot anchor falls into 4 * 256 parts
    without losing a link.
    """
    whole = F.col("anchor")
    other = F.when(F.shiftright(whole, 32) == 0, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))
    slots = F.array(*(F.lit(n << 8).bitwiseOR(F.shiftrightunsigned(other, 8 * n).bitwiseAND(F.lit(255))) for n in range(4)))
    return rows.withColumn("slot", F.explode(slots)).select((F.shiftleft(F.col("slot").cast("long"), 33).bitwiseOR(whole)).alias("anchor"), "home", "fp")


def paired(rows: DataFrame, part: int) -> DataFrame:
    """``rows`` of parts with over ``part`` rows, dealt into blocks of a part: every pair of a part's blocks is a key.

    Near copies share their bytes, so a part may stay large. Each pair of its rows meets under some pair of blocks,
    with at most ``part`` rows or so, and links are sought among all rows of a key.
    """
    counts = rows.groupBy("anchor").agg(F.count("*").alias("rows"))
    blocks = counts.select("anchor", (F.floor(2 * F.col("rows") / part) + 1).cast("int").alias("g"))
    block = F.pmod(F.xxhash64("fp", F.lit(5)), F.col("g"))
    keys = F.transform(F.sequence(F.lit(0), F.col("g") - 1), lambda x: F.xxhash64("anchor", F.least(x.cast("long"), block), F.greatest(x.cast("long"), block)))
    return join_groups(rows, counts.join(blocks, "anchor"), "anchor", "rows").select(F.explode(keys).alias("anchor"), F.lit(True).alias("home"), "fp")


def links(groups: DataFrame, hot: int = HOT, part: int = PART) -> DataFrame:
    """u, v: links between distinct fingerprints, enough of them to connect whatever is connected."""
    found = stage(compare(anchored(groups), hot), "simhash-links")
    edges, rest = found.filter("anchor IS NULL").select("u", "v"), passed_on(found)
    if rest.isEmpty():
        return edges
    found = stage(compare(subdivided(rest), part), "simhash-links")
    edges, rest = edges.unionByName(found.filter("anchor IS NULL").select("u", "v")), passed_on(found)
    if rest.isEmpty():
        return edges
    return edges.unionByName(compare(paired(rest, part), 1 << 62).select("u", "v"))


def near_duplicates(groups: DataFrame) -> DataFrame:
    """fp, component_id of every fingerprint of ``groups`` (fp, least: the smallest non-null doc_id that has it)."""
    roots = components(links(groups))
    members = stage(groups.join(roots.select(F.col("node").alias("fp"), "root"), "fp"), "simhash-members")
    linked = members.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("size"))
    found = join_groups(members, linked, "root", "size").select("fp", "component_id")
    return groups.join(found, "fp", "left").select("fp", "rows", F.coalesce("component_id", "least").alias("component_id"))


def assign(docs: DataFrame, text: str = "text", shingle: int = 3) -> DataFrame:
    """doc_id, fp, component_id of every row.

    ``component_id`` is the smallest non-null doc_id reachable over links of 3 bits or fewer (null if there is none).
    Equal texts share a fingerprint, whatever their number; null, empty and wordless texts share fingerprint 0.
    Repeated rows stay rows; an empty table gives none; further columns are not read.
    """
    rows = stage(fingerprints(docs, ("doc_id",), text, shingle), "simhash-rows")
    groups = stage(rows.groupBy("fp").agg(F.count("*").alias("rows"), F.min("doc_id").alias("least")), "simhash-groups")
    classes = stage(near_duplicates(groups), "simhash-classes")
    return join_groups(rows, classes, "fp", "rows").select("doc_id", "fp", "component_id")
