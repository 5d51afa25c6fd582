"""Lexical retrieval packing: a sharded BM25 inverted index gives each seed its unused neighbours, which fill its window.

Frequencies of terms, the number of documents and their mean length are those of the whole corpus. The index is
sharded by content: each document is dealt by three of its terms, drawn in proportion to their BM25 weights and alike
in all documents (exponential races, one per term), so the chance that two documents come together is the share of
weight they have in common, however large the corpus is. In the order of these terms, SHARD documents at a time, or
fewer long ones with POSTINGS terms, are indexed and searched; a lost executor costs its partitions alone, and the same
partition packs the same way again.
Documents longer than the window give up their full windows first, and the rest is found by the terms of the whole
document. What is left when a shard runs low moves on to the next shard; at the end of a partition it is cut at powers
of two, so that no sequence needs padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm import bpe
from docspark.llm.common import stage

#: Documents indexed together, and how many are carried on to the next shard as its first candidates.
SHARD, CARRY = 512, 48
#: A shard with so many distinct terms of its new documents is searched before it has SHARD documents; a worker looks at
#: no more terms, and at texts and ids of no more than MOST bytes, in one step (one document at least).
POSTINGS, MOST = 1 << 20, 1 << 22
K1, B = 1.2, 0.75
#: Bits of a term in the key by which documents are dealt.
TERM_BITS, KEYS = 21, 3


class Statistics:
    """What BM25 needs of the corpus: documents, their mean length, idf by term (0 for terms of half the documents or more)."""

    def __init__(self, n: int, tokens: int, df: np.ndarray):
        self.mean, self.df = tokens / max(1, n), df
        self.idf = np.maximum(0, np.log((n - df + 0.5) / (df + 0.5))) * (df > 0)
        self.shared = np.where(df > 1, self.idf, 0)  # a term of one document leads nowhere

    def weights(self, term: np.ndarray, tf: np.ndarray, length: np.ndarray, idf: np.ndarray) -> np.ndarray:
        return idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / self.mean))


class Bm25:
    """Inverted index over the terms of one shard: postings sorted by term, weighted once by the corpus' statistics."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray, int]], corpus: Statistics):
        self.m = m = len(rows)
        sizes = np.array([len(t) for t, _, _ in rows])
        doc = np.repeat(np.arange(m), sizes)
        term, tf = (np.concatenate([x[k] for x in rows]).astype(np.int64) for k in (0, 1))
        weight = corpus.weights(term, tf, np.array([n for _, _, n in rows])[doc], corpus.idf)
        some = weight > 0
        doc, term, weight = doc[some], term[some], weight[some]
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[order], weight[order]
        _, first, at, df = np.unique(term[order], return_index=True, return_inverse=True, return_counts=True)
        self.first, self.df = first, df
        self.terms = np.empty(len(term), np.int64)
        self.terms[order] = at
        self.at = np.searchsorted(doc, np.arange(m + 1))

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every row of the shard for all distinct terms of the seed."""
        terms = self.terms[self.at[seed] : self.at[seed + 1]]
        n = self.df[terms]
        ends = np.cumsum(n)
        hits = np.arange(ends[-1] if len(n) else 0) + np.repeat(self.first[terms] - (ends - n), n)
        return np.bincount(self.doc[hits], self.weight[hits], self.m)


class Packer:
    """Packs the documents of one partition; pieces are (doc, start, ids, doc_tokens, sequence, offset)."""

    def __init__(self, window: int, base: int, corpus: Statistics):
        self.window, self.sequence, self.corpus = window, base, corpus
        self.fresh = 0  # terms of the documents that came since the last search
        self.pool: list[list] = []  # [doc, start, ids, doc_tokens, (terms, tf, length) of the whole document]
        self.out: list[tuple] = []

    def close(self, parts: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, total in parts:
            self.out.append((doc, start, ids.astype("<u4").tobytes(), total, self.sequence, offset))
            offset += len(ids)
        self.sequence += 1

    def add(self, doc: object, ids: np.ndarray, terms: np.ndarray, tf: np.ndarray) -> None:
        full = len(ids) // self.window * self.window
        for start in range(0, full, self.window):
            self.close([(doc, start, ids[start : start + self.window], len(ids))])
        if full < len(ids):
            self.pool.append([doc, full, ids[full:], len(ids), (terms, tf, len(ids))])
            self.fresh += len(terms)
        if len(self.pool) >= SHARD or self.fresh >= POSTINGS:
            self.pack(CARRY)
            self.fresh = 0

    def pack(self, leave: int) -> None:
        """Fill windows until ``leave`` rows or less than one window are unused."""
        pool, window = self.pool, self.window
        lengths = np.array([len(x[2]) for x in pool])
        unused, left = np.ones(len(pool), bool), int(lengths.sum())
        if left < window:
            return
        index = Bm25([x[4] for x in pool], self.corpus)
        for seed in np.argsort(-lengths, kind="stable"):
            if left < window or unused.sum() <= leave:
                break
            if not unused[seed]:
                continue
            doc, start, ids, total, _ = pool[seed]
            parts, room = [(doc, start, ids, total)], window - len(ids)
            unused[seed] = False
            near = np.argsort(-index.scores(seed), kind="stable")
            near = near[unused[near]]
            while room:
                fits = lengths[near] <= room
                k = int(np.argmax(fits)) if fits.any() else 0  # the nearest that fits, else the nearest is cut
                doc, start, ids, total, _ = pool[near[k]]
                parts.append((doc, start, ids[:room], total))
                if fits[k]:
                    unused[near[k]] = False
                    room -= len(ids)
                    near = np.delete(near, k)
                else:
                    pool[near[k]][1:3] = [start + room, ids[room:]]
                    lengths[near[k]] -= room
                    room = 0
            left -= window
            self.close(parts)
        self.pool = [x for x, free in zip(pool, unused, strict=True) if free]

    def finish(self) -> None:
        """Pack all; the last tokens, fewer than a window, go into sequences whose lengths are powers of two."""
        if sum(len(x[2]) for x in self.pool) >= self.window:
            self.pack(0)
        left = sum(len(x[2]) for x in self.pool)
        while left:
            room, parts = 1 << (left.bit_length() - 1), []
            left -= room
            while room:
                doc, start, ids, total, _ = self.pool[0]
                parts.append((doc, start, ids[:room], total))
                if len(ids) > room:
                    self.pool[0][1:3] = [start + room, ids[room:]]
                    room = 0
                else:
                    room -= len(ids)
                    self.pool.pop(0)
            self.close(parts)


def portions(batch: pa.RecordBatch, column: int, rows: int, most: int) -> Iterator[pa.RecordBatch]:
    """``batch`` in parts of ``rows`` rows or fewer and ``most`` bytes or fewer in ``column``, but of one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right"))
        to = min(max(at + 1, to), at + rows, batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


def tokenized(docs: DataFrame, path: str, end_id: int, kind: str) -> DataFrame:
    """row, doc_id, ids, terms and tf of every document (ids and counts as binary), and a row with ``df`` for each task.

    ``df``: by term, in how many of the task's documents it is. Counts beyond the type are cut: they weigh the same.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, at, df = bpe.load(path, bpe.LibraryBPE), TaskContext.get().partitionId() << 33, None
        names = ["row", "doc_id", "ids", "terms", "tf", "df"]
        for batch in batches:
            for part in portions(batch, 1, 512, MOST):
                ids = [np.frombuffer(coder.encode(x or ""), "<u4") for x in part.column(1).to_pylist()]
                lengths = np.array([len(x) for x in ids])
                keys, tf = np.unique(np.concatenate([np.empty(0, np.int64), *ids]).astype(np.int64) + (np.repeat(np.arange(len(ids)), lengths) << 32), return_counts=True)
                terms, cut = (keys & 0xFFFFFFFF).astype(kind), np.searchsorted(keys >> 32, np.arange(1, len(ids)))
                tf = np.minimum(tf, np.iinfo(kind).max).astype(kind)
                df = np.zeros(max(coder.size(), end_id + 1), np.int64) if df is None else df
                df += np.bincount(terms, minlength=len(df))
                arrays = [[np.append(x, end_id).astype(kind).tobytes() for x in ids], *([x.tobytes() for x in np.split(y, cut)] for y in (terms, tf))]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(ids))), part.column(0), *(pa.array(x, pa.binary()) for x in arrays), pa.nulls(len(ids), pa.list_(pa.int64()))], names)
                at, doc_kind = at + len(ids), part.column(0).type
        if df is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, doc_kind), *(pa.nulls(1, pa.binary()) for _ in range(3)), pa.array([df.tolist()], pa.list_(pa.int64()))], names)

    return rows.mapInArrow(run, f"row long, doc_id {rows.schema[0].dataType.simpleString()}, ids binary, terms binary, tf binary, df array<long>")


def statistics(tokens: DataFrame, width: int) -> Statistics:
    """Of all documents; a row per term of the vocabulary reaches the driver."""
    n, total = tokens.filter("df IS NULL").agg(F.count("*"), F.coalesce(F.sum(F.octet_length("ids")), F.lit(0))).first()
    counts = tokens.filter("df IS NOT NULL").select(F.posexplode("df").alias("term", "df")).filter("df > 0").groupBy("term").agg(F.sum("df").alias("df")).collect()
    df = np.zeros(1 + max((r.term for r in counts), default=0), np.int64)
    df[[r.term for r in counts]] = [r.df for r in counts]
    return Statistics(n, total // width, df)


def routes(terms: np.ndarray, tf: np.ndarray, length: np.ndarray, sizes: np.ndarray, corpus: Statistics, races: np.ndarray) -> np.ndarray:
    """By document, its KEYS terms drawn by weight, one behind the other in a long; without a shared term: the greatest long."""
    out = np.zeros(len(sizes), np.int64)
    weight = corpus.weights(terms, tf, np.repeat(length, sizes), corpus.shared)
    some = weight > 0
    sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[some], minlength=len(sizes))
    terms, weight = terms[some], weight[some]
    full = np.flatnonzero(sizes)
    starts = np.cumsum(sizes[full]) - sizes[full]
    for race in races if len(full) else ():
        time = race[terms] / weight
        won = np.flatnonzero(time == np.repeat(np.minimum.reduceat(time, starts), sizes[full]))
        out[full] = (out[full] << TERM_BITS) | terms[won[np.searchsorted(won, starts)]]
    out[sizes == 0] = np.iinfo(np.int64).max
    return out


def dealt(tokens: DataFrame, corpus: Statistics, kind: str) -> DataFrame:
    """The documents of ``tokens`` in order of their drawn terms, over as many partitions as Spark shuffles to.

    Equal documents are split by ``row`` where a boundary falls, so no key can fill a partition.
    """
    races = np.random.default_rng(11).exponential(size=(KEYS, len(corpus.df)))
    rows = tokens.filter("df IS NULL").drop("df")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = np.dtype(kind).itemsize
        for batch in batches:
            for part in portions(batch, 3, 1024, POSTINGS * width):
                ids, terms, tf = (part.column(k).to_pylist() for k in (2, 3, 4))
                sizes, length = (np.array([len(x) // width for x in y]) for y in (terms, ids))
                key = routes(np.frombuffer(b"".join(terms), kind).astype(np.int64), np.frombuffer(b"".join(tf), kind), length, sizes, corpus, races)
                yield pa.RecordBatch.from_arrays([pa.array(key), *part.columns], ["key", *part.schema.names])

    return rows.mapInArrow(run, "key long, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)).repartitionByRange("key", "row").sortWithinPartitions("key", "row")


def pack_documents(docs: DataFrame, path: str, end_id: int, window: int = 2048) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    Every text (null: empty) is encoded whole and closed with ``end_id``, so an empty one is a piece of one token.
    ``sequence_id`` holds the partition above bit 36. Neighbours of equal score are taken in the order of their
    drawn terms, then of the input. Rows with equal or null doc_id are packed as rows of their own; an empty table
    gives no row; further columns are not read.
    """
    kind = "<u2" if max(bpe.load(path, bpe.LibraryBPE).size(), end_id + 1) <= 1 << 16 else "<u4"
    tokens = stage(tokenized(docs, path, end_id, kind), "packing-tokens")
    corpus = statistics(tokens, np.dtype(kind).itemsize)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, doc_kind = Packer(window, TaskContext.get().partitionId() << 36, corpus), None

        def made() -> pa.RecordBatch:
            doc, start, ids, total, sequence, offset = zip(*packer.out, strict=True)
            packer.out = []
            return pa.RecordBatch.from_pydict({"doc_id": pa.array(doc, doc_kind), "start": pa.array(start, pa.int64()), "length": pa.array([len(x) // 4 for x in ids], pa.int64()), "ids": pa.array(ids, pa.binary()), "doc_tokens": pa.array(total, pa.int64()), "sequence_id": pa.array(sequence, pa.int64()), "offset": pa.array(offset, pa.int64())})

        for batch in batches:
            doc_kind = batch.schema.field(0).type
            for part in portions(batch, 1, SHARD, MOST):
                for doc, *coded in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    packer.add(doc, *(np.frombuffer(x, kind) for x in coded))
                if packer.out:
                    yield made()
        packer.finish()
        if packer.out:
            yield made()

    rows = dealt(tokens, corpus, kind).select("doc_id", "ids", "terms", "tf")
    return rows.mapInArrow(run, f"doc_id {rows.schema[0].dataType.simpleString()}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def pieces(docs: DataFrame, path: str, end_id: int, window: int = 2048) -> DataFrame:
    """The pieces with ``ids_crc32`` in place of their ids."""
    return pack_documents(docs, path, end_id, window).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
