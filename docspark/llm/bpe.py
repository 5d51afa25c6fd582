"""Byte-level BPE with a priority queue of merge ranks over a doubly linked symbol list."""

from __future__ import annotations

import json
import re
import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

#: White space as Unicode has it.
WHITE = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WHITE_PY = re.sub(r"\\x\{(\w+)\}", lambda m: f"\\u{int(m[1], 16):04x}", WHITE)
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^%s\p{L}\p{N}]+|[%s]+(?![^%s])|[%s]+"
PIECES = regex.compile(SPLIT % ((WHITE_PY,) * 4))
INNER_SPACE = re.compile(rf"  |[{WHITE_PY}] (?:[{WHITE_PY}]|\Z)")
MARKS = frozenset(".,;:!?")
#: What a worker remembers at least, and the longest key worth remembering.
CACHE_PIECES, CACHE_WORDS, CACHE_CHARS = 400_000, 100_000, 48


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: itself if printable, else from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in letters):
        letters[b] = chr(256 + n)
    return [letters[b] for b in range(256)]


class Cache:
    """The last ``size`` to ``2 * size`` keys put or found: when the young half is full, it becomes the old one."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def get(self, key: str) -> bytes | None:
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key: str, ids: bytes) -> bytes:
        if len(key) <= CACHE_CHARS:
            if len(self.young) >= self.size:
                self.old, self.young = self.young, {}
            self.young[key] = ids
        return ids


class ByteBPE:
    """Encoder and decoder of a byte-level BPE file; ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.start = [vocab[c] for c in letters]
        self.ranks: dict[int, int] = {}  # left id << 32 | right id
        self.made: list[int] = []  # by rank
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks.setdefault(vocab[a] << 32 | vocab[b], rank)
            self.made.append(vocab[a + b])
        self.strings = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for word, i in vocab.items():
            self.strings[i] = bytes(back[c] for c in word) if all(c in back for c in word) else word.encode()
        for word, i in self.special.items():
            self.strings[i] = word.encode()
        parts = sorted(map(regex.escape, self.special), key=len, reverse=True)
        self.cut = regex.compile(f"({'|'.join(parts)})") if parts else None
        self.pieces, self.words = Cache(CACHE_PIECES), Cache(CACHE_WORDS)
        assert array("I").itemsize == 4 and sys.byteorder == "little"

    def size(self) -> int:
        return len(self.strings)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece. Best rank first, leftmost among equals.

        A queue entry is rank << 32 | position; it is stale if the pair at its position has another rank by now.
        """
        ids = [self.start[b] for b in piece]
        n, rank_of, made = len(ids), self.ranks.get, self.made
        if n == 1:
            return ids
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        best = [rank_of(a << 32 | b, -1) for a, b in pairwise(ids)]
        best.append(-1)
        queue = [r << 32 | i for i, r in enumerate(best) if r >= 0]
        heapify(queue)
        while queue:
            entry = heappop(queue)
            i, rank = entry & 0xFFFFFFFF, entry >> 32
            if best[i] != rank:
                continue
            j = after[i]
            ids[i] = new = made[rank]
            after[i] = k = after[j]
            ids[j] = best[j] = -1
            if k >= 0:
                before[k] = i
                best[i] = r = rank_of(new << 32 | ids[k], -1)
                if r >= 0:
                    heappush(queue, r << 32 | i)
            else:
                best[i] = -1
            h = before[i]
            if h >= 0:
                best[h] = r = rank_of(ids[h] << 32 | new, -1)
                if r >= 0:
                    heappush(queue, r << 32 | h)
        return [x for x in ids if x >= 0]

    def one(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            ids = self.pieces.put(piece, array("I", self.merge(piece.encode())).tobytes())
        return ids

    def encode_pieces(self, text: str) -> bytes:
        return b"".join(map(self.one, PIECES.findall(text)))

    def new_word(self, word: str) -> bytes:
        """Ids of a space and ``word``; letters with at most one mark behind need no pattern to be cut."""
        ids = self.words.get(word)
        if ids is None:
            if word.isalpha():
                return self.words.put(word, self.one(f" {word}"))
            if word[-1:] in MARKS and word[:-1].isalpha():
                ids = self.one(f" {word[:-1]}") + self.one(word[-1])
            else:
                ids = self.encode_pieces(f" {word}")
            self.words.put(word, ids)
        return ids

    def plain(self, text: str) -> bytes:
        """A single space always starts a piece unless white space stands on both sides, so words can be encoded apart."""
        if INNER_SPACE.search(text):
            return self.encode_pieces(text)
        first, *words = text.split(" ")
        known, new = self.words.young.get, self.new_word
        return self.encode_pieces(first) + b"".join([known(w) or new(w) for w in words])

    def encode(self, text: str) -> bytes:
        """Ids of the whole text; strings of special tokens become their id."""
        if self.cut is None or not any(s in text for s in self.special):
            return self.plain(text)
        return b"".join(array("I", [self.special[p]]).tobytes() if p in self.special else self.plain(p) for p in self.cut.split(text) if p)

    def decode(self, ids: bytes) -> str:
        """Vocabulary strings, concatenated; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


class LibraryBPE(ByteBPE):
    """The same ids; the merges are tiktoken's, for operators that only need ids."""

    def __init__(self, path: str):
        super().__init__(path)
        ranks = {s: i for i, s in enumerate(self.strings) if i not in self.special.values()}
        self.core = tiktoken.Encoding("own", pat_str=SPLIT % ((WHITE,) * 4), mergeable_ranks=ranks, special_tokens={})._core_bpe

    def plain(self, text: str) -> bytes:
        return array("I", self.core.encode_ordinary(text)).tobytes()


@lru_cache(maxsize=4)
def load(path: str, kind: type[ByteBPE] = ByteBPE) -> ByteBPE:
    """One encoder for each Python worker and file."""
    return kind(path)


def encode_texts(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), decoded: bool = False) -> DataFrame:
    """``keep`` columns and ``ids`` binary of every whole text (null: empty). Row by row, no shuffle.

    ``decoded`` adds the text decoded from the ids, in the same worker: ids and texts pass to Python and back once.
    Repeated rows give repeated rows; an empty table gives none; further columns are not read.
    """
    rows = docs.select(*keep, text)
    names = [*keep, "ids", *["decoded"] * decoded]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                ids = [bpe.encode(x or "") for x in part.column(len(keep)).to_pylist()]
                back = [pa.array(map(bpe.decode, ids), pa.string())] if decoded else []
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(ids, pa.binary()), *back], names)

    return rows.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keep), "ids binary", *["decoded string"] * decoded]))


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """Adds ``decoded``, the text of ``ids`` (null ids: the empty text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                texts = pa.array([bpe.decode(x or b"") for x in part.column("ids").to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, texts], [*part.schema.names, "decoded"])

    return encoded.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema), "decoded string"]))
