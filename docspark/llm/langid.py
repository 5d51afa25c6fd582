"""Language ID by cross-parsing entropy.

A suffix automaton of labelled text per language gives the longest match at each place; a text is parsed greedily
into such matches, and the language with the fewest phrases wins, each phrase counted as the bits that it takes to
point to it (log2 of the places in the sample and the letters there are), over the text's letters. Automata are
packed tables, and the texts of a batch run through them side by side, in runs of RUN letters: first each run as if it
began a phrase, then each with the phrase that its forerunner left open, up to the letter where both agree. So the
phrases are those of the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import stage

#: The training sample: at most so many documents a language, whole ones until so many letters are reached. Longer
#: documents than LONG are passed over; a language that has no others gives SAMPLE_LETTERS from the middle of one.
SAMPLE_DOCS, SAMPLE_LETTERS, LONG = 96, 40_000, 4000
#: More labels than this are an error, not a cut: the automata of all languages are held by each worker (1 MB each).
LANGUAGES = 1000
RUN, BATCH_CHARS = 256, 1 << 20
PAD, GAP, FIRST = 0, 1, 2


def held_out(doc_id: Column) -> Column:
    """Not for training: crc32 of the id as text, modulo 5, is 0 (a null id counts as the empty text, so held out)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_sample(docs: DataFrame, text: str = "text") -> dict[str, str]:
    """Language to sample text. Per language and hash bucket of the id, one document: a bounded, repeatable choice.

    Documents without a letter, or without a label, teach nothing.
    """
    t = F.col(text)
    usable = docs.filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & t.rlike(r"\p{L}"))
    order = F.struct(F.xxhash64("doc_id", F.lit(1)), F.xxhash64(t))
    short = F.length(t) <= LONG
    grouped = usable.groupBy("lang", F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE_DOCS)).alias("bucket"))
    picks = stage(grouped.agg(F.min_by(F.when(short, t), F.when(short, order)).alias("t"), F.min(F.when(short, order)).alias("o")), "language-sample")
    if picks.count() > SAMPLE_DOCS * LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    found: dict[str, list[str]] = {}
    for r in sorted(picks.collect(), key=lambda r: (r.lang, r.o is None, r.o or ())):  # SAMPLE_DOCS rows a language
        parts = found.setdefault(r.lang, [])
        if r.t is not None and sum(map(len, parts)) < SAMPLE_LETTERS:
            parts.append(r.t)
    if only_long := [lang for lang, parts in found.items() if not parts]:
        middle = F.substring(t, F.floor((F.length(t) - SAMPLE_LETTERS) / 2).cast("int") + 1, F.lit(SAMPLE_LETTERS))
        of_long = F.when(F.length(t) > SAMPLE_LETTERS, middle).otherwise(t)
        for lang, part in usable.filter(F.col("lang").isin(only_long)).groupBy("lang").agg(F.min_by(of_long, F.struct(F.length(t), order))).collect():
            found[lang].append(part)
    return {lang: "\n".join(parts) for lang, parts in found.items()}


@lru_cache(maxsize=1)
def folded() -> np.ndarray:
    """Code point to its lower-case letter, or to 0 if it is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton by state; state 0 is the start."""
    follow: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        now = len(follow)
        follow.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in follow[p]:
            follow[p][c] = now
            p = link[p]
        if p >= 0:
            q = follow[p][c]
            if length[q] == length[p] + 1:
                link[now] = q
            else:
                copy = len(follow)
                follow.append(dict(follow[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and follow[p].get(c) == q:
                    follow[p][c] = copy
                    p = link[p]
                link[q] = link[now] = copy
        last = now
    return follow


class Packed:
    """An automaton as one table: the entry at state + code is owner << 32 | next state, and counts if the owner is the state.

    States are places in the table, chosen so that no two entries meet (row displacement). ``dead`` has no
    transitions; ``start`` gives the state after the first letter of a phrase, ``dead`` for letters not in the sample.
    """

    def __init__(self, codes: list[int], width: int):
        follow = automaton(codes)
        place, taken, used = [0] * len(follow), set(), bytearray(width)
        by_size: dict[int, list[int]] = {}
        for s, row in enumerate(follow):
            by_size.setdefault(len(row), []).append(s)
        for size in sorted(by_size, reverse=True)[: len(by_size) - (0 in by_size)]:
            free = 0  # no place is sought before it: it moves on where the table is nearly full
            for s in by_size[size]:
                row, at, tries = sorted(follow[s]), free, 0
                rest = row[1:]
                while True:
                    at = used.find(0, at)
                    if at < 0 or at + width >= len(used):
                        used.extend(bytes(len(used)))
                        at = max(at, free)
                        continue
                    base = at - row[0]
                    if base >= 0 and base not in taken and (not rest or not any([used[base + c] for c in rest])):
                        break
                    at, tries = at + 1, tries + 1
                place[s] = base
                taken.add(base)
                for c in row:
                    used[base + c] = 1
                free = at if tries > 4 else free
        spare = 0
        for s in (*(s for s in range(len(follow)) if not follow[s]), -1):
            while spare in taken:
                spare += 1
            taken.add(spare)
            if s >= 0:
                place[s] = spare
            else:
                self.dead = spare
        self.table = np.full(max(taken) + width, -1 << 32, np.int64)
        for s, row in enumerate(follow):
            for c, q in row.items():
                self.table[place[s] + c] = place[s] << 32 | place[q]
        self.start = np.full(width, self.dead, np.int64)
        for c, q in follow[0].items():
            self.start[c] = place[q]

    def step(self, state: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the next states, where a phrase begins)."""
        entry = self.table[state + code]
        begins = (entry >> 32) != state
        return np.where(begins, self.start[code], entry & 0xFFFFFFFF), begins

    def phrases(self, steps: np.ndarray, follows: np.ndarray, entry: int | None = None) -> tuple[np.ndarray, int]:
        """(phrases that begin in each run, state after the last one) of runs laid out as columns of ``steps``.

        ``follows``: whether a run goes on from the one before. ``entry`` is the state before the first run.
        """
        length, n = steps.shape
        states, count = np.empty((length, n), np.int32), np.empty((length, n), np.int16)
        state, seen = np.full(n, self.dead, np.int64), np.zeros(n, np.int16)
        if entry is not None and n:
            state[0] = entry
        for j in range(length):
            state, begins = self.step(state, steps[j])
            seen = seen + begins
            states[j], count[j] = state, seen
        total, out = count[-1].astype(np.int64), states[-1].astype(np.int64)
        todo = np.flatnonzero(follows)
        while len(todo):
            runs, state, seen, moved = todo, out[todo - 1], np.zeros(len(todo), np.int64), np.zeros(0, np.int64)
            for j in range(length):
                state, begins = self.step(state, steps[j, runs])
                seen = seen + begins
                same = state == states[j, runs]
                if same.any():
                    done = runs[same]
                    total[done] = seen[same] + count[-1, done] - count[j, done]
                    moved = np.concatenate([moved, done[out[done] != states[-1, done]]])
                    out[done] = states[-1, done]
                    runs, state, seen = runs[~same], state[~same], seen[~same]
                    if not len(runs):
                        break
            total[runs] = seen
            moved = np.concatenate([moved, runs[out[runs] != state]])
            out[runs] = state
            after = np.sort(moved) + 1
            todo = after[(after < n) & follows[np.minimum(after, n - 1)]]
        return total, int(out[-1]) if n else self.dead


class Parser:
    """The automata of all languages over one alphabet, all letters of the training texts."""

    def __init__(self, samples: tuple[tuple[str, str], ...]):
        self.names = [lang for lang, _ in samples]
        points = [folded()[np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)] for _, t in samples]
        letters, counts = np.unique(np.concatenate([np.empty(0, np.uint32), *points]), return_counts=True)
        letters = letters[np.argsort(-counts, kind="stable")]
        letters = letters[letters > 0]
        unknown = FIRST + len(letters)
        code = np.full(0x110000, unknown, np.uint8 if unknown < 256 else np.int32)
        code[0] = GAP
        code[letters] = FIRST + np.arange(len(letters))
        self.code = code[folded()]
        self.packed, self.bits = [], []
        for _, t in samples:
            codes, _, _ = self.codes([t])
            self.packed.append(Packed(codes.tolist(), unknown + 1))
            self.bits.append(np.log2(len(codes) + len(letters) + 1))

    def codes(self, texts: list[str], ends: tuple[str, str] = (" ", " ")) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of all texts, each between gaps with runs of non-letters as one gap; codes and letters of each text."""
        raw = [f"{ends[0]}{t}{ends[1]}".encode("utf-32-le", "surrogatepass") for t in texts]
        codes = self.code[np.frombuffer(b"".join(raw), np.uint32)]
        starts = np.cumsum([0, *(len(r) // 4 for r in raw[:-1])])
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] != GAP) | (codes[:-1] != GAP)
        keep[starts] = True
        return codes[keep], np.add.reduceat(keep.astype(np.int64), starts), np.add.reduceat((codes >= FIRST).astype(np.int64), starts)

    def costs(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(bits a letter by text and language, letters by text)."""
        if len(texts) == 1 and len(texts[0]) > BATCH_CHARS:
            return self.long_costs(texts[0])
        codes, sizes, letters = self.codes(texts)
        runs = -(-sizes // RUN)
        first = np.cumsum(runs) - runs
        laid = np.zeros((int(runs.sum()), RUN), codes.dtype)
        laid.ravel()[np.arange(len(codes)) + np.repeat(first * RUN - (np.cumsum(sizes) - sizes), sizes)] = codes
        steps, pads = np.ascontiguousarray(laid.T).astype(np.int64), (laid == PAD).sum(axis=1)
        follows = np.ones(len(laid), bool)
        follows[first] = False
        out = np.empty((len(texts), len(self.names)))
        for n, (packed, bits) in enumerate(zip(self.packed, self.bits, strict=True)):
            phrases, _ = packed.phrases(steps, follows)  # a pad counts as one
            out[:, n] = np.add.reduceat(phrases - pads, first) * bits / np.maximum(1, letters)
        return out, letters

    def long_costs(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The same of one long text, BATCH_CHARS at a time: the open phrase is carried on."""
        states, phrases, letters, gap = [p.dead for p in self.packed], np.zeros(len(self.packed)), 0, False
        for at in range(0, len(text), BATCH_CHARS):
            last = at + BATCH_CHARS >= len(text)
            codes, _, found = self.codes([text[at : at + BATCH_CHARS]], (" " * (at == 0), " " * last))
            codes = codes[1:] if gap and codes[0] == GAP else codes
            if not len(codes):
                continue
            gap, letters = codes[-1] == GAP, letters + int(found[0])
            runs = -(-len(codes) // RUN)
            laid = np.zeros((runs, RUN), codes.dtype)
            laid.ravel()[: len(codes)] = codes
            steps, follows = np.ascontiguousarray(laid.T).astype(np.int64), np.arange(runs) > 0
            tail = len(codes) - (runs - 1) * RUN
            for n, packed in enumerate(self.packed):
                whole, state = packed.phrases(steps[:, :-1], follows[:-1], states[n])
                rest, states[n] = packed.phrases(steps[:tail, -1:], follows[:1], state if runs > 1 else states[n])
                phrases[n] += whole.sum() + rest.sum()
        return (phrases * np.array(self.bits) / max(1, letters))[None, :], np.array([letters])


@lru_cache(maxsize=2)
def parser(samples: tuple[tuple[str, str], ...]) -> Parser:
    """One for each Python worker and model; the model that is sent is the sample, a few ten kB a language."""
    return Parser(samples)


def predict(docs: DataFrame, samples: dict[str, str], text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, lang_pred and score for every row.

    ``und`` with score 0 if the text is null or has no letter, or if no language was learned. The score is 1 less the
    winner's bits over the runner-up's (1 if only one language was learned); ties go to the first name. Repeated rows
    get equal answers; an empty table gives no row; further columns are not read.
    """
    rows, model = docs.select(*keep, *[text] * (text not in keep)), tuple(sorted(samples.items()))
    at_text = rows.columns.index(text)

    def answers(texts: list[str]) -> tuple[list[str], list[float]]:
        if not model:
            return ["und"] * len(texts), [0.0] * len(texts)
        costs, letters = parser(model).costs(texts)
        best = costs.argmin(axis=1)
        least = costs[np.arange(len(texts)), best]
        costs[np.arange(len(texts)), best] = np.inf
        score = np.clip(1 - least / costs.min(axis=1), 0, 1)
        names = [model[b][0] if n else "und" for b, n in zip(best, letters, strict=True)]
        return names, np.where(letters > 0, score, 0.0).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                part = batch.slice(first, 1024)
                texts = [t or "" for t in part.column(at_text).to_pylist()]
                names, scores, at = [], [], 0
                while at < len(texts):
                    end, size = at, 0
                    while end < len(texts) and (end == at or size + len(texts[end]) <= BATCH_CHARS):
                        size += len(texts[end])
                        end += 1
                    a, b = answers(texts[at:end])
                    names, scores, at = names + a, scores + b, end
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*keep, "lang_pred", "score"])

    return rows.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keep), "lang_pred string, score double"]))
