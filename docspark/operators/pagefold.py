"""Layout of whole pages in one pass: blocks in, lines, regions and page texts out.

The rules are those of ``layout``, which has them as column expressions step by step. Here blocks are sorted by page once
and streamed; the rules read counts of character classes that NumPy takes over all texts of a batch together. Only the
blocks of the page that a batch ends in wait for the next one.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from docspark.functions import normalize as N
from docspark.functions import textfeat as T
from docspark.operators.layout import MIN_FORMULA_SCORE, MIN_SCORE, PAGE, SENTENCE_TAILS, VERB_STARTS

SPACE, LETTER, PERSIAN, LATIN, DECIMAL, DIGIT, PERCENT = (1 << i for i in range(7))
SOLE, DECORATIVE = "Oo0Q©®", frozenset("0Oo°○۰٠")
FORMULA = re.compile(T.FORMULA.removesuffix("$") + r"(?:\r\n|[\n\r\x85\u2028\u2029])?\Z")  # as Java ends a line
ELEMENT, SIGN = re.compile("[A-Z][a-z]?[0-9]"), re.compile("[+=→⇌-]")
DIGITS = str.maketrans(T.DIGITS_FROM, T.DIGITS_TO)
FOLD = str.maketrans(N.FOLD_FROM[: len(N.FOLD_TO)], N.FOLD_TO, N.GONE)
FOLDED = re.compile(f"[{re.escape(N.FOLD_FROM)}]")
FORMS = re.compile("[\ufb50-\ufdff\ufe70-\ufeff]")
BEFORE_MARK, BLANKS = re.compile(r"\s+([,:.!،؛؟])"), re.compile(r"[ \t\xa0\u2000-\u200a]{2,}|[\t\xa0\u2000-\u200a]")
BETWEEN = "\U0010ffff"  # no character; stands between texts that are worked on together
LINE_FIELDS = "l double, t double, r double, b double, min_score double, mean_score double, line_id int, columns int, position int, median_height double, max_width double, line_type string"
REGION_FIELDS = "role string, text string, l double, t double, r double, b double, score double, n_lines bigint, region_idx int, heading_text string"
REGION_COLUMNS = [x.split()[0] for x in REGION_FIELDS.split(", ")]
#: Columns of the lines of ``all``.
LINE_COLUMNS = ["text", *(x.split()[0] for x in LINE_FIELDS.split(", ")), "role", "region_idx", "heading_text"]


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Flags of each code point."""
    flags = np.zeros(sys.maxunicode + 1, np.uint8)
    for c in map(chr, range(sys.maxunicode + 1)):
        kind = unicodedata.category(c)
        flags[ord(c)] = SPACE * c.isspace() | LETTER * (kind[0] == "L") | DECIMAL * (kind == "Nd")
    for first, last in ((0x600, 0x6FF), (0x750, 0x77F), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)):
        flags[first : last + 1] |= PERSIAN
    for chars, flag in (("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", LATIN), ("0123456789" + T.DIGITS_FROM, DIGIT), ("%٪", PERCENT)):
        flags[[ord(c) for c in chars]] |= flag
    return flags


def normalized(texts: list[str]) -> list[str]:
    """``normalize_text`` of each."""
    whole = BETWEEN.join(texts)
    if whole.count(BETWEEN) >= len(texts):  # one of them has it
        return [x for t in texts for x in (normalized([t]) if BETWEEN not in t else [_normal(t).strip()])]
    return [t.strip() for t in _normal(whole).split(BETWEEN)] if texts else []


def _normal(text: str) -> str:
    text = unicodedata.normalize("NFC", text)
    if not text.isascii():
        forms = N.presentation_forms()
        text = FORMS.sub(lambda m: forms.get(m[0], m[0]), text)
        text = FOLDED.sub(lambda m: m[0].translate(FOLD), text)
    return BLANKS.sub(" ", BEFORE_MARK.sub(r"\1", text))


class Features:
    """Counts and flags of texts, each an array over them."""

    def __init__(self, texts: list[str], marks: tuple[str, ...]):
        self.texts = texts
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        self.starts, self.ends = np.concatenate(([0], ends[:-1])) if len(texts) else ends, ends
        kinds = _classes()[points]
        blank = kinds & SPACE != 0
        full = ~blank
        self.kinds = kinds
        self.size = self._each(full)
        self.length = ends - self.starts
        self.latin = self._each(kinds & LATIN != 0)
        self.foreign = self._few(full & (points >= 128))
        for name, flag in (("persian", PERSIAN), ("decimals", DECIMAL), ("digits", DIGIT), ("percents", PERCENT)):
            setattr(self, name, self._few(kinds & flag != 0))
        edge = np.zeros(len(points) + 1, bool)
        edge[self.starts], edge[-1] = True, True
        first = np.flatnonzero(full & (edge[:-1] | np.concatenate(([True], blank[:-1]))[: len(points)]))
        last = np.flatnonzero(full & (edge[1:] | np.concatenate((blank[1:], [True]))[: len(points)]))
        of = np.searchsorted(ends, first, "right")
        self.words = np.bincount(of, minlength=len(texts))
        self.short = np.bincount(of[last - first < 2], minlength=len(texts))
        self.last = np.zeros(len(texts), np.uint32)
        self.last[of] = points[last]  # of a text's words, the last one stays
        self.fa = self.persian > 0
        self.spam = np.where(self.words < 3, 0.0, self.short / np.maximum(self.words, 1))
        self.english = (self.foreign == 0) & (self.latin >= 3) & (10 * self.latin >= 7 * self.size)
        self.decorative = self._where((self.size >= 1) & (self.size <= 8), lambda t: DECORATIVE.issuperset("".join(t.split())))
        self.ratio = self.persian / np.maximum(self.size, 1)
        self.foot = self._containing(points[full], marks)
        self.formula = self._where(self.digits > 0, _formula)

    def letters(self) -> np.ndarray:
        return self._each(self.kinds & LETTER != 0)

    def _each(self, mask: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(mask) + 1, np.int32 if len(mask) < 2**31 else np.int64)
        np.cumsum(mask.view(np.int8), dtype=sums.dtype, out=sums[1:])
        return (sums[self.ends] - sums[self.starts]).astype(np.int64)

    def _few(self, mask: np.ndarray) -> np.ndarray:
        """The same for what is rare in most texts."""
        return np.bincount(np.searchsorted(self.ends, np.flatnonzero(mask), "right"), minlength=len(self.ends))

    def _where(self, asked: np.ndarray, rule: Callable[[str], bool]) -> np.ndarray:
        out = np.zeros(len(self.texts), bool)
        for i in np.flatnonzero(asked).tolist():
            out[i] = rule(self.texts[i])
        return out

    def _containing(self, points: np.ndarray, marks: tuple[str, ...]) -> np.ndarray:
        """Texts that hold a mark once white space is gone; ``points`` are all texts without it."""
        out, ends = np.zeros(len(self.texts), bool), np.cumsum(self.size)
        whole = np.insert(points, ends[:-1], 10).tobytes().decode("utf-32-le", "surrogatepass") if len(self.texts) else ""
        ends = ends + np.arange(1, len(ends) + 1)
        for mark in marks:
            if mark == "":
                out[:] = True
            at = -1 if any(map(str.isspace, mark)) or not mark else whole.find(mark)
            while at >= 0:
                i = int(np.searchsorted(ends, at, "right"))
                out[i] = True
                at = whole.find(mark, int(ends[i]))
        return out

    def chart(self) -> np.ndarray:
        return (self.words <= 3) & ((self.percents > 0) | self._where((self.words <= 3) & (self.decimals > 0), _chart))

    def numbers(self) -> np.ndarray:
        return self._where(self.decimals > 0, lambda t: any(len(x) <= 2 and x.isdecimal() for x in (w.strip("().,") for w in t.split())))

    def sentence(self) -> np.ndarray:
        return self._where(self.fa, lambda t: t.strip().endswith(SENTENCE_TAILS) or t.lstrip().startswith(VERB_STARTS))

    def noise(self, score: np.ndarray) -> np.ndarray:
        """First rule that applies decides."""
        n, one = self.size, np.zeros(len(self.texts), bool)
        for i in np.flatnonzero(n == 1).tolist():
            one[i] = self.texts[i].strip() in SOLE
        rules = (
            (n == 0, True), (self.foot, True), (self.formula | self.english, False), (one | self.decorative, True), ((n == 1) & (score < 0.80), True), ((n == 2) & (score < 0.60), True),
            (~self.fa, (n <= 8) & (score < 0.75)), ((self.ratio < 0.45) & (n <= 10) & (score < 0.75), True),
        )
        return np.select([r for r, _ in rules], [x for _, x in rules], self.spam >= 0.5)

    def kept(self, score: np.ndarray) -> np.ndarray:
        good = ~(score < MIN_SCORE) | self.formula & ~(score < MIN_FORMULA_SCORE)
        return good & ~self.noise(score)

    def line_types(self, score: np.ndarray, bottom: np.ndarray, height: np.ndarray, median: np.ndarray, width: np.ndarray, widest: np.ndarray, page_height: float) -> np.ndarray:
        n, w = self.size, self.words
        short = np.where(widest > 0, width < 0.5 * widest, width < 300)
        heading = (w >= 2) & (w <= 8) & short & ((height > 1.25 * median) | (w <= 6)) & ~np.isin(self.last, [ord(c) for c in ",.،;:"])
        noise = (
            (n == 0) | (bottom >= 0.90 * page_height) & (self.foot | (w <= 6)) | self.foot | self.decorative | (self.spam >= 0.5) & (w >= 3),
            ~self.fa & ((n <= 3) | (n <= 10) & (score < 0.75) | (self.letters() < 3)) | (self.ratio < 0.35) & (n <= 12) & (score < 0.75),
        )
        special = self.formula | self.chart() | self.english & ~self.fa
        return np.select([noise[0], special, noise[1], self.sentence() | self.numbers(), heading], ["noise", "special", "noise", "body", "heading"], "body")


def _formula(text: str) -> bool:
    t = text.replace(" ", "").translate(DIGITS)
    return len(t) <= 60 and bool(FORMULA.match(t) and re.search("[0-9]", t) or ELEMENT.search(t) and SIGN.search(t))


def _chart(text: str) -> bool:
    return any(x.isdecimal() or len(x) <= 5 and x[:1].isdecimal() for x in (w.strip("().,") for w in text.split()))


def _line_numbers(page: list[int], top: list[float], bottom: list[float]) -> list[int]:
    """Line of each block in its page, as ``layout._line_numbers`` deals them."""
    out, live, n, before = [], [], 0, -1
    for p, t, b in zip(page, top, bottom, strict=True):
        if p != before:
            live, n, before = [], 0, p
        live = [o for o in live if o[2] > t]
        most, at = 0.0, -1
        for i, (_, ot, ob) in enumerate(live):
            shared = min(ob, b) - max(ot, t)
            if shared > most and shared >= 0.5 * min(ob - ot, b - t):
                most, at = shared, i
        if at >= 0:
            k = live[at][0]
            live[at] = (k, t, b)
        else:
            k, n = n, n + 1
            live.append((k, t, b))
        out.append(k)
    return out


def _first(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal ``keys`` starts."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _together(texts: list[str | None], starts: np.ndarray, between: str) -> list[str]:
    """Runs of texts joined, without empty ones."""
    ends = [*starts[1:].tolist(), len(texts)][: len(starts)]
    return [between.join(filter(None, texts[a:z])) if z - a > 1 else texts[a] or "" for a, z in zip(starts.tolist(), ends, strict=True)]


def _mean(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Means of runs, added up one by one in order; nulls do not count."""
    of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(values))))
    some = ~np.isnan(values)
    with np.errstate(invalid="ignore"):
        return np.bincount(of, np.where(some, values, 0.0), len(starts)) / np.bincount(of, some, len(starts))


class Lines:
    """Typed lines of whole pages in reading order, from their blocks in order."""

    def __init__(self, rows: pa.Table, page: np.ndarray, texts: dict[str, list], width: float, height: float, marks: tuple[str, ...]):
        box = {c: rows.column(c).to_numpy() for c in ("l", "t", "r", "b", "score")}
        line = np.array(_line_numbers(page.tolist(), box["t"].tolist(), box["b"].tolist()), np.int64)
        order = np.lexsort((np.arange(len(line)), -(box["l"] + box["r"]) / 2, line, page))  # right to left
        first = _first(page[order], line[order])
        box = {c: x[order] for c, x in box.items()}
        made = {"l": np.minimum.reduceat(box["l"], first), "t": np.minimum.reduceat(box["t"], first), "r": np.maximum.reduceat(box["r"], first), "b": np.maximum.reduceat(box["b"], first), "min_score": np.fmin.reduceat(box["score"], first), "mean_score": _mean(box["score"], first)}
        joined = {name: _together([x[i] for i in order.tolist()], first, " ") for name, x in texts.items()}
        at, line = order[first], line[order[first]]
        of = page[at]
        self._order(np.lexsort((line, made["t"], of)), at, of, made, joined)
        made["line_id"] = self._rank()
        pages, counts = self.pages, self.counts
        mid, slack = width / 2, 0.02 * width
        n = counts
        left, right, crossing = (np.add.reduceat(x.astype(np.int64), pages) for x in (made["r"] <= mid + slack, made["l"] >= mid - slack, (made["r"] > mid + slack) & (made["l"] < mid - slack)))
        columns = np.where((n >= 8) & (left >= 3) & (right >= 3) & (crossing <= np.maximum(2, np.floor(0.2 * n))), 2, 1)
        made["columns"] = np.repeat(columns, counts)
        second = (made["columns"] == 2) & ((made["l"] + made["r"]) / 2 < mid)
        self._order(np.lexsort((made["line_id"], made["t"], second, self.of)), self.at, self.of, made, self.texts)
        made["position"] = self._rank()
        tall, wide = made["b"] - made["t"], made["r"] - made["l"]
        heights = tall[np.lexsort((tall, self.of))]
        made["median_height"] = np.repeat((0.5 * heights[pages + (counts - 1) // 2] + 0.5 * heights[pages + counts // 2]), counts)
        made["max_width"] = np.repeat(np.maximum.reduceat(wide, pages), counts)
        made["line_type"] = Features(self.texts["text"], marks).line_types(made["mean_score"], made["b"], tall, made["median_height"], wide, made["max_width"], height)
        self.made = made

    def _order(self, order: np.ndarray, at: np.ndarray, of: np.ndarray, made: dict[str, np.ndarray], texts: dict[str, list]) -> None:
        for name, x in made.items():
            made[name] = x[order]
        self.at, self.of = at[order], of[order]
        self.texts = {name: [x[i] for i in order.tolist()] for name, x in texts.items()}
        self.pages = _first(self.of)
        self.counts = np.diff(np.append(self.pages, len(self.of)))

    def _rank(self) -> np.ndarray:
        return np.arange(len(self.of)) - np.repeat(self.pages, self.counts) + 1

    def columns(self) -> dict[str, np.ndarray | list]:
        return self.texts | self.made

    def regions(self, keep_headings: bool) -> tuple[np.ndarray, dict[str, np.ndarray | list], np.ndarray, np.ndarray]:
        """(block of each region's first line, columns of the regions, lines in regions, region of each of these)."""
        m, kind = self.made, self.made["line_type"]
        new = np.zeros(len(kind), bool)
        new[self.pages] = True
        gap = np.concatenate(([0.0], m["t"][1:] - m["b"][:-1]))
        starts = new | np.concatenate(([True], kind[1:] != kind[:-1])) | (kind == "heading") | (kind == "special") & (gap > 3.0 * m["median_height"]) | (kind == "body") & (gap > 0.9 * m["median_height"])
        island = np.cumsum(starts)
        body_next = np.append((kind[1:] == "body") & ~new[1:], False)
        inside = np.flatnonzero((kind != "noise") & ~((kind == "heading") & body_next & (not keep_headings)))
        first = _first(island[inside])
        text = self.texts.get("clean", self.texts["text"])
        texts = _together([text[i] for i in inside.tolist()], first, " ")
        head = inside[first]
        of, counts = self.of[head], np.diff(np.append(first, len(inside)))
        pages = _first(of)
        index = np.arange(len(head)) - np.repeat(pages, np.diff(np.append(pages, len(head))))
        role = kind[head]
        above = np.maximum.accumulate(np.where(role == "heading", np.arange(len(head)), -1)) if len(head) else head
        page_start = np.arange(len(head)) - index
        headings = [texts[a] if body and a >= p else None for a, body, p in zip(above.tolist(), (role == "body").tolist(), page_start.tolist(), strict=True)]
        box = {c: f.reduceat(m[c][inside], first) if len(head) else m[c][:0] for c, f in (("l", np.minimum), ("t", np.minimum), ("r", np.maximum), ("b", np.maximum))}
        made = {"role": role, "text": texts, **box, "score": _mean(m["mean_score"][inside], first) if len(head) else m["l"][:0], "n_lines": counts, "region_idx": index, "heading_text": headings}
        return self.at[head], made, inside, np.repeat(np.arange(len(head)), counts)


def _whole_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole pages, in order."""
    held: list[pa.RecordBatch] = []

    def page(batch: pa.RecordBatch, i: int) -> tuple:
        return tuple(batch.column(c)[i].as_py() for c in PAGE)

    for batch in batches:
        if batch.num_rows == 0:
            continue
        if held and page(held[-1], held[-1].num_rows - 1) != page(batch, 0):
            yield pa.Table.from_batches(held)
            held = []
        cut = int(_first(*_page_codes(batch))[-1])
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _page_codes(rows: pa.Table | pa.RecordBatch) -> list[np.ndarray]:
    def codes(x: pa.Array | pa.ChunkedArray) -> np.ndarray:
        x = x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
        return x.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)

    return [codes(rows.column(c)) for c in PAGE]


def _numbers(rows: pa.Table) -> np.ndarray:
    """Number of each row's page, from 0."""
    starts = _first(*_page_codes(rows))
    return np.repeat(np.arange(len(starts)), np.diff(np.append(starts, rows.num_rows)))


def fold(blocks: DataFrame, width: float, height: float, want: str, *, noise: bool = False, source: str | None = None, keep_headings: bool = False, marks: tuple[str, ...] = T.FOOTER_MARKS) -> DataFrame:
    """``want`` of pages: their typed ``lines``, their ``regions`` with headings, or ``all``.

    ``noise``: blocks are filtered as by ``filter_blocks``. ``source`` ``text``: texts are normalized first; ``ocr``: the
    text as it was read decides and the normalized one, ``clean``, is what regions are made of. ``all`` has the rows of
    both, and a row a page with its text, told apart by ``kind``; its lines name the region they are in and that
    region's role and heading.
    """
    given = {f.name: f for f in blocks.schema}
    names = ["text", *(["clean"] if "clean" in given or source == "ocr" else [])]
    fields = ["block_idx", "text", *(["clean"] if "clean" in given else [])]
    rows = blocks.select(*PAGE, *fields, *(F.col(c).cast("double").alias(c) for c in ("l", "t", "r", "b", "score")))
    rows = rows.repartition(*PAGE).sortWithinPartitions(*PAGE, "t", "l", F.col("block_idx").cast("int"), "b", "r", "score", *(f for f in fields if f != "block_idx"))
    keys = ", ".join(f"{c} {given[c].dataType.simpleString()}" for c in PAGE)
    more = ", ".join(f"{c} string" for c in names)
    lines, regions = f"{keys}, {more}, {LINE_FIELDS}", f"{keys}, {REGION_FIELDS}"
    schema = {"lines": lines, "regions": regions, "all": f"kind string, {lines}, role string, score double, n_lines bigint, region_idx int, heading_text string"}[want]
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_pages(batches):
            if noise:  # neither without a text nor without a score
                table = table.filter(pc.and_(pc.is_valid(table["text"]), pc.is_valid(table["score"])))
            texts = {c: table[c].to_pylist() for c in names if c in table.column_names}
            if source:
                texts["text" if source == "text" else "clean"] = normalized([t or "" for t in texts["text"]])
            if noise:
                keep = np.flatnonzero(Features(texts["text"], marks).kept(table["score"].to_numpy()))
                table, texts = table.take(pa.array(keep)), {c: [x[i] for i in keep.tolist()] for c, x in texts.items()}
            if table.num_rows:
                yield from made(table, Lines(table, _numbers(table), texts, width, height, marks))

    def made(table: pa.Table, found: Lines) -> Iterator[pa.RecordBatch]:
        def rows_of(at: np.ndarray, values: dict) -> pa.RecordBatch:
            values = values | {c: table[c].take(pa.array(at)).combine_chunks() for c in PAGE}
            return pa.RecordBatch.from_arrays([_column(values.get(f.name), f.type, len(at)) for f in arrow], schema=arrow)

        if want == "lines":
            yield rows_of(found.at, found.columns())
            return
        at, regions, inside, of = found.regions(keep_headings)
        if want == "regions":
            yield rows_of(at, regions)
            return
        lines = found.columns()
        for name in ("role", "region_idx", "heading_text"):
            filled = np.full(len(found.at), None, object)
            filled[inside] = np.array(regions[name], object)[of]
            lines[name] = filled.tolist()
        yield rows_of(found.at, lines | {"kind": ["line"] * len(found.at)})
        yield rows_of(at, regions | {"kind": ["region"] * len(at)})
        pages = _first(_numbers(table)[at])
        yield rows_of(at[pages], {"kind": ["page"] * len(pages), "text": _together(regions["text"], pages, "\n\n")})

    return rows.mapInArrow(run, schema)


def filter_blocks(blocks: DataFrame, marks: tuple[str, ...] = T.FOOTER_MARKS) -> DataFrame:
    """Blocks that are not noise; those without a text or a score go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.and_(batch["text"].is_valid(), batch["score"].is_valid()))
            if batch.num_rows:
                score = batch["score"].cast(pa.float64()).to_numpy()
                yield batch.filter(pa.array(Features(batch["text"].to_pylist(), marks).kept(score)))

    return blocks.mapInArrow(run, blocks.schema)


def _column(values: np.ndarray | list | pa.Array | None, kind: pa.DataType, n: int) -> pa.Array:
    if values is None:
        return pa.nulls(n, kind)
    if isinstance(values, pa.Array | pa.ChunkedArray):
        return (values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values).cast(kind)
    if isinstance(values, np.ndarray) and values.dtype.kind == "U":
        values = values.tolist()
    if isinstance(values, np.ndarray):
        return pa.array(values, from_pandas=values.dtype.kind == "f").cast(kind)
    return pa.array(values, kind)
