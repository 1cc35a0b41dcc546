"""Benchmark decontamination by the q-gram lemma.

Benchmark texts are the patterns, in windows. A window of m characters that
occurs in a document with at most k edits shares at least m - q + 1 - k * q of
its q-grams with it, all on diagonals within k of each other. Shared q-grams
are counted in overlapping bands of diagonals, 2 * (k + 1) wide; bands that
reach the bound are verified by banded alignment. Nothing else is compared, and
nothing that the lemma allows for these windows is left out.

Windows are of two kinds. Long ones (120 characters, or the whole of a shorter
item) may have 10 % of edits. Short ones (60 characters, started at most 5
apart) may have half that share, so every stretch of 64 characters of an item
holds one in full: a verbatim quote that long is found wherever it begins. The
q-grams are kept once for each item, not for each window.

The benchmark is taken in blocks of about ``BLOCK_ITEMS`` items and
``BLOCK_CHARS`` characters at most, one after the other: a block is gathered,
sent out, held against all documents in one pass that writes what it finds, and
given up. Texts with very many hits are searched in overlapping stretches. So
what the driver and an executor hold is bounded.

Characters are compared in lower case with each white-space character as a
blank; positions are code points of the original text.

Nulls and edges: null texts are empty. Items shorter than ``MIN_CHARS``
characters are found only unedited and as whole words, since with edits they
would be found in clean texts; those shorter than a q-gram have nothing to be
counted and are not searched. Items that share an
``item_id`` are each searched; rows that share a ``doc_id`` are each compared
and their findings joined. Rows with a null id on either side give findings
with a null id. Empty tables give no findings. Other columns are not read.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexflow.llm import common
from codexflow.llm.encode import column

#: Length of the q-grams, share of a window's characters that may be edited.
Q, EDITS = 8, 0.1
#: Windows of longer items, and how far apart they start.
WINDOW, STEP = 120, 60
#: Short windows of items longer than one, how far apart they start, and their part of the share of edits.
SHORT, SHORT_STEP, SHORT_PART = 60, 4, 0.5
#: Shorter items are found only as they are.
MIN_CHARS = 30
#: More than any place of a window in a text is long.
REACH = 2 * WINDOW
BLOCK_ITEMS, BLOCK_CHARS = 10_000, 20_000_000
#: Shared q-grams that are looked at together.
HITS = 500_000

_ROWS = 256
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BITS = 22


def codes(text: str) -> np.ndarray:
    """One code for each code point: lower case, white space as a blank."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    x = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    x[(x >= 9) & (x <= 13) | (x == 0xA0) | (x == 0x2028) | (x == 0x2029)] = 32
    return x


def grams(x: np.ndarray, q: int = Q) -> np.ndarray:
    """The hash of the q-gram that starts at each place."""
    n = len(x) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(q):
        h = h * _BASE + x[i : i + n]
    return h ^ (h >> np.uint64(29))


def edit_budget(m: int, edits: float = EDITS, q: int = Q) -> int:
    """The edits allowed in m characters, such that the lemma's bound is positive."""
    return max(0, min(int(m * edits), (m - q) // q))


def align(pattern: np.ndarray, text: np.ndarray, k: int) -> tuple[int, int, int] | None:
    """Least edits of the pattern within the text, and where, if at most k.

    Rows of the table run over the pattern, columns over diagonals: those on
    which the pattern fits into the text, and k more on either side. The pattern
    may start and end on any.
    """
    m, n = len(pattern), len(text)
    wide = n - m + 2 * k + 1
    if wide <= 0:
        return None
    steps = np.arange(wide)
    # The text's place of a diagonal in row 0; places outside the text can't be reached.
    place = steps - k
    far = np.int64(m + n)
    cost = np.where((place >= 0) & (place <= n), 0, far)
    start = place.copy()
    padded = np.full(m + wide + k, -1, np.int64)
    padded[k : k + n] = text[: len(padded) - k]
    for i, c in enumerate(pattern.astype(np.int64)):
        best, origin = cost + (padded[i : i + wide] != c), start
        # A character of the pattern left out: from the next diagonal.
        up = np.append(cost[1:] + 1, far)
        worse = up < best
        best, origin = np.where(worse, up, best), np.where(worse, np.append(start[1:], 0), origin)
        at = place + i + 1
        best[(at < 0) | (at > n)] = far
        # Characters of the text between: the least of best[d] - d to the left, plus d.
        low = best - steps
        least = np.minimum.accumulate(low)
        from_ = np.maximum.accumulate(np.where(low == least, steps, 0))
        cost, start = least + steps, origin[from_]
        cost[(at < 0) | (at > n)] = far
        if cost.min() > k:
            return None
    end = int(cost.argmin())
    return (int(cost[end]), int(start[end]), end - k + m) if cost[end] <= k else None


def _equal(pattern: np.ndarray, text: np.ndarray) -> tuple[int, int, int] | None:
    """Where the pattern stands in the text unedited."""
    data, wanted, at = text.tobytes(), pattern.tobytes(), 0
    while (at := data.find(wanted, at)) >= 0:
        if at % 4 == 0:
            return 0, at // 4, at // 4 + len(pattern)
        at += 1
    return None


def _in_word(text: np.ndarray, at: int) -> bool:
    """Whether a word goes on across a place."""
    return 0 < at < len(text) and chr(text[at - 1]).isalnum() and chr(text[at]).isalnum()


@dataclass(frozen=True)
class Window:
    item_id: int | None
    at: int
    codes: np.ndarray
    k: int
    bound: int


def _starts(n: int) -> tuple[list[int], list[int]]:
    """Where the long and the short windows of an item of n characters start; no place is in both."""
    long = [0] if n <= WINDOW else [*range(0, n - WINDOW, STEP), n - WINDOW]
    taken = set(long)
    # The first short one starts at 1, since a long one may be at 0; a taken place gives way to the next.
    return long, [s + (s in taken) for s in range(1, n - SHORT + 1, SHORT_STEP)]


class _Kind:
    """Windows of one kind, in the order of items and starts; each item's have one length, budget and bound."""

    def __init__(self, starts: list[list[int]], sizes: list[int], edits: float, q: int):
        self.size = np.array(sizes, np.int64)
        self.k = np.array([edit_budget(m, edits if m >= MIN_CHARS else 0, q) for m in sizes], np.int64)
        self.bound = self.size - q + 1 - self.k * q
        self.item = np.repeat(np.arange(len(starts)), [len(s) for s in starts])
        self.at = np.array([s for some in starts for s in some], np.int64)
        self.none = np.array([not s for s in starts], bool)


class Index:
    """The windows of one block of items, and the items' q-grams."""

    def __init__(self, items: list[tuple[int | None, str | None]], edits: float = EDITS, q: int = Q):
        self.q = q
        kept = [(i, x) for i, x in ((i, codes((text or "").strip())) for i, text in items) if len(x) >= q]
        self.ids, self.codes = [i for i, _ in kept], [x for _, x in kept]
        starts = [_starts(len(x)) for x in self.codes]
        self.kinds = (
            _Kind([a for a, _ in starts], [min(len(x), WINDOW) for x in self.codes], edits, q),
            _Kind([b for _, b in starts], [min(len(x), SHORT) for x in self.codes], edits * SHORT_PART, q),
        )
        self.longest = max(map(len, self.codes), default=0)
        hashes = [grams(x, q) for x in self.codes]
        g = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(g, kind="stable")
        self.grams, self.first, self.count = np.unique(g[order], return_index=True, return_counts=True)
        self.owner = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])[order]
        self.place = (np.concatenate([np.arange(len(h)) for h in hashes]) if hashes else np.zeros(0, np.int64))[order]
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[(self.grams >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    @property
    def windows(self) -> list[Window]:
        return [self._window(kind, w) for kind in self.kinds for w in range(len(kind.at))]

    def _window(self, kind: _Kind, w: int) -> Window:
        i, at = int(kind.item[w]), int(kind.at[w])
        return Window(self.ids[i], at, self.codes[i][at : at + int(kind.size[i])], int(kind.k[i]), int(kind.bound[i]))

    def find(self, text: str | None) -> list[tuple[Window, int, int, int]]:
        """Windows found in a text: (window, edits, start, end), the best place of each."""
        if not text or not self.ids:
            return []
        x = codes(text)
        g = grams(x, self.q)
        at = np.flatnonzero(self.seen[(g >> np.uint64(64 - _BITS)).astype(np.int64)])
        if not len(at):
            return []
        i = np.searchsorted(self.grams, g[at])
        i[i == len(self.grams)] = 0
        hit = self.grams[i] == g[at]
        at, i = at[hit], i[hit]
        total = np.cumsum(self.count[i])
        found: dict[tuple[int | None, int, int], tuple[Window, int, int, int]] = {}
        low = 0
        while low < len(at):
            # A stretch of the text with so many hits, but two windows long at least.
            held = int(total[low - 1]) if low else 0
            high = max(int(np.searchsorted(total, held + HITS, "right")), int(np.searchsorted(at, at[low] + 2 * REACH)), low + 1)
            for f in self._in_stretch(x, at[low:high], i[low:high]):
                key = (id(f[0].codes.base), f[0].at, len(f[0].codes))
                if key not in found or f[1] < found[key][1]:
                    found[key] = f
            if high >= len(at):
                break
            # The next one begins a window's reach before, so every place of a window is whole in one of them.
            low = max(low + 1, int(np.searchsorted(at, at[high] - REACH)))
        return list(found.values())

    def _in_stretch(self, x, at, i) -> list[tuple[Window, int, int, int]]:
        n = self.count[i]
        entry = np.repeat(self.first[i] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        item, place = self.owner[entry], self.place[entry]
        diagonal = np.repeat(at, n) - place
        shared = np.bincount(item, minlength=len(self.ids))
        return [f for kind in self.kinds for f in self._of_kind(kind, x, item, place, diagonal, shared)]

    def _of_kind(self, kind: _Kind, x, item, place, diagonal, shared) -> list[tuple[Window, int, int, int]]:
        # Too few in the whole text are too few in any band.
        many = (shared >= kind.bound) & ~kind.none
        if not many.any():
            return []
        some = many[item]
        item, place, diagonal = item[some], place[some], diagonal[some]
        band = (diagonal + self.longest) // (kind.k[item] + 1)
        stride = len(x) + 2 * self.longest + 2
        # Each shared q-gram counts in its own band and the one before, which overlap.
        key = np.concatenate([item * stride + band, item * stride + np.maximum(band - 1, 0)])
        keys, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
        enough = (counts >= kind.bound[keys // stride])[inverse]
        if not enough.any():
            return []
        # A q-gram of the item counts once, however often the text repeats it.
        wide = self.longest + 1
        inverse, place = np.divmod(np.unique(inverse[enough] * wide + np.tile(place, 2)[enough]), wide)
        # The windows that hold each q-gram: a run of those of its item.
        item = keys[inverse] // stride
        order = kind.item * wide + kind.at
        low = np.searchsorted(order, item * wide + np.maximum(place + self.q - kind.size[item], 0))
        n = np.maximum(np.searchsorted(order, item * wide + place, side="right") - low, 0)
        window = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        pairs, counts = np.unique(np.repeat(inverse, n) * len(order) + window, return_counts=True)
        enough = counts >= kind.bound[kind.item[pairs % len(order)]]
        found: dict[int, tuple[int, int, int]] = {}
        for pair in pairs[enough]:
            w, b = int(pair % len(order)), int(keys[pair // len(order)] % stride)
            if w in found and found[w][0] == 0:
                continue
            win = self._window(kind, w)
            first = win.at - self.longest + b * (win.k + 1)
            low, high = max(0, first - win.k), min(len(x), first + 2 * (win.k + 1) + len(win.codes) + win.k)
            part = x[low:high]
            got = _equal(win.codes, part) or (align(win.codes, part, win.k) if win.k else None)
            # The band of an unedited place begins with it, so no other place of the band is lost here.
            if got and len(win.codes) < MIN_CHARS and (_in_word(x, low + got[1]) or _in_word(x, low + got[2])):
                continue
            if got and (w not in found or got[0] < found[w][0]):
                found[w] = (got[0], low + got[1], low + got[2])
        return [(self._window(kind, w), *f) for w, f in found.items()]


class _Blocks:
    """The items in blocks of bounded size, gathered one by one."""

    def __init__(self, benchmark: DataFrame):
        self._items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
        n, chars = self._items.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
        # Parts by hash are uneven, so they are planned at half of the bound.
        self.parts = max(1, -(-2 * n // BLOCK_ITEMS), -(-2 * chars // BLOCK_CHARS)) if n > BLOCK_ITEMS or chars > BLOCK_CHARS else min(n, 1)

    def get(self, p: int) -> list[tuple[int | None, str | None]]:
        part = F.pmod(F.xxhash64("item_id", "text"), F.lit(self.parts))
        return sorted(((r[0], r[1]) for r in self._items.filter(part == p).collect()), key=str)


_FOUND = "doc_id long, item_id long, item_at long, edits long, start long, end long"


def find_passages(documents: DataFrame, benchmark: DataFrame, edits: float = EDITS) -> DataFrame:
    """Each window of an item found in a document: where in both, and with how many edits.

    With several blocks, what each finds is written before the next is gathered.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty().alias("text"))
    spark = documents.sparkSession

    def search(items):
        shared = _send(spark, items)

        def work(batches):
            index = _index(shared, edits)
            for whole in batches:
                for at in range(0, whole.num_rows, _ROWS):
                    batch = whole.slice(at, _ROWS)
                    out = [
                        (d, w.item_id, w.at, e, a, b)
                        for d, text in zip(column(batch, "doc_id"), column(batch, "text"))
                        for w, e, a, b in index.find(text)
                    ]
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*out)], [x.split()[0] for x in _FOUND.split(", ")])

        return shared, docs.mapInArrow(work, _FOUND)

    blocks, found = _Blocks(benchmark), []
    if blocks.parts == 1:
        return search(blocks.get(0))[1]
    for p in range(blocks.parts):
        shared, some = search(blocks.get(p))
        found.append(common.write_table(some, "passages"))
        shared.destroy()
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], _FOUND)


def _send(spark: SparkSession, items):
    return spark.sparkContext.broadcast((uuid.uuid4().hex, items))


_indexes: dict[tuple[str, float], Index] = {}


def _index(shared, edits: float) -> Index:
    """The block's index, made once in each Python worker; the last one is kept."""
    name, items = shared.value
    if (name, edits) not in _indexes:
        _indexes.clear()
        _indexes[name, edits] = Index(items, edits)
    return _indexes[name, edits]


def contaminated(documents: DataFrame, benchmark: DataFrame, edits: float = EDITS) -> DataFrame:
    """One row for each document and item: windows found, least edits, and the extent in the text."""
    return find_passages(documents, benchmark, edits).groupBy("doc_id", "item_id").agg(
        F.countDistinct("item_at").alias("n_windows"), F.min("edits").alias("edits"), F.min("start").alias("start"), F.max("end").alias("end")
    )


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, edits: float = EDITS) -> DataFrame:
    """The documents without any benchmark passage, with all their columns.

    The decision is made where the row lies: no join, and rows without an id are judged too.
    With several blocks, what each but the last leaves is written.
    """
    spark, out, blocks = documents.sparkSession, documents, _Blocks(benchmark)
    for p in range(blocks.parts):
        shared = _send(spark, blocks.get(p))
        out = out.filter(~_has_passage(shared, edits)(F.coalesce(F.col("text").cast("string"), F.lit(""))))
        if p + 1 < blocks.parts:
            out = common.write_table(out, "left")
            shared.destroy()
    return out


def _has_passage(shared, edits: float):
    @F.pandas_udf("boolean")
    def has(texts: pd.Series) -> pd.Series:
        index = _index(shared, edits)
        return texts.map(lambda t: bool(index.find(t))).astype(bool)

    return has


def op5_decontam_qgram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"))
