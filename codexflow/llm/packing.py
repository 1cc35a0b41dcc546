"""Best-fit packing after Martello-Toth dominance reduction.

The corpus is reduced to a histogram of piece lengths, at most ``capacity``
counts, whatever its size. On that histogram the driver first fixes sets that
dominate every alternative (Martello and Toth's procedure, many equal sets at
once), then places the rest by best-fit decreasing. The outcome is a short list
of slots "ranks a to b of length w go to sequences from s at offset o"; each
piece finds its slot from its rank within its length. Ranks are a piece's
number within its input partition plus the counts of the partitions before, so
no length, however common, is gathered anywhere.

Nulls and edges: a null text is the empty text (the end id alone). Rows that
share a ``doc_id``, or have none, are packed each for itself. An empty table
packs to none. Other columns of the input are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codexflow.llm import common
from codexflow.llm.encode import BYTE, END_ID, column, encoder, tokenizer_path

CAPACITY = 1024

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, chunk int, local_rank long, ids binary"


@dataclass
class _Bins:
    """``count`` equal bins: lengths with how many of each, in order of offset."""

    count: int
    items: list[tuple[int, int]] = field(default_factory=list)

    def used(self) -> int:
        return sum(w * n for w, n in self.items)


def _largest(left: list[int], at_most: int) -> int:
    while at_most > 0 and not left[at_most]:
        at_most -= 1
    return max(at_most, 0)


def _smallest_sums(left: list[int]) -> tuple[int, int]:
    """The sums of the smallest two and three items; very large if there are fewer."""
    found: list[int] = []
    for w, n in enumerate(left):
        if w and n:
            found += [w] * min(n, 3)
            if len(found) >= 3:
                break
    found += [len(left)] * 3
    return sum(found[:2]), sum(found[:3])


def reduce_dominated(left: list[int], capacity: int) -> list[_Bins]:
    """Fix sets around the largest item that dominate all other sets with it.

    ``left[w]`` is the number of items of length w and is reduced. A set
    dominates another if the other's items can be dealt into groups that each
    fit in one of its items' room. For largest item j and the largest i that
    fits beside it: {j} if nothing fits, {j, i} if i fills the bin or no two
    items fit beside j, or if i is at least the sum of any two that do and no
    three do. The procedure goes down through all j, since bins without j leave j's own
    alternatives as they are.
    """
    fixed = []
    for j in range(capacity, 0, -1):
        while left[j]:
            left[j] -= 1
            room = capacity - j
            i = _largest(left, room)
            if i == 0:
                fixed.append(_Bins(1 + left[j], [(j, 1)]))
                left[j] = 0
                break
            three = _smallest_sums(left)
            if not (i == room or three[0] > room or three[1] > room and i >= _best_pair(left, room)):
                left[j] += 1
                break
            # The same choice holds for as many as both lengths last.
            left[j] += 1
            times = min(left[j], left[i]) if i != j else left[j] // 2
            if not times:
                break
            left[j] -= times
            left[i] -= times
            fixed.append(_Bins(times, [(j, 2)] if i == j else [(j, 1), (i, 1)]))
    return fixed


def _best_pair(left: list[int], room: int) -> int:
    """The largest sum of two items that fit in ``room``; 0 if none do."""
    best = 0
    low, high = 1, room - 1
    while low <= high:
        if not left[low] or low == high and left[low] < 2:
            low += 1
        elif not left[high]:
            high -= 1
        elif low + high > room:
            high -= 1
        else:
            best = max(best, low + high)
            low += 1
    return best


def best_fit(left: list[int], capacity: int) -> list[_Bins]:
    """Best-fit decreasing on counts: equal bins are kept as one entry."""
    by_room: dict[int, list[_Bins]] = defaultdict(list)
    for w in range(capacity, 0, -1):
        while left[w]:
            room = next((r for r in range(w, capacity + 1) if by_room.get(r)), None)
            if room is None:
                each = capacity // w
                count, rest = divmod(left[w], each)
                made = [_Bins(count, [(w, each)])] if count else []
                made += [_Bins(1, [(w, rest)])] if rest else []
                left[w] = 0
            else:
                old = by_room[room].pop()
                each = room // w
                count = min(old.count, left[w] // each)
                made = [_Bins(count, [*old.items, (w, each)])] if count else []
                rest = min(left[w] - count * each, each - 1) if count < old.count else 0
                made += [_Bins(1, [*old.items, (w, rest)])] if rest else []
                if (kept := old.count - count - bool(rest)) > 0:
                    made.append(_Bins(kept, old.items))
                left[w] -= count * each + rest
            for b in made:
                by_room[capacity - b.used()].append(b)
    return [b for bins in by_room.values() for b in bins]


def pack_lengths(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Slots ``(length, rank from, rank to, first sequence, per sequence, offset)``.

    Every rank of every length has one slot; sequences are numbered from 0.
    """
    left = [0] * (capacity + 1)
    for w, n in counts.items():
        left[w] = n
    bins = reduce_dominated(left, capacity)
    bins += best_fit(left, capacity)
    slots, sequence, next_rank = [], 0, defaultdict(int)
    for b in bins:
        offset = 0
        for w, each in b.items:
            rank = next_rank[w]
            slots.append((w, rank, rank + each * b.count, sequence, each, offset))
            next_rank[w] = rank + each * b.count
            offset += w * each
        sequence += b.count
    return sorted(slots)


def cut_pieces(documents: DataFrame, tokenizer: str = BYTE, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Each document's pieces: whole if it fits, else ``capacity`` ids each but the first.

    ``chunk`` is the input partition and ``local_rank`` the number of pieces of
    the same length before in it, so the outcome must be written before use.
    ``ids`` (little-endian unsigned 32 bits) is filled only if asked for.
    """
    path = tokenizer_path(tokenizer)

    def encode(batches):
        e = encoder(path, tokenizer)
        chunk, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            out = []
            for d, text in zip(column(batch, "doc_id"), column(batch, "text")):
                ids = np.append(e.ids(text), END_ID).astype("<u4")
                first = len(ids) if len(ids) <= capacity else len(ids) % capacity or capacity
                ends = range(first, len(ids) + 1, capacity)
                for piece, end in enumerate(ends):
                    start = 0 if piece == 0 else end - capacity
                    data = ids[start:end].tobytes()
                    n = end - start
                    out.append((d, piece, start, n, zlib.crc32(data), chunk, int(seen[n]), data if with_ids else None))
                    seen[n] += 1
            columns = list(zip(*out)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, _TYPES)], _NAMES)
        e.forget()

    docs = documents.select(F.col("doc_id").cast("long"), common.text_or_empty().alias("text"))
    return docs.mapInArrow(encode, _PIECES)


_NAMES = [x.split()[0] for x in _PIECES.split(", ")]
_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]


def place_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a written table of pieces.

    The driver gets at most ``capacity`` counts. Counts by partition and length
    are summed over the partitions before by a window within each length.
    """
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = np.array(pack_lengths(counts, capacity), dtype=np.int64).reshape(-1, 6)
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        pieces.groupBy("chunk", "length").agg(F.count("*").alias("n"))
        .select("chunk", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    )
    keys, span = slots[:, 0], int(slots[:, 2].max(initial=0)) + 1
    found = keys * span + slots[:, 1]

    @F.pandas_udf("sequence_id long, offset long")
    def place(length, rank):
        import pandas as pd

        w, r = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        s = slots[np.searchsorted(found, w * span + r, side="right") - 1]
        nth = r - s[:, 1]
        return pd.DataFrame({"sequence_id": s[:, 3] + nth // s[:, 4], "offset": s[:, 5] + nth % s[:, 4] * w})

    ranked = pieces.join(bases, ["chunk", "length"]).withColumn("at", place("length", F.col("base") + F.col("local_rank")))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset", "ids")


def pack_documents(documents: DataFrame, tokenizer: str = BYTE, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pack all documents; one row a piece, with its ids if asked for."""
    pieces = common.write_table(cut_pieces(documents, tokenizer, capacity, with_ids), "pieces")
    placed = place_pieces(pieces, capacity)
    return placed if with_ids else placed.drop("ids")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences' ids, from pieces with ids: at most ``capacity`` ids a row."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.expr("aggregate({0}, X'', (a, x) -> concat(a, x.ids))".format("array_sort(collect_list(struct(offset, ids)))")).alias("ids"), F.size(parts).alias("n_pieces"))


def op6_pack_dominance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(common.read(spark, sf_dir, "documents"))
