"""Best-fit packing of documents into sequences, after dominance reduction.

Sizes are whole numbers up to the capacity, so the packing problem is a
histogram: at most ``capacity`` counts, whatever the corpus is. It is solved as
one, with equal bins held as a pattern and a count. Documents then find their
place by their rank among pieces of equal length.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointerloom.llm.common import portions, texts_of, written
from pointerloom.llm.encoding import encoder

CAPACITY = 4096

Pattern = tuple[tuple[int, int], ...]


def _below(counts: np.ndarray, limit: int) -> int:
    """The largest size that is left and at most ``limit``, 0 if none."""
    found = np.flatnonzero(counts[1 : limit + 1])
    return int(found[-1]) + 1 if len(found) else 0


def _smallest_sum(counts: np.ndarray, items: int) -> int:
    """Sum of the ``items`` smallest sizes left; more than any capacity if there are fewer."""
    total = 0
    for size in np.flatnonzero(counts)[:items]:
        take = min(items, int(counts[size]))
        total, items = total + int(size) * take, items - take
        if not items:
            return total
    return 2 * len(counts) + total


def _best_pair(counts: np.ndarray, limit: int) -> int:
    """Largest sum of two items that is at most ``limit``, 0 if there is none."""
    sizes = np.flatnonzero(counts[: limit + 1])
    sizes = sizes[sizes > 0]
    if not len(sizes):
        return 0
    at = np.searchsorted(sizes, limit - sizes, side="right") - 1
    # An item that stands alone cannot be its own partner.
    alone = (at >= 0) & (sizes[at] == sizes) & (counts[sizes] < 2)
    at = at - alone
    sums = np.where(at >= 0, sizes + sizes[at], 0)
    return int(sums.max())


def reduce_instance(counts: np.ndarray, capacity: int) -> list[tuple[Pattern, int]]:
    """Fix bins that dominate every other bin of their largest item; lowers ``counts``.

    For an item s with b the largest other item that fits beside it, {s, b}
    dominates if b fills the bin; if no two others fit beside s; or if no three
    do and no two sum to more than b. {s} dominates if nothing fits. Each holds
    for the instance as it is then, so fixed bins are part of an optimal packing.
    """
    fixed: list[tuple[Pattern, int]] = []
    for s in range(capacity, 0, -1):
        while counts[s]:
            counts[s] -= 1
            room = capacity - s
            b = _below(counts, room)
            if not b:
                counts[s] += 1
                # Nothing left fits beside it; two of its own size do not fit either.
                times = int(counts[s])
                counts[s] = 0
                fixed.append((((s, 1),), times))
                break
            wins = (
                b == room
                or _smallest_sum(counts, 2) > room
                or (_smallest_sum(counts, 3) > room and b >= _best_pair(counts, room))
            )
            counts[s] += 1
            if not wins:
                break
            if b == s:
                times = int(counts[s]) // 2
                counts[s] -= 2 * times
                fixed.append((((s, 2),), times))
            else:
                # Items taken away only raise the smallest sums and lower the best
                # pair, and b stays the largest that fits: {s, b} dominates until
                # one of both is used up.
                times = int(min(counts[s], counts[b]))
                counts[s] -= times
                counts[b] -= times
                fixed.append((((s, 1), (b, 1)), times))
    return fixed


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing over a histogram; equal open bins are filled together."""
    open_bins: dict[int, list[tuple[Pattern, int]]] = defaultdict(list)
    used = np.zeros(capacity + 1, dtype=bool)
    done: list[tuple[Pattern, int]] = []

    def put(room: int, pattern: Pattern, times: int) -> None:
        if room:
            open_bins[room].append((pattern, times))
            used[room] = True
        else:
            done.append((pattern, times))

    for s in range(capacity, 0, -1):
        left = int(counts[s])
        while left:
            fits = np.flatnonzero(used[s:])
            room = int(fits[0]) + s if len(fits) else capacity
            pattern, times = open_bins[room].pop() if len(fits) else ((), left)
            if len(fits) and not open_bins[room]:
                used[room] = False
            each = room // s
            full = min(times, left // each)
            if full:
                put(room - each * s, (*pattern, (s, each)), full)
            left -= full * each
            if len(fits) and full < times:
                rest = times - full
                if left:
                    put(room - left * s, (*pattern, (s, left)), 1)
                    left, rest = 0, rest - 1
                if rest:
                    put(room, pattern, rest)
            elif not len(fits) and left:
                put(room - left * s, ((s, left),), 1)
                left = 0
        counts[s] = 0
    return done + [b for bins in open_bins.values() for b in bins]


def pack_histogram(counts: np.ndarray, capacity: int) -> list[tuple[Pattern, int]]:
    """Patterns of (size, copies) and how many sequences have each."""
    left = np.array(counts, dtype=np.int64)
    return reduce_instance(left, capacity) + best_fit(left, capacity)


def places(patterns: list[tuple[Pattern, int]], capacity: int) -> dict[str, np.ndarray]:
    """Where pieces go: rows by size and first rank, for a search by (size, rank)."""
    ranks = np.zeros(capacity + 1, dtype=np.int64)
    rows, sequence = [], 0
    for pattern, times in patterns:
        offset = 0
        for size, copies in pattern:
            rows.append((size, ranks[size], sequence, copies, offset))
            ranks[size] += times * copies
            offset += size * copies
        sequence += times
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return dict(zip(("size", "rank", "sequence", "copies", "offset"), table.T))


PIECES = (
    "slice int, doc_id long, piece int, start long, length long, ids_crc32 long, place long"
)


def _cut(tokenizer: str, end_id: int, capacity: int):
    names = [x.split()[0] for x in PIECES.split(", ")]
    kinds = [pa.int32(), pa.int64(), pa.int32()] + [pa.int64()] * 4

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(tokenizer)
        slice_, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in portions(batches):
            rows = []
            keys = batch.column("doc_id").to_pylist()
            for key, ids in zip(keys, code.encode(texts_of(batch, "text"))):
                data = np.frombuffer(ids, dtype=code.dtype).astype("<u4").tobytes() + end
                total = len(data) // 4
                for piece, low in enumerate(range(0, total, capacity)):
                    length = min(capacity, total - low)
                    crc = zlib.crc32(data[low * 4 : (low + length) * 4])
                    rows.append((slice_, key, piece, low, length, crc, seen[length]))
                    seen[length] += 1
            columns = list(zip(*rows)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=k) for c, k in zip(columns, kinds)], names=names
            )

    return cut


def best_fit_pack(
    docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY
) -> DataFrame:
    """Pack whole documents into sequences of at most ``capacity`` tokens.

    One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id,
    offset``. Only documents longer than a sequence are cut. Texts are read and
    encoded once, where they lie; what is shuffled is a count per slice and
    length. The driver sees at most ``capacity`` counts.

    Null texts are empty and still get a piece (their end id). Repeated rows are
    packed each. An empty table gives no rows. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    pieces = written(rows.mapInArrow(_cut(tokenizer, end_id, capacity), PIECES), "pieces")
    sizes = pieces.groupBy("slice", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[r.length] = r.n
    table = places(pack_histogram(counts, capacity), capacity)
    before = Window.partitionBy("length").orderBy("slice").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    shifts = sizes.select(
        "slice", "length", (F.sum("n").over(before) - F.col("n")).alias("shift")
    )
    ranked = pieces.join(shifts, ["slice", "length"]).select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("shift") + F.col("place")).alias("rank"),
    )
    out = ranked.drop("rank").schema.add("sequence_id", "long").add("offset", "long")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Size and rank as one sortable number: ranks stay below 2 ** 48.
        key = (table["size"] << 48) + table["rank"]
        for batch in batches:
            size = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            at = np.searchsorted(key, (size << 48) + rank, side="right") - 1
            nth = rank - table["rank"][at]
            copies = table["copies"][at]
            sequence = table["sequence"][at] + nth // copies
            offset = table["offset"][at] + nth % copies * size
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(sequence), pa.array(offset)], names=out.names
            )

    return ranked.mapInArrow(assign, out)
