"""Exact Jaccard join of documents on word shingles, by T-occurrence search.

A document of n shingles shares at least T = ceil(0.8 n) of them with every
partner. As in DivideSkip, the T - 1 longest inverted lists of a document are
set aside, and whatever reaches T must then occur in one of the n - T + 1
short ones. Short lists are merged by a heap, which counts how often each candidate
occurs; the long lists are probed by binary search, here in the candidate's
sorted shingles, which are these lists turned by document, until the overlap is
reached or out of reach.

Which lists are short is told by counts over the whole corpus: shingles more
common than ``COMMON`` come last in the order of all. Lists that stay long,
because a family of near copies has nothing rarer, are not opened into pairs:
members are compared with one of them, and then only those that are not
connected yet, where what is left of both from that list on can still reach the
overlap. Components need no more; no link between two is lost.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointerloom.llm.common import portions, release, texts_of, written
from pointerloom.llm.graph import components, contiguous

WORDS = 5
# Likeness of 80 / 100 as whole numbers.
PART, WHOLE = 80, 100

#: A shingle in more documents than this is common.
COMMON = 24
#: The most common shingles that are told apart, which bounds what tasks are sent.
MOST_COMMON = 2_000_000
#: Lists up to this length are merged; of longer ones only members not yet connected meet.
SHORT_LIST = 24
#: Rounds in which long lists meet one member, before all that are left meet each other.
STAR_ROUNDS = 2
#: Lists above this many rows are compared on Spark, in blocks of as many rows.
LIST_ROWS = 10_000
FLUSH = 1_000_000
COUNT_BLOCKS = 256
#: Ids of candidates are broadcast up to this many, and joined by a shuffle beyond.
BROADCAST_IDS = 1_000_000

MIX = np.uint64(0x9E3779B97F4A7C15)
TURN = np.uint64(29)


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles of a text.

    Words are runs without ASCII white space, A-Z in lower case. Fewer words are
    one shingle; no words, none.
    """
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=n)
    width = min(n, WORDS)
    mixed = np.full(n - width + 1, width, dtype=np.uint64)
    for k in range(width):
        mixed = (mixed ^ hashes[k : n - width + 1 + k]) * MIX
        mixed ^= mixed >> TURN
    return np.unique(mixed)


def needed(n: int) -> int:
    """Least overlap with any partner of a set of n."""
    return -(-PART * n // WHOLE)


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers compressed plane by plane; sorted ones are best given as steps."""
    planes = values.view(np.uint8).reshape(len(values), -1).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _opened(data: bytes, dtype: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).reshape(-1).view(dtype)


def _batch(schema: pa.Schema, rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


SETS = pa.schema(
    [("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_id", pa.binary()),
     ("block", pa.int32()), ("counts", pa.binary())]
)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size and identity of every set, and how often shingles occur in this partition.

    Counts go by the upper 32 bits of the hashes, which bounds their table. Sets
    met before in the partition are not counted again.
    """
    release()
    seen: set[bytes] = set()
    held: list[np.ndarray] = []
    size = 0

    def flush() -> pa.RecordBatch:
        values, times = np.unique(np.concatenate(held), return_counts=True)
        edges = contiguous(values >> np.uint32(24))
        rows = []
        for low, high in zip(edges[:-1].tolist(), edges[1:].tolist()):
            part = values[low:high]
            steps = np.diff(part, prepend=part[:1] & np.uint32(0xFF000000)).astype("<u4")
            few = np.minimum(times[low:high], 65535).astype("<u2")
            data = _packed(steps)
            head = np.array([len(data)], "<u4").tobytes()
            rows.append({"block": int(part[0] >> 24), "counts": head + data + _packed(few)})
        return _batch(SETS, rows)

    for batch in portions(batches):
        rows = []
        for key, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch, "text")):
            found = shingles(text)
            digest = xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None
            rows.append({"doc_id": key, "n_shingles": len(found), "set_id": digest})
            if digest is not None and digest not in seen:
                seen.add(digest)
                held.append((found >> np.uint64(32)).astype(np.uint32))
                size += len(found)
        yield _batch(SETS, rows)
        if size >= FLUSH:
            yield flush()
            held, size = [], 0
    if size:
        yield flush()


def _sum_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Common values of the blocks of a partition."""
    sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    waiting: dict[int, list] = defaultdict(list)

    def settle(block: int) -> None:
        parts = waiting.pop(block) + ([sums[block]] if block in sums else [])
        values = np.concatenate([v for v, _ in parts])
        times = np.concatenate([t for _, t in parts])
        unique, at = np.unique(values, return_inverse=True)
        sums[block] = unique, np.bincount(at, times).astype(np.int64)

    for batch in batches:
        for block, data in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist()):
            split = 4 + int(np.frombuffer(data[:4], "<u4")[0])
            steps = _opened(data[4:split], "<u4").astype(np.uint64)
            values = np.cumsum(steps) + np.uint64(block << 24)
            waiting[block].append((values, _opened(data[split:], "<u2").astype(np.int64)))
            if sum(len(v) for v, _ in waiting[block]) > FLUSH:
                settle(block)
    for block in list(waiting):
        settle(block)
    for values, times in sums.values():
        often = times > COMMON
        yield pa.RecordBatch.from_arrays(
            [pa.array(values[often].astype(np.int64)), pa.array(times[often])],
            names=["value", "times"],
        )


POSTINGS = pa.schema([("block", pa.int32()), ("postings", pa.binary())])


def _short_lists(values: np.ndarray, ranks: np.ndarray, blocks: int):
    """Postings of the n - T + 1 rarest shingles of every set, in blocks by shingle.

    The place of a common shingle in the order of its set goes along; others,
    whose lists are short, have 0, which promises nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        seen: set[bytes] = set()
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            tokens = np.concatenate([t for t, _, _, _ in held])
            places = np.concatenate([p for _, p, _, _ in held])
            counts = [len(t) for t, _, _, _ in held]
            docs = np.repeat([d for _, _, d, _ in held], counts)
            sizes = np.repeat([n for _, _, _, n in held], counts)
            block = (tokens % np.uint64(blocks)).astype(np.int64)
            order = np.lexsort((tokens, block))
            edges = contiguous(block[order])
            rows = []
            for low, high in zip(edges[:-1].tolist(), edges[1:].tolist()):
                at = order[low:high]
                parts = [
                    _packed(tokens[at].astype("<u8")),
                    _packed(docs[at].astype("<i8")),
                    _packed(sizes[at].astype("<u4")),
                    _packed(places[at].astype("<u4")),
                ]
                head = np.array([len(p) for p in parts], "<u4").tobytes()
                rows.append({"block": int(block[at[0]]), "postings": head + b"".join(parts)})
            return _batch(POSTINGS, rows)

        for batch in portions(batches):
            for key, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch, "text")):
                found = shingles(text)
                n = len(found)
                digest = xxhash.xxh3_128_digest(found.tobytes())
                if not n or digest in seen:
                    continue
                seen.add(digest)
                prefix = n - needed(n) + 1
                places_in = np.zeros(prefix, dtype=np.int64)
                if len(values):
                    upper = (found >> np.uint64(32)).astype(np.int64)
                    at = np.minimum(np.searchsorted(values, upper), len(values) - 1)
                    common = np.where(values[at] == upper, ranks[at], 0)
                    order = np.argsort(common, kind="stable")
                    found, common = found[order], common[order]
                    places_in = np.where(common > 0, np.arange(n), 0)[:prefix]
                held.append((found[:prefix], places_in, key, n))
                size += len(held[-1][0])
                if size >= FLUSH:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return run


def merge_short(lists: list[list[int]]) -> dict[int, int]:
    """How many of some ascending lists hold each document, by a heap of their heads."""
    if len(lists) == 1:
        return dict.fromkeys(lists[0], 1)
    counts: dict[int, int] = defaultdict(int)
    for doc in heapq.merge(*lists):
        counts[doc] += 1
    return counts


FOUND = pa.schema(
    [("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("m", pa.int64()),
     ("times", pa.int64()), ("list", pa.int64()), ("doc", pa.int64()), ("size", pa.int64()),
     ("place", pa.int64())]
)
LISTS = ("list", "doc", "size", "place", "component")


def _merge_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate pairs from the short lists of a partition; long lists as they are."""
    release()
    parts = []
    for batch in batches:
        for data in batch.column("postings").to_pylist():
            sizes = np.frombuffer(data[:16], "<u4").tolist()
            cuts = np.cumsum([16, *sizes]).tolist()
            kinds = ("<u8", "<i8", "<u4", "<u4")
            parts.append([_opened(data[a:b], k) for a, b, k in zip(cuts, cuts[1:], kinds)])
    if not parts:
        return
    tokens, docs, sizes, places = (np.concatenate([p[k] for p in parts]) for k in range(4))
    # Texts that repeat an id are told apart by their sizes: ascending numbers for both.
    order = np.lexsort((sizes, docs))
    new = np.ones(len(docs), dtype=bool)
    new[1:] = (np.diff(docs[order]) != 0) | (sizes[order][1:] != sizes[order][:-1])
    doc_of, size_of = docs[order][new].tolist(), sizes[order][new].tolist()
    codes = np.empty(len(docs), dtype=np.int64)
    codes[order] = np.cumsum(new) - 1
    order = np.lexsort((codes, tokens))
    tokens, docs, sizes, places = tokens[order], docs[order], sizes[order], places[order]
    codes = codes[order]
    edges = contiguous(tokens)
    lists_of: dict[int, list] = defaultdict(list)
    rows: list[dict] = []
    long_lists: dict[int, tuple] = {}
    long = np.flatnonzero(np.diff(edges) > 1)
    for k in long.tolist():
        low, high = int(edges[k]), int(edges[k + 1])
        if high - low <= SHORT_LIST:
            members = codes[low:high].tolist()
            for i, code in enumerate(members[:-1]):
                lists_of[code].append(members[i + 1 :])
            continue
        # Lists with the same members are one, with each member's least place.
        who = xxhash.xxh3_64_intdigest(docs[low:high].tobytes() + sizes[low:high].tobytes())
        if who in long_lists:
            at, least, times = long_lists[who]
            long_lists[who] = at, np.minimum(least, places[low:high]), times + 1
        else:
            long_lists[who] = slice(low, high), places[low:high], 1
    for who, (at, least, times) in long_lists.items():
        name = int(np.uint64(who).astype(np.int64))
        rows += [
            {"list": name, "doc": d, "size": n, "place": p, "times": times}
            for d, n, p in zip(docs[at].tolist(), sizes[at].tolist(), least.tolist())
        ]
        if len(rows) > 100_000:
            yield _batch(FOUND, rows)
            rows = []
    for code, lists in lists_of.items():
        a, n = doc_of[code], size_of[code]
        for other, times in merge_short(lists).items():
            b, m = doc_of[other], size_of[other]
            if a != b and WHOLE * min(n, m) >= PART * max(n, m):
                rows.append({"a": a, "b": b, "n": n, "m": m, "times": times})
        if len(rows) > 100_000:
            yield _batch(FOUND, rows)
            rows = []
    yield _batch(FOUND, rows)


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    for batch in portions(batches):
        data = [shingles(t).tobytes() for t in texts_of(batch, "text")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(data, type=pa.binary())], names=["doc", "shingles"]
        )


def reaches(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets are alike enough; the smaller is probed in the larger, part by part."""
    if len(a) > len(b):
        a, b = b, a
    # 100 * common >= 80 * (all - common)
    least = -(-PART * (len(a) + len(b)) // (PART + WHOLE))
    if not len(a) or len(a) < least:
        return False
    common, step = 0, max(64, len(a) // 4)
    for low in range(0, len(a), step):
        part = a[low : low + step]
        at = np.searchsorted(b, part)
        at[at == len(b)] = len(b) - 1
        common += int((b[at] == part).sum())
        if common >= least:
            return True
        if common + len(a) - low - len(part) < least:
            return False
    return False


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    for batch in batches:
        # Sets are compared where Arrow holds them, without copies.
        pairs = zip(batch.column("left"), batch.column("right"))
        keep = [
            reaches(*(np.frombuffer(s.as_buffer(), np.uint64) for s in pair)) for pair in pairs
        ]
        yield batch.select(["a", "b"]).filter(pa.array(keep, type=pa.bool_()))


def _other_copies(sets: DataFrame, same: DataFrame) -> DataFrame:
    """``doc_id`` of documents all of whose sets a smaller id has too.

    ``same`` links equal sets ``a`` with their smallest id ``b``. An id with several texts
    counts only if each of them is such a copy.
    """
    later = same.where("a > b").groupBy(F.col("a").alias("doc_id")).agg(F.count("*").alias("copied"))
    rows = sets.join(later, "doc_id").groupBy("doc_id").agg(
        F.count("*").alias("all"), F.min("copied").alias("copied")
    )
    return written(rows.where("copied >= all").select("doc_id"), "other")


def _sized(ids: DataFrame) -> DataFrame:
    """A written table of ids, broadcast where there are few enough."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _without(rows: DataFrame, ids: DataFrame) -> DataFrame:
    return rows.join(_sized(ids), "doc_id", "left_anti")


def _linked(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of ``pairs(a, b)`` that are alike enough."""
    ids = written(
        pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "candidates"
    )
    chosen = _sized(ids)
    sets = rows.join(chosen, "doc_id", "left_semi").mapInArrow(
        _set_rows, "doc long, shingles binary"
    )
    sets = written(sets, "sets")
    left = sets.select(F.col("doc").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("doc").alias("b"), F.col("shingles").alias("right"))
    return pairs.join(left, "a").join(right, "b").mapInArrow(_verify, "a long, b long")


def _can_be_alike(sizes, places, size, place, last: bool):
    """Whether sets can be alike; of arrays with numbers, or of columns with columns.

    In the last round only those that can be if this list is the first they share:
    they share no more than what each has from here on. The first list that two
    alike sets share passes, so none are lost.
    """
    least, most = (F.least, F.greatest) if isinstance(size, Column) else (np.minimum, np.maximum)
    near = least(sizes, size) * WHOLE >= most(sizes, size) * PART
    if last:
        near &= least(sizes - places, size - place) * (PART + WHOLE) >= (sizes + size) * PART
    return near


def _distinct(held: list[tuple]) -> tuple[np.ndarray, ...]:
    a, b = (np.concatenate(c) for c in zip(*held))
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


def _pair_batches(pairs: Iterator[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    """Pairs as batches; what is held is bounded, also inside a list."""
    held: list[tuple] = []
    size = 0

    def batch_of(columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b"])

    for a, b in pairs:
        if not len(a):
            continue
        held.append((a, b))
        size += len(a)
        if size >= FLUSH:
            held = [_distinct(held)]
            size = len(held[0][0])
            if size >= FLUSH // 2:
                yield batch_of(held[0])
                held, size = [], 0
    if held:
        yield batch_of(_distinct(held))


def _groups(batches: Iterator[pa.RecordBatch], keys: int, names: tuple) -> Iterator[list]:
    """Columns behind the first ``keys`` of rows sorted by those, a group at a time."""
    name, members = None, []
    for batch in batches:
        columns = [batch.column(c).to_numpy() for c in names]
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, dtype=bool)
        for c in columns[:keys]:
            new[1:] |= c[1:] != c[:-1]
        edges = np.r_[0, np.flatnonzero(new), len(new)]
        for low, high in zip(edges[:-1].tolist(), edges[1:].tolist()):
            here = tuple(c[low] for c in columns[:keys])
            if members and here != name:
                yield [np.concatenate(c) for c in zip(*members)]
                members = []
            name = here
            members.append([c[low:high] for c in columns[keys:]])
    if members:
        yield [np.concatenate(c) for c in zip(*members)]


def _open_lists(last: bool):
    """Pairs of members of a long list that are not connected; rows sorted by list.

    One member of each list's largest component meets the others, or, in the last
    round, every member outside of that component meets all that are not connected
    with it and can be alike. Two of different components are not both inside.
    """

    def pairs_of(docs, sizes, places, comps) -> Iterator[tuple[np.ndarray, ...]]:
        names, counts = np.unique(comps, return_counts=True)
        if len(names) < 2:
            return
        inside = comps == names[counts.argmax()]
        chosen = np.flatnonzero(~inside).tolist()
        if not last:
            largest = np.flatnonzero(inside)
            chosen = [int(largest[int(docs.sum()) % len(largest)])]
        for i in chosen:
            near = _can_be_alike(sizes, places, sizes[i], places[i], last)
            near &= (comps != comps[i]) & ((docs > docs[i]) | inside | (not last))
            others = docs[near]
            yield np.minimum(others, docs[i]), np.maximum(others, docs[i])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = _groups(batches, 1, LISTS)
        return _pair_batches(pair for columns in lists for pair in pairs_of(*columns))

    return run


CELLS = ("list", "i", "j", "doc", "size", "place", "component", "asks", "outside")


def _open_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of members outside of the largest component with a block of their list."""

    def pairs_of(docs, sizes, places, comps, asks, outside) -> Iterator[tuple[np.ndarray, ...]]:
        asks, outside = asks > 0, outside > 0
        askers = np.flatnonzero(asks).tolist()
        docs_in, sizes, sizes_of = docs[~asks], sizes[~asks], sizes
        places, places_of = places[~asks], places
        comps_in, outside = comps[~asks], outside[~asks]
        for i in askers:
            near = _can_be_alike(sizes, places, sizes_of[i], places_of[i], True)
            near &= (comps_in != comps[i]) & ((docs_in > docs[i]) | ~outside)
            others = docs_in[near]
            yield np.minimum(others, docs[i]), np.maximum(others, docs[i])

    cells = _groups(batches, 3, CELLS)
    return _pair_batches(pair for columns in cells for pair in pairs_of(*columns))


def _open_hot_lists(placed: DataFrame, last: bool) -> DataFrame:
    """Like ``_open_lists``, of lists too long for a task: Spark deals out their rows.

    Only tables with a row per such list, of which there is at most one for
    ``LIST_ROWS`` rows, are broadcast.
    """
    counts = placed.groupBy("list", "component").agg(F.count(F.lit(1)).alias("n"))
    top = counts.groupBy("list").agg(
        F.max_by("component", F.struct("n", "component")).alias("top"),
        F.sum("n").alias("rows"),
        (F.sum("n") - F.max("n")).alias("askers"),
    )
    top = F.broadcast(written(top.where("askers > 0"), "hot"))
    rows = placed.join(top, "list")
    if not last:
        star = rows.where("component = top").groupBy("list").agg(
            F.min_by(F.struct("doc", "size", "place"), F.xxhash64("doc", "rows")).alias("star")
        )
        others = rows.where("component <> top").join(F.broadcast(written(star, "stars")), "list")
        near = _can_be_alike(
            F.col("size"), F.col("place"), F.col("star.size"), F.col("star.place"), False
        )
        return others.where(near).select(
            F.least("doc", "star.doc").alias("a"), F.greatest("doc", "star.doc").alias("b")
        )
    across = lambda n: F.ceil(F.col(n) / LIST_ROWS).cast("int")
    spot = lambda n: F.pmod(F.xxhash64("doc"), across(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), across(n) - 1))
    outside = (F.col("component") != F.col("top")).cast("int").alias("outside")
    fixed = ("doc", "size", "place", "component")
    members = rows.select(
        "list", every("askers").alias("i"), spot("rows").alias("j"), *fixed,
        F.lit(0).alias("asks"), outside,
    )
    askers = rows.where("component <> top").select(
        "list", spot("askers").alias("i"), every("rows").alias("j"), *fixed,
        F.lit(1).alias("asks"), outside,
    )
    return (
        members.unionByName(askers)
        .repartition("list", "i", "j")
        .sortWithinPartitions("list", "i", "j")
        .mapInArrow(_open_cells, "a long, b long")
    )


def _enough(pairs: DataFrame, unseen: Column) -> DataFrame:
    """Pairs ``a, b`` that occur in so many short lists that their overlap may do.

    Where the short lists of the document whose rarest shingles end first count
    ``times``, its T - 1 long lists can add no more than one each. ``unseen`` are
    lists that ``times`` does not count.
    """
    total = F.col("n") + F.col("m")
    overlap = F.ceil(total * PART / (PART + WHOLE))
    long = F.ceil(F.greatest("n", "m") * PART / WHOLE) - 1
    # A whole more covers rounding of the quotients.
    return pairs.where(F.col("times") + unseen + long + 1 >= overlap).select("a", "b")


def ngram_components(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row.

    Documents link when 100 * common shingles >= 80 * all shingles of both; a
    component is its least ``doc_id``. Texts without words, empty or null, link
    with nothing. Rows that repeat an id stand for one document, which has the links of
    all its texts. A row without
    an id has no component. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    known = rows.where("doc_id is not null")
    described = written(
        rows.mapInArrow(
            _describe, "doc_id long, n_shingles long, set_id binary, block int, counts binary"
        ),
        "described",
    )
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    common = (
        described.where("counts is not null")
        .select("block", "counts")
        .repartition("block")
        .mapInArrow(_sum_counts, "value long, times long")
        .orderBy(F.desc("times"), "value")
        .limit(MOST_COMMON)
        .collect()
    )
    common.sort()
    values = np.array([r.value for r in common], dtype=np.int64)
    ranks = np.log2(np.array([r.times for r in common], dtype=np.float64) + 1).astype(np.int64)
    blocks = max(COUNT_BLOCKS, 8 * tasks)
    sets = described.where("set_id is not null and doc_id is not null")
    copies = sets.groupBy("set_id").agg(F.min("doc_id").alias("b"), F.count("*").alias("n"))
    same = written(
        sets.join(copies.where("n > 1"), "set_id").select(F.col("doc_id").alias("a"), "b"), "copies"
    )
    postings = _without(known, _other_copies(sets, same)).mapInArrow(
        _short_lists(values, ranks, blocks), "block int, postings binary"
    )
    found = written(
        postings.repartition("block").mapInArrow(
            _merge_lists,
            "a long, b long, n long, m long, times long, list long, doc long, size long, place long",
        ),
        "lists",
    )
    # The same members can meet in lists of many partitions.
    lists = written(
        found.where("list is not null")
        .groupBy("list", "doc", "size")
        .agg(F.min("place").alias("place"), F.sum("times").alias("times")),
        "members",
    )
    counted = found.where("a is not null").groupBy("a", "b", "n", "m")
    short = counted.agg(F.sum("times").alias("times"))
    in_long = lists.groupBy("doc").agg(F.sum("times").alias("unseen"))
    near = _enough(
        short.join(in_long.withColumnRenamed("doc", "a"), "a", "left")
        .withColumnRenamed("unseen", "of_a")
        .join(in_long.withColumnRenamed("doc", "b"), "b", "left"),
        F.least(F.coalesce("of_a", F.lit(0)), F.coalesce("unseen", F.lit(0))),
    )
    edges = written(same.union(_linked(known, written(near, "pairs"))), "links")
    comps = components(edges)
    for turn in range(STAR_ROUNDS + 1):
        placed = written(
            lists.join(comps.withColumnRenamed("node", "doc"), "doc", "left").select(
                "list", "doc", "size", "place", F.coalesce("component", "doc").alias("component")
            ),
            "placed",
        )
        # A list whose members are all connected has nothing more to give, in any round.
        open_lists = placed.groupBy("list").agg(
            F.count(F.lit(1)).alias("rows"),
            F.min("component").alias("low"),
            F.max("component").alias("high"),
        )
        open_lists = written(open_lists.where("low < high").select("list", "rows"), "open")
        if open_lists.isEmpty():
            break
        last = turn == STAR_ROUNDS
        # At most one list for LIST_ROWS rows.
        hot = F.broadcast(open_lists.where(F.col("rows") > LIST_ROWS).select("list"))
        any_hot = not hot.isEmpty()
        placed = placed.join(open_lists.select("list"), "list", "left_semi")
        opened = (
            (placed.join(hot, "list", "left_anti") if any_hot else placed)
            .repartition("list")
            .sortWithinPartitions("list", "doc")
            .mapInArrow(_open_lists(last), "a long, b long")
        )
        if any_hot:
            dealt = written(placed.join(hot, "list", "left_semi"), "placed")
            opened = opened.union(_open_hot_lists(dealt, last))
        lists = placed.select("list", "doc", "size", "place")
        pairs = written(opened.distinct(), "pairs")
        if pairs.isEmpty():
            continue
        edges = edges.union(written(_linked(known, pairs), "links"))
        comps = components(edges)
    out = described.where("counts is null").select("doc_id", "n_shingles")
    return out.join(comps.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of one document of each group, that of least id; all columns as they were.

    Rows that repeat an id stay together. Rows without an id stay.
    """
    groups = ngram_components(docs).where("component_id < doc_id").select("doc_id").distinct()
    return docs.join(groups, "doc_id", "left_anti").select(*docs.columns)
