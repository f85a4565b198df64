"""The trie of conversation beginnings, from sorted conversations.

A conversation is the sequence of its turns' digests. Sorted by it, the conversations
that share a beginning lie next to each other, and how far neighbours agree says all
about the trie: if the edges between neighbours are taken by descending common depth
and their two sides united, every union makes (or widens) a branching node at that depth.

Each part of the sorted table makes its own forest so. A node that holds neither the
first nor the last conversation of its part is finished there. What is left, the nodes
above these two, is contracted: each becomes a conversation that ends at that node and
stands for all finished ones below it. The contracted forests of all parts, one row per
part, are put together by the same unions across the boundaries.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointerloom.llm.common import written

DIGEST = 16
SPACES = r"[\x20\x09-\x0D]+"
NO_ENDS = hashlib.sha256(b"").hexdigest()
NOBODY = np.iinfo(np.int64).max
BATCH_ROWS = 4096

NODE = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
    "n_leaves long, saved_tokens long, ends_sha256 string"
)
CLASSES = "path binary, words array<long>, conv_id long, n long, ends string"
STOP = (
    "struct<side:int, depth:long, conv_id:long, n:long, children:long, leaves:long, saved:long, "
    "ends:string>"
)
PLACE = "slice int, side int, at long"
FOREST = (
    f"{NODE}, {PLACE}, first_path binary, first_words array<long>, last_path binary, "
    f"last_words array<long>, stops array<{STOP}>"
)


@dataclass
class Stops:
    """Sorted distinct sequences, each with what it stands for at its last turn.

    ``n`` conversations, the least ``conv_id``, finished ``children`` below, their
    ``leaves`` and ``saved`` tokens, and the digest ``ends`` of those that end there.
    """

    depth: list[int] = field(default_factory=list)
    conv_id: list[int] = field(default_factory=list)
    n: list[int] = field(default_factory=list)
    children: list[int] = field(default_factory=list)
    leaves: list[int] = field(default_factory=list)
    saved: list[int] = field(default_factory=list)
    ends: list[str] = field(default_factory=list)

    def add(self, depth, conv_id=NOBODY, n=0, children=0, leaves=0, saved=0, ends=NO_ENDS) -> int:
        for name, value in zip(self.__dataclass_fields__, (depth, conv_id, n, children, leaves, saved, ends)):
            getattr(self, name).append(value)
        return len(self.depth) - 1

    def take(self, other: Stops, i: int, at: int) -> None:
        """Add what ``other`` holds at ``i``, the same node, to ``at``."""
        self.conv_id[at] = min(self.conv_id[at], other.conv_id[i])
        for name in ("n", "children", "leaves", "saved"):
            getattr(self, name)[at] += getattr(other, name)[i]
        if other.ends[i] != NO_ENDS:
            self.ends[at] = other.ends[i]


def common_turns(a: bytes, b: bytes) -> int:
    """Turns that two sequences of digests share from the start."""
    least, k = min(len(a), len(b)), 0
    while k < least and a[k : k + DIGEST] == b[k : k + DIGEST]:
        k += DIGEST
    return k // DIGEST


def unite(stops: Stops, edges: Sequence[int]) -> tuple[list[int], list[int]]:
    """Parent and one stop below of every node: the stops, then the nodes unions make.

    ``edges[i]`` is the depth that stops i - 1 and i share. Edges are taken by
    descending depth, equal ones from left to right; ``stops`` gets the new nodes, the
    root among them.
    """
    count = len(stops.depth)
    parent, below = [-1] * count, list(range(count))
    group, top = list(range(count)), list(range(count))

    def find(x: int) -> int:
        while group[x] != x:
            group[x] = group[group[x]]
            x = group[x]
        return x

    def node(depth: int, under: int) -> int:
        parent.append(-1)
        below.append(below[under])
        return stops.add(depth)

    for i in (np.argsort(-np.array(edges[1:], dtype=np.int64), kind="stable") + 1).tolist():
        left, right, depth = find(i - 1), find(i), edges[i]
        upper = top[left]
        if stops.depth[upper] != depth:
            upper = node(depth, top[left])
            parent[top[left]] = upper
        parent[top[right]] = upper
        group[right], top[left] = left, upper
    last = top[find(0)]
    if stops.depth[last]:
        parent[last] = node(0, last)
    return parent, below


def finish(
    stops: Stops, parent: list[int], words: Sequence, is_open: Sequence[bool]
) -> dict[int, int]:
    """Sum up from the deepest node; saved tokens of each finished node at its deepest depth.

    A node stands for all depths from below its parent's down to its own, as between
    them nobody leaves. A finished node hands its sums to its parent, an open one keeps
    what it got. ``words[x]`` are the words of every turn of a sequence through node x.
    """
    saved = {}
    for x in sorted(range(len(parent)), key=lambda x: -stops.depth[x]):
        if is_open[x]:
            continue
        if not stops.children[x]:
            stops.leaves[x] = 1
        depth, up = stops.depth[x], parent[x]
        above = stops.depth[up] if up >= 0 else 0
        spare = stops.n[x] - 1
        saved[x] = stops.saved[x] + (spare * words[x][depth - 1] if depth else 0)
        if up >= 0:
            stops.conv_id[up] = min(stops.conv_id[up], stops.conv_id[x])
            stops.n[up] += stops.n[x]
            stops.children[up] += 1
            stops.leaves[up] += stops.leaves[x]
            stops.saved[up] += saved[x] + spare * sum(words[x][above : depth - 1])
    return saved


def node_rows(stops: Stops, parent, words, saved: dict[int, int], where) -> Iterator[tuple]:
    """A row of NODE and PLACE per depth of every finished node.

    ``where(x)`` is the place of an open node, whose conv_id is not known yet.
    """
    for x, below in saved.items():
        depth, up, own = stops.depth[x], parent[x], stops.conv_id[x]
        n, leaves = stops.n[x], stops.leaves[x]
        above = stops.depth[up] if up >= 0 else -1
        known = up in saved
        for d in range(depth, above, -1):
            if d != depth:
                below += (n - 1) * words[x][d - 1]
            children, ends = (stops.children[x], stops.ends[x]) if d == depth else (1, NO_ENDS)
            over, place = own, (None, None, None)
            if d == above + 1:
                over = stops.conv_id[up] if known else None
                place = (None, None, None) if known or up < 0 else where(up)
            yield (own, d, over, n, children, leaves, below, ends, *place)


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == BATCH_ROWS:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = [pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


STOP_TYPE = pa.struct(
    [("side", pa.int32()), *((x, pa.int64()) for x in ("depth", "conv_id", "n", "children", "leaves", "saved")),
     ("ends", pa.string())]
)
NODE_FIELDS = [
    *((x, pa.int64()) for x in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")),
    ("ends_sha256", pa.string()), ("slice", pa.int32()), ("side", pa.int32()), ("at", pa.int64()),
]
NODES = pa.schema(NODE_FIELDS)
FOREST_FIELDS = pa.schema(
    [*NODE_FIELDS, ("first_path", pa.binary()), ("first_words", pa.list_(pa.int64())),
     ("last_path", pa.binary()), ("last_words", pa.list_(pa.int64())), ("stops", pa.list_(STOP_TYPE))]
)
CLASS_FIELDS = pa.schema(
    [("path", pa.binary()), ("words", pa.list_(pa.int64())), ("conv_id", pa.int64()), ("n", pa.int64()), ("ends", pa.string())]
)


def equal_conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per distinct sequence from rows sorted by ``path, conv_id``.

    Copies stream by: of a class only its digest in the making is held.
    """

    def classes() -> Iterator[tuple]:
        now, words, first, n, ends = None, None, None, 0, None
        for batch in batches:
            column = batch.column("words")
            for k, (path, key) in enumerate(
                zip(batch.column("path").to_pylist(), batch.column("conv_id").to_pylist())
            ):
                if path == now:
                    n += 1
                    ends.update(b",%d" % key)
                    continue
                if n:
                    yield now, words, first, n, ends.hexdigest()
                now, words, first, n = path, column[k].as_py(), key, 1
                ends = hashlib.sha256(b"%d" % key)
        if n:
            yield now, words, first, n, ends.hexdigest()

    yield from _batches(classes(), CLASS_FIELDS)


def part_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Finished nodes of a part of the sorted sequences, and one row of its contracted forest."""
    slice_ = TaskContext.get().partitionId()
    stops, edges, words, first, last = Stops(), [], [], None, b""
    for batch in batches:
        for row in batch.to_pylist():
            edges.append(common_turns(last, row["path"]) if words else 0)
            first, last = row["path"] if first is None else first, row["path"]
            words.append(row["words"])
            stops.add(len(last) // DIGEST, row["conv_id"], row["n"], ends=row["ends"])
    if not words:
        return
    count = len(words)
    parent, below = unite(stops, edges)
    through = [words[b] for b in below]
    side = [-1] * len(parent)
    for which, x in ((0, 0), (1, count - 1)):
        while x >= 0 and side[x] < 0:
            side[x] = which
            x = parent[x]
    is_open = [s >= 0 for s in side]
    saved = finish(stops, parent, through, is_open)

    def rows() -> Iterator[tuple]:
        nothing = (None,) * 5
        where = lambda x: (slice_, side[x], stops.depth[x])
        for row in node_rows(stops, parent, through, saved, where):
            yield row + nothing
        kept = [
            {"side": side[x], **{k: getattr(stops, k)[x] for k in stops.__dataclass_fields__}}
            for x in range(len(parent))
            if is_open[x]
        ]
        yield (None,) * 8 + (slice_, None, None, first, words[0], last, words[count - 1], kept)

    yield from _batches(rows(), FOREST_FIELDS)


def joined_forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of the contracted forests of all parts, and which of them each open node is.

    The latter are rows of ``conv_id`` and PLACE with a null depth.
    """
    parts = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: r["slice"])
    if not parts:
        return
    paths = [p for r in parts for p in (r["first_path"], r["last_path"])]
    words = [w for r in parts for w in (r["first_words"], r["last_words"])]
    shared = [0, *(common_turns(a, b) for a, b in zip(paths, paths[1:]))]
    # The same node can be open in many parts: it goes by the first boundary below it
    # and its depth. Pairs (deepest depth, first boundary) say which that is.
    depths, origins, found = [], [], {}
    for b, path in enumerate(paths):
        keep = bisect_left(depths, shared[b])
        if keep < len(depths):
            depths[keep:], origins[keep:] = [shared[b]], [origins[keep]]
        depths.append(len(path) // DIGEST)
        origins.append(b)
        for stop in parts[b // 2]["stops"]:
            if stop["side"] == b % 2:
                key = (origins[bisect_left(depths, stop["depth"])], stop["depth"])
                found.setdefault(key, []).append((b, stop))
    stops, edges, through, places = Stops(), [], [], []
    before = None
    for key in sorted(found):
        if before is None:
            edges.append(0)
        else:
            between = min(shared[before[0] + 1 : key[0] + 1], default=key[1])
            edges.append(min(before[1], key[1], between))
        at = stops.add(key[1])
        for b, stop in found[key]:
            one = Stops(*([stop[k]] for k in stops.__dataclass_fields__))
            stops.take(one, 0, at)
            places.append((at, (parts[b // 2]["slice"], b % 2, key[1])))
        through.append(words[key[0]])
        before = key
    parent, below = unite(stops, edges)
    through = [through[b] for b in below]
    saved = finish(stops, parent, through, [False] * len(parent))

    def rows() -> Iterator[tuple]:
        yield from node_rows(stops, parent, through, saved, None)
        for x, place in places:
            yield (stops.conv_id[x], *(None,) * 7, *place)

    yield from _batches(rows(), NODES)


def rebuilt_conversations(conversations: DataFrame, stride: int = 20, most: int = 4) -> DataFrame:
    """``conv_id, path, words``: every conversation with a borrowed beginning.

    The first ``crc32(conv_id) % most`` turns come from the conversation whose id is the
    next multiple of ``stride`` towards zero. ``path`` joins the digests of the turns,
    ``words`` are their lengths. Texts stay where they are read.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    marked = F.concat(F.octet_length(text("role")).cast("string"), F.lit(":"), text("role"), text("text"))
    size = F.size(F.array_remove(F.split(text("text"), SPACES), "")).cast("long")
    turns = (
        conversations.where("conv_id is not null")
        .withColumn("_id", F.col("conv_id").cast("long"))
        .select(
            F.col("_id").alias("conv_id"),
            (F.col("_id") - F.col("_id") % stride).alias("donor"),
            F.struct(
                F.col("turn").cast("long").alias("turn"),
                F.md5(marked.cast("binary")).alias("digest"),
                size.alias("words"),
            ).alias("t"),
        )
    )
    held = turns.repartition("donor").groupBy("donor", "conv_id").agg(F.sort_array(F.collect_list("t")).alias("own"))
    lent = F.max(F.when(F.col("conv_id") == F.col("donor"), F.slice("own", 1, most - 1)))
    borrowed = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    built = F.concat(
        F.slice(F.coalesce("lent", F.slice("own", 1, 0)), F.lit(1), F.col("h")),
        F.slice("own", F.col("h") + 1, F.size("own")),
    )
    return (
        held.withColumn("lent", lent.over(Window.partitionBy("donor")))
        .withColumn("h", borrowed)
        .select("conv_id", built.alias("turns"))
        .select(
            "conv_id",
            F.unhex(F.array_join("turns.digest", "")).alias("path"),
            F.col("turns.words").alias("words"),
        )
    )


def prefix_trie(rebuilt: DataFrame) -> DataFrame:
    """Every node of the trie of ``conv_id, path, words`` rows with distinct ids.

    Equal sequences become one row first, as the digest of the ids that end at a node is
    sequential by nature: the copies of a class stream through one task, which holds
    nothing of them. Distinct sequences are cut into even ranges, so a beginning that
    many share is spread over parts; the last union sees one row per part. A task holds
    its part of the distinct sequences, 24 bytes a turn.
    """
    ordered = rebuilt.repartition("path").sortWithinPartitions("path", "conv_id")
    distinct = written(ordered.mapInArrow(equal_conversations, CLASSES), "sequences")
    ranges = distinct.repartitionByRange("path").sortWithinPartitions("path")
    forest = written(ranges.mapInArrow(part_forest, FOREST), "forests")
    contracted = forest.where("stops is not null")
    names = [x.split()[0] for x in PLACE.split(", ")]
    joined = written(
        contracted.select("slice", "first_path", "first_words", "last_path", "last_words", "stops")
        .repartition(1)
        .mapInArrow(joined_forests, f"{NODE}, {PLACE}"),
        "trie",
    )
    known = joined.where("depth is null").select(F.col("conv_id").alias("_over"), *names)
    columns = [x.split()[0] for x in NODE.split(", ")]
    finished = (
        forest.where("stops is null")
        .select(*columns, *names)
        .join(known, names, "left")
        .withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_over"))
        .select(*columns)
    )
    return finished.unionByName(joined.where("depth is not null").select(*columns))


def conversation_trie(conversations: DataFrame, stride: int = 20, most: int = 4) -> DataFrame:
    """A row per node of the trie of rebuilt conversations, the textless root included.

    ``conv_id`` (least member), ``depth``, ``parent_conv_id`` (null for the root),
    ``n_convs`` (members), ``n_children``, ``n_leaves``, ``saved_tokens`` (words of shared
    turns that need to be stored or computed only once, below and at the node) and
    ``ends_sha256`` of the ids that end there.

    Turns are ordered by ``turn``, null first; of equal turn numbers by the digest of
    role and text. Null roles and texts are empty. Rows without a conv_id belong to no
    conversation. Repeated rows are turns of their own. An empty table has no node, not
    even a root. Other columns are ignored. A conversation is one row of 32 bytes a turn.
    """
    return prefix_trie(rebuilt_conversations(conversations, stride, most))
