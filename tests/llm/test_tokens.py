"""Token store, packing and sharding against plain forms on small tables."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pointerloom.llm import packing, sharding, token_store
from pointerloom.llm.encoding import TextEncoder

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "a\x85b c d\x1ce <|endoftext|>x", "<|STARTOFTEXT|> A", "é É\ńx ΑΣ Σ İI", "", "  ",
    "DELİ. İ, ANKARALI DEĞİL Mİ. x ŉ. ª, ß!! é$%& ÉÀ. é'. e\u0301. ｆ. ά. ﬁ.", "a<|endoftext|>. B!! İ<|ENDOFTEXT|>",
    "it's IT'S x²\x00y!!", "Das ist ein Text, und noch einer. " * 40,
]
ROWS = [(k * 3 - 4, t) for k, t in enumerate(ODD)] + [(100, None), (100, "twice"), (None, "no id")]


def plain_ids(text, path=WORDS):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_chunks_like_whole_texts(path):
    code = TextEncoder(path, limit=8)
    texts = ODD * 2
    for text, ids in zip(texts, code.encode([t.encode() for t in texts])):
        assert np.frombuffer(ids, code.dtype).tolist() == plain_ids(text, path)


def test_store_round_trip(spark, make, tmp_path):
    path = f"{tmp_path}/store"
    token_store.write_tokens(make(ROWS, extra=True), path, WORDS, end_id=2)
    rows = token_store.read_tokens(spark, path).collect()
    want = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    rows.sort(key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [k for k, _ in want]
    start = 0
    for r, (_, text) in zip(rows, want):
        ids = [*plain_ids(text), 2]
        assert (r.start, r.n_tokens, r.ids) == (start, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert token_store.read_document(spark, path, 2) == [[*plain_ids(ODD[2]), 2]]
    assert len(token_store.read_document(spark, path, 100)) == 2
    assert token_store.read_document(spark, path, 7777) == []


def test_store_with_dictionary(spark, make, tmp_path):
    rows = [(k, f"some words of document {k} " * (k % 7)) for k in range(300)]
    path = f"{tmp_path}/store"
    token_store.write_tokens(make(rows), path, WORDS, end_id=2)
    assert len(spark.read.parquet(f"{path}/dictionary").first().dictionary) > 0
    got = {r.doc_id: r.ids for r in token_store.read_tokens(spark, path).collect()}
    assert all(got[k] == [*plain_ids(t), 2] for k, t in rows[:20])
    assert len(got) == 300


def test_store_refuses_another_dictionary():
    reader = token_store.Reader(token_store.hashlib.sha256(b"").hexdigest(), b"", 2)
    with pytest.raises(ValueError):
        reader.ids(b"", 0, 0, "other")


def test_empty_store(spark, make, tmp_path):
    token_store.write_tokens(make([]), f"{tmp_path}/store", WORDS, end_id=2)
    assert token_store.read_tokens(spark, f"{tmp_path}/store").collect() == []


def check_bins(counts, patterns, capacity):
    used = Counter()
    for pattern, times in patterns:
        assert sum(s * c for s, c in pattern) <= capacity
        for s, c in pattern:
            used[s] += c * times
    assert used == Counter({s: int(n) for s, n in enumerate(counts) if n})
    return sum(times for _, times in patterns)


def optimal(sizes, capacity):
    """Fewest bins by trying all ways."""
    best = [len(sizes)]

    def go(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(sizes):
            best[0] = len(rooms)
            return
        for i in range(len(rooms)):
            if rooms[i] >= sizes[k] and rooms[i] not in rooms[:i]:
                go(k + 1, [*rooms[:i], rooms[i] - sizes[k], *rooms[i + 1 :]])
        go(k + 1, [*rooms, capacity - sizes[k]])

    go(0, [])
    return best[0]


def test_dominance_keeps_the_optimum():
    rng = np.random.default_rng(3)
    for _ in range(150):
        capacity = int(rng.integers(6, 30))
        sizes = sorted(rng.integers(1, capacity + 1, rng.integers(1, 9)).tolist())[::-1]
        counts = np.bincount(sizes, minlength=capacity + 1)
        left = counts.copy()
        fixed = packing.reduce_instance(left, capacity)
        rest = [s for s in range(capacity, 0, -1) for _ in range(left[s])]
        bins = sum(t for _, t in fixed)
        assert bins + optimal(rest, capacity) == optimal(sizes, capacity)
        check_bins(counts, packing.pack_histogram(counts, capacity), capacity)


def test_equal_pairs_are_one_pattern():
    # No three pieces fit beside the largest and no pair fills the sequence.
    counts = np.zeros(4097, dtype=np.int64)
    counts[2500], counts[1500], counts[1400] = 30_000, 20_000, 25_000
    patterns = packing.pack_histogram(counts, 4096)
    assert len(patterns) < 10
    assert check_bins(counts, patterns, 4096) == 30_000 + 7_500


def test_best_fit_is_best_fit():
    rng = np.random.default_rng(5)
    for _ in range(60):
        capacity = int(rng.integers(10, 60))
        counts = np.bincount(rng.integers(1, capacity + 1, 80), minlength=capacity + 1)
        rooms = []
        for s in range(capacity, 0, -1):
            for _ in range(counts[s]):
                fits = [r for r in rooms if r >= s]
                room = min(fits) if fits else capacity
                if fits:
                    rooms.remove(room)
                rooms.append(room - s)
        packed = packing.best_fit(counts.copy(), capacity)
        assert check_bins(counts, packed, capacity) == len(rooms)


def test_packing(make):
    capacity = 16
    rows = [*ROWS, *[(200 + k, "word " * (k % 20)) for k in range(120)]]
    got = packing.best_fit_pack(make(rows, extra=True), WORDS, 1, capacity).collect()
    bins, by_doc = defaultdict(list), defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append(r)
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    for key, text in rows:
        if key == 100:
            continue
        ids = [*plain_ids(text), 1]
        parts = sorted(by_doc[key], key=lambda r: r.piece)
        assert [(p.piece, p.start) for p in parts] == [
            (k, k * capacity) for k in range(-(-len(ids) // capacity))
        ]
        for p in parts:
            data = np.array(ids[p.start : p.start + p.length], "<u4").tobytes()
            assert p.ids_crc32 == zlib.crc32(data)
    assert len(by_doc[100]) == 2
    assert packing.best_fit_pack(make([]), WORDS, 1, capacity).collect() == []


def test_jump_moves_only_into_the_new_shard():
    keys = np.random.default_rng(1).integers(0, 2**63, 20_000).astype(np.uint64)
    before = sharding.jump(keys, 1)
    assert set(before) == {0}
    for n in range(2, 12):
        now = sharding.jump(keys, n)
        moved = now != before
        assert set(now[moved]) == {n - 1}
        assert abs(moved.mean() - 1 / n) < 0.02
        before = now


def test_shards(make):
    rows = [*ROWS, *[(200 + k, "x" * k) for k in range(300)], (5000, "é"), (5000, "é")]
    got = sharding.shard_documents(make(rows, extra=True), 8).collect()
    assert len(got) == len(rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append((r.slot, r.doc_id))
        assert r.grown_shard in (r.shard, 8)
    for taken in slots.values():
        assert sorted(s for s, _ in taken) == list(range(len(taken)))
        keys = [k for _, k in sorted(taken) if k is not None]
        assert keys == sorted(keys)
    sizes = sorted(r["size"] for r in got if r.doc_id == 5000)
    assert sizes == [3, 3]
    assert sharding.shard_documents(make([]), 8).collect() == []


def test_portions_keep_all_rows_in_order():
    from pointerloom.llm.common import portions

    batches = [pa.RecordBatch.from_pydict({"a": list(range(n))}) for n in (0, 1, 7, 8)]
    parts = list(portions(iter(batches), 3))
    assert [p.num_rows for p in parts] == [1, 3, 3, 1, 3, 3, 2]
    got = [x for p in parts for x in p.column("a").to_pylist()]
    assert got == [x for b in batches for x in b.column("a").to_pylist()]
