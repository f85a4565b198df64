"""The prefix trie against SQL and a plain dictionary trie on small tables."""

import hashlib
import zlib

import duckdb
import numpy as np
import pytest
from compare import connect

from pointerloom.llm.oracles import OP13
from pointerloom.llm.prefix_trie import conversation_trie, prefix_trie
from pointerloom.llm.queries import QUERIES

COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def sql_rows(db):
    return sorted(db.sql(f"SELECT {', '.join(COLUMNS)} FROM ({OP13})").fetchall(), key=str)


def plain_trie(sequences, words):
    """Rows of COLUMNS from ``conv_id -> tuple of turns`` by walking a dictionary of prefixes."""
    members = {}
    for key, turns in sequences.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(key)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)

    def leaves(p):
        return sum(map(leaves, children[p])) if p in children else 1

    def saved(p):
        return sum(map(saved, children.get(p, []))) + ((len(members[p]) - 1) * words(p[-1]) if p else 0)

    out = []
    for p, who in members.items():
        ends = ",".join(str(k) for k in sorted(k for k in who if sequences[k] == p))
        out.append((min(who), len(p), min(members[p[:-1]]) if p else None, len(who), len(children.get(p, [])),
                    leaves(p), saved(p), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_like_plain_trie(spark, parts):
    """Long, equal, nested and empty sequences, however the sorted table is cut."""
    draw = np.random.default_rng(parts)
    sequences = {0: (), 900: (), 901: tuple([1] * 60), 902: tuple([1] * 61)}
    for k in range(1, 300):
        sequences[k] = tuple(int(x) for x in draw.integers(0, 3, int(draw.integers(0, 7))))
    for k in range(300, 420):
        sequences[k] = (2, 1, 0)
    for k in range(420, 480):  # every one a beginning of the next
        sequences[k] = tuple([1] * (k - 419))
    digest = lambda t: hashlib.md5(str(t).encode()).digest()
    rows = [(k, b"".join(map(digest, s)), [t + 2 for t in s]) for k, s in sequences.items()]
    df = spark.createDataFrame(rows, "conv_id long, path binary, words array<long>")
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.enabled", False)
        got = rows_of(prefix_trie(df))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == plain_trie(sequences, lambda t: t + 2)


def test_odd_rows_like_sql(spark):
    draw = np.random.default_rng(5)
    rows = [
        (int(draw.choice([-45, -41, -40, -3, 0, 1, 2, 5, 20, 21, 39, 47, 60, 63])),
         None if k % 13 == 0 else int(draw.integers(0, 4)), ["user", None, ""][k % 3],
         ["hi there", None, "", "x\x85y \x0b z", "hi  there", "long " * 5000][int(draw.integers(0, 6))], "x")
        for k in range(90)
    ] + [(None, 1, "user", "lost", "x")]
    schema = "conv_id long, turn long, role string, text string, depth string"
    df = spark.createDataFrame(rows, schema).repartition(4)
    db = duckdb.connect()
    db.register("conversations", df.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    assert rows_of(conversation_trie(df)) == sql_rows(db)
    assert conversation_trie(df.limit(0)).count() == 0
    only = spark.createDataFrame([(1 << 62, 0, "user", "a b", "x")], schema)
    deep = 1 if zlib.crc32(str(1 << 62).encode()) % 4 == 0 else 0
    assert conversation_trie(only).count() == 1 + deep


def test_query_like_sql(spark):
    folder = "/root/testdata/sf0.01"
    assert rows_of(QUERIES["op13_prefix_trie"](spark, folder)) == sql_rows(connect(folder))
